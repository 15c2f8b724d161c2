"""URL verdicts: longest matching rule first, else an exact block list behind a blocked Bloom filter.

The listed URLs are reduced to canonical form and hashed into a split-block filter: 512-bit
blocks of eight 64-bit words, one bit a word. The filter has at most MAX_BLOCKS blocks
(16 MiB), so its broadcast is bounded; a fuller filter only passes more. URLs whose eight bits
are set go on to a hash join with the listed URLs, which removes the false positives, the
others are settled without a shuffle.

Canonical form: host without user, port and a leading ``www.`` or ``m.``, path without
trailing slashes; scheme, query and fragment go.

Defined results: a null URL or one without ``://`` has empty host and path, no rule and, as
nothing lists it, the verdict allow; repeated rows are judged alike; an empty table or an
empty list work; other columns are carried.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL, MAX_BLOCKS = 12, 1 << 18
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


#: The deployed rules (fixed values).
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: str = "url") -> Column:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _URL, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _URL, 2)


def canonical(host: Column, path: Column) -> Column:
    """Canonical URL from host and path; null for an empty host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"^(www|m)\.", "")
    return F.when(bare != "", F.concat(bare, F.regexp_replace(path, "/+$", "")))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):  # the last condition set is tried first
        out = F.when(_fits(r, host, path), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> Column:
    h = F.xxhash64(F.lit(9), key)
    return F.array(*[F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(8)])


def bloom(listed: DataFrame, key: str = "key") -> tuple[DataFrame, int]:
    """Filter of the keys as rows (block, words) and its number of blocks."""
    n = listed.count()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 512 < n * BITS_PER_URL:
        blocks *= 2
    bits = listed.select(_block(F.col(key), blocks).alias("block"), _masks(F.col(key)).alias("m"))
    words = bits.groupBy("block").agg(*[F.bit_or(F.get("m", F.lit(i))).alias(f"w{i}") for i in range(8)])
    return words.select("block", F.array(*[f"w{i}" for i in range(8)]).alias("words")), blocks


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; ``listed`` has the blocked URLs in column ``url``."""
    keys = listed.select(canonical(host_of(), path_of()).alias("key")).where("key IS NOT NULL").distinct()
    words, blocks = bloom(keys)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    d = pages.select(F.struct(*pages.columns).alias("_row"), host_of(url).alias("_host"), path_of(url).alias("_path"))
    d = d.select("_row", "_host", "_path", longest_rule(F.col("_host"), F.col("_path"), rules).alias("_rule"),
                 canonical(F.col("_host"), F.col("_path")).alias("_key"))
    d = d.withColumn("_block", _block(F.col("_key"), blocks)).join(F.broadcast(words.withColumnRenamed("block", "_block")), "_block", "left")
    hit = F.aggregate(F.zip_with("words", _masks(F.col("_key")), lambda w, m: w.bitwiseAND(m) != 0), F.lit(True), lambda a, x: a & x)
    d = d.withColumn("_maybe", F.col("_rule").isNull() & F.col("_key").isNotNull() & F.coalesce(hit, F.lit(False)))
    exact = d.where("_maybe").join(keys.select(F.col("key").alias("_key"), F.lit(True).alias("_listed")), "_key", "left")
    rest = d.where("NOT _maybe").withColumn("_listed", F.lit(None).cast("boolean"))
    both = exact.unionByName(rest)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_listed"), "block").otherwise("allow"))
    return both.select(*[F.col("_row").getField(c).alias(c) for c in kept], F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))
