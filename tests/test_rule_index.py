"""Rules looked up by needed literals give the rows of the generated CASE."""

import random
import re

import pytest
from pyspark.sql import functions as F

from labelset.operators import match as MT
from labelset.operators.rule_index import match_rule_table, needed_literals


def test_needed_literals():
    assert needed_literals("^churn de (?:mrr|receita).*$") == [["churn de "]]
    assert needed_literals("^open rate.*$|^taxa de abertura.*$") == [["open rate"], ["taxa de abertura"]]
    assert needed_literals("(?:abc|def)?x") == [] and needed_literals(".*a.b") == [] and needed_literals("(abc") == []
    assert needed_literals("(?i)churn") == [] and needed_literals("(?!abc)d") == [] and needed_literals("abc|.*") == []
    assert needed_literals("(?:abc)+[xy](?:def){2,}") == [["abc", "def"]]
    assert needed_literals("x(?:abcd|(?:efg|hij)k)") == [["abcd"], ["efg"], ["hij"]]
    assert needed_literals("colou?r") == [["colo"]]


def test_literals_are_needed():
    """Every string that a pattern matches contains one alternative whole."""
    rng = random.Random(2)
    words = ["abc", "bcd", "a b", "xyz"]
    for _ in range(400):
        atom = lambda: rng.choice([rng.choice(words), f"(?:{rng.choice(words)}|{rng.choice(words)})", f"(?:{rng.choice(words)})?",
                                   "[ab]", ".", f"(?:{rng.choice(words)})+", "x*", f"({rng.choice(words)})"])
        pattern = "|".join("".join(atom() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 2)))
        need = needed_literals(pattern)
        for _ in range(60):
            s = "".join(rng.choice([*words, "a", "b", " "]) for _ in range(rng.randint(0, 4)))
            if need and re.match(pattern, s):
                assert any(all(w in s for w in alt) for alt in need), (pattern, s)


def test_equal_to_case(spark):
    rng = random.Random(5)
    texts = ["taxa de conversao", "churn de mrr", "open rate geral", "nps", "roi da campanha", "win rate", "mql xx rate", "x", "", "custo por lead b2b",
             "taxa de bounce de email", "disponibilidade", "uptime"]
    names = texts + [f"{rng.choice(texts)} {rng.choice(texts)}" for _ in range(150)]
    df = spark.createDataFrame([(n,) for n in [*names, None, names[0]]], "name string")
    rules = spark.createDataFrame([(i, p, MT.py_normalize(t)) for i, (p, t) in enumerate(MT.ALIAS_RULES)], "rule_order int, pattern string, target string")
    got = {r["name"]: r["target"] for r in match_rule_table(df, rules.repartition(3)).collect()}
    want = {r["name"]: r["t"] for r in df.distinct().select("name", MT.match_rules(F.col("name")).alias("t")).collect() if r["t"] is not None}
    assert got == want and len(want) > 50
    assert match_rule_table(df.limit(0), rules).count() == 0 and match_rule_table(df, rules.limit(0)).count() == 0


def test_too_many_open_rules(spark):
    df = spark.createDataFrame([("a",)], "name string")
    rules = spark.range(1200).select(F.col("id").alias("rule_order"), F.lit(".*").alias("pattern"), F.lit("t").alias("target"))
    with pytest.raises(ValueError):
        match_rule_table(df, rules)


def test_candidates_by_whole_literals(spark):
    """Numbered rules and names: a name meets the rules whose literal it contains, not all that share a 3-gram."""
    from labelset.operators.rule_index import rule_candidates

    names = spark.range(3000).select(F.concat(F.lit("part brand "), (F.col("id") + 10000).cast("string")).alias("_n"))
    rules = spark.range(300).select(F.col("id").alias("rule_order"), F.concat(F.lit("[a-z ]+ "), (F.col("id") * 10 + 10000).cast("string"), F.lit("$")).alias("pattern"),
                                    F.lit("t").alias("target"), F.array(F.array(F.concat(F.lit(" "), (F.col("id") * 10 + 10000).cast("string")))).alias("_alts"))
    met = rule_candidates(names, rules)
    assert met.count() == 300 and met.filter(F.rlike("_n", F.col("pattern"))).count() == 300
    # a literal that every name has deals the names over parts; its rules meet them all, once
    every = rules.limit(2).withColumn("_alts", F.array(F.array(F.lit("part brand 1"))))
    more = names.unionByName(spark.range(6000).select(F.concat(F.lit("part brand 1"), F.col("id").cast("string")).alias("_n"))).distinct()
    assert rule_candidates(more, every).distinct().count() == 2 * more.count() == rule_candidates(more, every).count()


def test_long_and_repeated_literals(spark):
    rng = random.Random(7)
    words = ["taxa de conversao de visitantes", "taxa de conversao de clientes", "aaaa", "aaaaaaaaaaaaaaaaaaaa", "çãé", "\U0001f600\U0001f600x"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(80)]
    pats = [f".*{w}{e}" for w in words for e in ("", "$", " a")] + ["(?:çãé|taxa de conversao de clientes pagantes|aaaa a).*"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rules = spark.createDataFrame([(i, p, p) for i, p in enumerate(pats)], "rule_order int, pattern string, target string")
    got = {r["name"]: r["target"] for r in match_rule_table(df, rules).collect()}
    want = {n: next(p for p in pats if re.match(p, n)) for n in names if any(re.match(p, n) for p in pats)}
    assert got == want and len(want) > 20
