"""Ordered regex rules from a table (J4 for large rule sets).

A generated ``CASE`` tries every rule on every name. Here a rule is looked up by text that it needs:
each pattern is parsed for literals that every match contains (for alternatives: literals of
each alternative), and the literal that is rarest among the names (of a long one its rarest
``PIECE`` characters) becomes the rule's join key. Names are cut only where a rule's
literal may start, into the lengths that such literals have, and meet only the rules whose key they
contain (equi-join, the names of a hot key dealt over parts); the pattern then decides, and
the first rule by order wins. Rules without such a literal (at most ``MOST_OPEN``) go through one ``CASE`` over
all names. No table that grows with names or rules is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:  # the standard library's regex parser, under its name since Python 3.11
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:
    import sre_constants as sre
    import sre_parse as sre_parser

from labelset.session import cut_lineage

GRAM = 3
PIECE = 16
MOST_OPEN = 1000
#: Classes of the 3-grams at the start of a key: bounds the one table that every task of the names holds.
HEADS = 1 << 14
#: Names of one key in one part; the key's rules are repeated for each part.
KEY_ROWS = 4096


def _literals(seq) -> tuple[list[str], list[list[list[str]]]]:
    """Literals that each match of a parsed sequence contains, and the alternatives of its branches."""
    whole, branches, run = [], [], []

    def flush() -> None:
        if run:
            whole.append("".join(run))
            run.clear()

    for op, arg in seq:
        if op is sre.LITERAL:
            run.append(chr(arg))
            continue
        flush()
        if op is sre.SUBPATTERN:
            inner = _literals(arg[-1]) if not (arg[1] or arg[2]) else ([], [])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            inner = _literals(arg[2])
        elif op is sre.BRANCH:
            # an alternative that branches again counts with the union of its own alternatives
            inner = ([], [[alt for b in arg[1] for alt in _alternatives(b)]])
        else:  # classes, anchors, optional parts, look-arounds: nothing is needed
            inner = ([], [])
        whole += inner[0]
        branches += inner[1]
    flush()
    return whole, branches


def _alternatives(seq) -> list[list[str]]:
    """Lists of literals, one of which is contained whole in each match; an empty list stands for no demand."""
    whole, branches = _literals(seq)
    if any(len(w) >= GRAM for w in whole) or not branches:
        return [[w for w in whole if len(w) >= GRAM]]
    known = [b for b in branches if all(any(len(w) >= GRAM for w in alt) for alt in b)]
    return [[w for w in alt if len(w) >= GRAM] for alt in known[0]] if known else [[]]


def needed_literals(pattern: str) -> list[list[str]]:
    """Alternatives of literals (of 3 letters or more) that a name must contain to match; empty if nothing is known."""
    try:
        parsed = sre_parser.parse(pattern)
    except Exception:  # noqa: BLE001 - another dialect's syntax: no literal is known
        return []
    if parsed.state.flags & sre.SRE_FLAG_IGNORECASE or parsed.state.flags & sre.SRE_FLAG_VERBOSE:
        return []
    alternatives = _alternatives(parsed)
    return alternatives if all(alternatives) else []


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _needed(pattern: pd.Series) -> pd.Series:
    return pattern.map(lambda p: needed_literals(p) if p is not None else [])


def _windows(c, least: int):
    """Distinct stretches of ``PIECE`` characters of a text; at its end shorter ones down to ``least``."""
    last = F.greatest(F.length(c) - least + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(c, i, PIECE)))


def _head(c):
    return F.pmod(F.xxhash64(F.substring(c, 1, GRAM)), F.lit(HEADS)).cast("int")


def _name_pieces(n: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(_n, piece)`` of the parts of each name that may be one of ``pieces``: same class of start, same length."""
    heads = pieces.groupBy(_head("piece").alias("head")).agg(F.collect_set(F.length("piece")).alias("sizes"))
    places = n.filter(F.length("_n") >= GRAM).select("_n", F.explode(_windows(F.col("_n"), GRAM)).alias("at"))
    places = places.withColumn("head", _head("at")).join(F.broadcast(heads), "head")  # at most HEADS rows of PIECE lengths
    cut = F.array_distinct(F.transform("sizes", lambda k: F.substring("at", F.lit(1), k)))
    # a place near the end of the name is cut shorter than some lengths; such a part is looked up once
    return places.select("_n", F.explode(cut).alias("piece"))


def rule_candidates(names: DataFrame, rules: DataFrame) -> DataFrame:
    """``(_n, rule_order, pattern, target)``: each name (``_n``) with the rules whose rarest needed literal it contains.

    ``rules`` carry their needed literals as ``_alts``.
    """
    alts = rules.filter(F.size("_alts") > 0).select("rule_order", "pattern", "target", F.posexplode("_alts").alias("_alt", "_words"))
    r_pieces = alts.select("rule_order", "pattern", "target", "_alt", F.explode(F.array_distinct(F.flatten(
        F.transform("_words", lambda w: _windows(w, PIECE))))).alias("piece"))
    n_pieces = _name_pieces(names, r_pieces.select("piece"))
    df = n_pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
    # an alternative with a literal that no name has cannot match; the others are keyed by their rarest one
    keyed = r_pieces.join(df.hint("merge"), "piece", "left").groupBy("rule_order", "pattern", "target", "_alt").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "piece")).alias("_key")).filter("_key.df > 0")
    parts = F.ceil(F.col("df") / KEY_ROWS)
    keyed = keyed.select("rule_order", "pattern", "target", F.col("_key.piece").alias("piece"), F.col("_key.df").alias("df")).distinct()
    keyed = keyed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("df")
    # at most one hot key in KEY_ROWS rows
    hot = df.filter(F.col("df") > KEY_ROWS).select("piece", parts.alias("_parts"))
    dealt = n_pieces.join(F.broadcast(hot), "piece", "left").select(
        "_n", "piece", F.pmod(F.xxhash64("_n"), F.coalesce("_parts", F.lit(1))).alias("part"))
    return keyed.join(dealt.hint("merge"), ["piece", "part"]).select("_n", "rule_order", "pattern", "target")


def match_rule_table(names: DataFrame, rules: DataFrame, name: str = "name") -> DataFrame:
    """``(name, target, rule_order)`` of the first rule that matches at the start of each distinct name.

    ``rules``: ``(rule_order, pattern, target)``; patterns are anchored at the start only, as in
    ``match_rules``. Names that no rule matches, and null names, have no row; ties in ``rule_order`` go to
    the smallest pattern, then target.
    """
    n = names.select(F.col(name).alias("_n")).filter(F.col("_n").isNotNull()).distinct()
    r = rules.select("rule_order", "pattern", "target").filter(F.col("pattern").isNotNull())
    # the parsed rules feed the keys, the heads and the open rules: parse them once, by many tasks
    r = cut_lineage(r.repartition("pattern").withColumn("_alts", _needed("pattern")))
    hits = rule_candidates(n, r).filter(F.rlike(F.col("_n"), F.concat(F.lit("^(?:"), "pattern", F.lit(")"))))
    hits = hits.select("_n", F.struct("rule_order", "pattern", "target").alias("_rule"))
    open_ = r.filter(F.size("_alts") == 0).select("rule_order", "pattern", "target").limit(MOST_OPEN + 1).collect()
    if len(open_) > MOST_OPEN:
        raise ValueError(f"more than {MOST_OPEN} rules have no literal of {GRAM} letters that their matches need")
    if open_:
        hits = hits.unionByName(_first_open(n, sorted(tuple(x) for x in open_)))
    best = hits.groupBy("_n").agg(F.min("_rule").alias("_rule"))
    return best.select(F.col("_n").alias(name), "_rule.target", "_rule.rule_order")


def _first_open(n: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    case = F
    for order, pattern, target in rules:
        rule = F.struct(F.lit(order).alias("rule_order"), F.lit(pattern).alias("pattern"), F.lit(target).alias("target"))
        case = case.when(F.col("_n").rlike(f"^(?:{pattern})"), rule)
    return n.select("_n", case.alias("_rule")).filter(F.col("_rule").isNotNull())
