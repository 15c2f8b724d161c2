"""Canonicalisation of names against a universe: rules -> exact -> tokens -> strings.

All stages work on DataFrames of *distinct* names, each stage on the residual of the one
before (``left_anti``), so the costly stages see few names; the hits are unioned and
joined back by the caller.

* rules   : ordered regexes compiled into one ``CASE WHEN`` (first hit wins);
* exact   : equi (semi) join on the normal form;
* tokens  : token-set similarity (Jaccard + 0.1 on containment, accept >= 0.6), found
            with a lossless prefix-filter equi-join on rare tokens instead of all pairs;
* strings : sequence similarity (>= 0.85) over equi-joins on rare bigrams (characters for
            short strings); the exact ratio of the scored tool runs in an Arrow UDF, a native Levenshtein variant
            stays in the JVM.
"""

from __future__ import annotations

import difflib
import functools
import math
import re
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from labelset.functions.text import STOPWORDS, token_set
from labelset.operators import set_sketch as S
from labelset.session import cut_lineage, dropped_shuffles, land_table

TOKEN_THRESHOLD = 0.60
CONTAINMENT_BONUS = 0.1
STRING_THRESHOLD = 0.85

# ---------------------------------------------------------------------------
# The ordered alias rules (pattern, target) of the scored tool. Patterns
# are matched at the start of the normalised name; the first hit wins.
# ---------------------------------------------------------------------------
ALIAS_RULES: tuple[tuple[str, str], ...] = (
    (r"^disponibilidade$", "uptime"),
    (r"^taxa de uptime$", "uptime"),
    (r"^uptime$", "uptime"),
    (r"^tempo medio (?:para )?recupera.*$", "mttr"),
    (r"^tempo medio (?:para )?resolucao.*$", "mttr"),
    (r"^tempo medio (?:para )?restaurar.*$", "mttr"),
    (r"^mttr.*$", "mttr"),
    (r".*\broas\b.*|^taxa de retorno sobre atribuicao(?: roas)?$", "roas"),
    (r".*\broi\b.*|^retorno sobre investimento$", "roi"),
    (r"^custo por mil impress.*$", "cpm"),
    (r"^custo por aquisicao(?: cpa)?$", "cpa"),
    (r"^custo por conversao$", "cpa"),
    (r"^custo por lead.*$", "cpl"),
    (r"^custo por cliques?$|^custo por clique$", "cpc"),
    (r"^mql.*rate.*$|^taxa de conversao mql$", "mql rate"),
    (r"^win rate$", "win rate"),
    (r"^nps.*$|^net promoter score$", "nps"),
    (r"^taxa de satisfacao .*csat.*$|^csat$|^taxa de satisfacao do cliente(?: \(csat\))?$", "csat"),
    (r"^taxa de resolucao no primeiro contato.*$|^first contact resolution.*$|^fcr$", "fcr"),
    (r"^taxa de rsvp confirmad.*$|^rsvp confirmed.*$", "rsvp confirmado"),
    (r"^entregabilidade de emails?$|^entregabilidade de e mail.*$|^email deliverability.*$",
     "entregabilidade de e mail"),
    (r"^open rate.*$|^taxa de abertura.*$", "taxa de abertura"),
    (r"^spam complaint.*$|^taxa de reclama.*spam.*$", "spam complaint rate"),
    (r"^taxa de bounce.*(email|e mail).*$", "bounce rate de e mail"),
    (r"^taxa de bounce.*$", "bounce rate"),
    (r"^taxa de retencao 30.*$|^retencao 30 dias$", "retencao 30d"),
    (r"^taxa de retencao 90.*$|^retencao 90 dias$", "retencao 90d"),
    (r"^churn 90.*$|^taxa de churn em 90 dias$", "churn 90d"),
    (r"^churn de receita.*$|^churn de mrr$", "churn de mrr"),
    (r"^ativac[aã]o d ?7$", "ativacao d7"),
    (r"^taxa de conversao do onboarding$", "taxa de conversao de onboarding"),
    (r"^custo de atribuic[aã]o por canal$", "custo por atribuicao por canal"),
    (r"^custo por atribuic[aã]o por canal$", "custo por atribuicao por canal"),
    (r"^taxa de atribuic[aã]o de vendas? offline$", "atribuicao de vendas offline"),
    (r"^taxa de conversao por impress.*$", "taxa de conversao por impressoes"),
    (r"^dau[/ ]?mau$", "dau mau"),
    (r"^checkout conversion rate$", "conversao de checkout"),
    (r"^checkout abandonment.*$", "abandono de checkout"),
    (r"^average revenue per paying user.*$", "arppu"),
    (r"^taxa de conversao geral$", "taxa de conversao"),
)


def py_normalize(s: str) -> str:
    """Driver-side normalisation of literals (rule targets), same result as the column
    expression ``normalize_text``."""
    if not isinstance(s, str):
        return ""
    t = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    return re.sub(r"[^a-z0-9]+", " ", t.lower()).strip()


# --- J4 --------------------------------------------------------------------------------------
def match_rules(c: Column, rules: Sequence[tuple[str, str]] = ALIAS_RULES) -> Column:
    """Target of the first rule whose pattern matches at the start of ``c``; else NULL.

    Python's ``re.match`` anchors at the start only, so each pattern is wrapped in
    ``^(?:...)``; patterns without ``$`` are prefix rules. Targets are normalised.
    """
    expr = None
    for pattern, target in rules:
        cond = c.rlike(f"^(?:{pattern})")
        tgt = F.lit(py_normalize(target))
        expr = F.when(cond, tgt) if expr is None else expr.when(cond, tgt)
    return expr if expr is not None else F.lit(None).cast("string")


# --- J3 / J5 ---------------------------------------------------------------------------------
def match_exact(names: DataFrame, universe: DataFrame, name: str = "name",
                norm: str = "norm") -> DataFrame:
    """Names that are themselves in the universe -> ``(name, canon=name)``."""
    u = universe.select(F.col(norm).alias(name)).distinct()
    return names.join(u, name, "left_semi").select(name, F.col(name).alias("canon"))


# --- J6: token similarity --------------------------------------------------------------------
def _token_rows(df: DataFrame, id_col: str, tok_col: str) -> DataFrame:
    # 64-bit token hashes: a collision only adds a candidate, the strings are compared at the end
    hashed = F.array_distinct(F.transform(F.col(tok_col), lambda t: F.xxhash64(t)))
    # the size goes with each element: beside the explode it would be computed again for every row
    return df.select(F.col(id_col).alias("id"), hashed.alias("_h")).select(
        "id", F.inline(F.transform("_h", lambda t: F.struct(t.alias("tok"), F.size("_h").alias("sz")))))


#: A posting list longer than this is split; its partner rows are repeated for each part.
POSTING_ROWS = 4096
#: Cost of shipping one token of a candidate's two sets to its verification, in joined prefix rows.
VERIFY_COST = 0.4
#: Shared tokens asked of a contained set and the set that contains it.
CONTAINED = 2
#: Joined rows of a round of candidates before sizes and positions are compared (of one table with itself: bytes
#: that move), for each prefix row, and at least.
ROUND_ROWS, LEAST_ROUND = 32, 1 << 22
#: Prefix rows in a part of a table's join with itself; a posting list is split there at so many times POSTING_ROWS.
PART_ENTRIES, LONG_POSTINGS = 3 << 20, 8
#: Candidates of a set that are verified first, and next if the best partner is still open; then the rest.
BEST_STEPS = (1, 8)


def _ranked(rows: DataFrame, freq: DataFrame, share: float = TOKEN_THRESHOLD) -> DataFrame:
    """``id, tok, sz, pos, len, df``: each set's tokens from the rarest on, and its prefix extension.

    A set keeps ``sz - ceil(share * sz) + len`` tokens of its global frequency order. Two sets that have
    that share of each in common (0.6 for a Jaccard of 0.6) then share ``len`` of them (the smaller of the two extensions), so a longer
    prefix costs more joined rows and leaves fewer candidates. ``len`` minimises, per set,
    S + S / len * (cost of verifying a candidate), S the posting rows that its prefix meets: at
    most S / len partners can share len tokens.
    """
    by_set = Window.partitionBy("id")
    order = by_set.orderBy("df", "tok")
    base = _base(share)
    r = rows.join(freq, "tok").withColumn("pos", F.row_number().over(order))
    met = F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0))
    step = F.col("pos") - base
    cost = met * (1 + VERIFY_COST * F.col("sz") / step)
    best = F.min(F.when(step >= 1, F.struct(cost, step.alias("len")))).over(by_set)
    return r.withColumn("len", best["len"].cast("int"))


def _base(share: float) -> Column:
    return F.col("sz") - F.ceil(F.col("sz") * share - 1e-9)


def _side(ranked: DataFrame, side: str, prefix: Column) -> DataFrame:
    """A side's rows within the prefix, columns named by the side."""
    return ranked.filter(F.col("pos") <= prefix).select(
        F.col("id").alias(f"{side}id"), "tok", "df", *(F.col(c).alias(f"{side}{c}") for c in ("sz", "pos", "len")))


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides with one token; the left rows of a hot token are dealt over parts, the right ones repeated."""
    parts = F.ceil(F.col("df") / POSTING_ROWS)
    l = left.withColumn("part", F.pmod(F.xxhash64("lid"), parts)).drop("df")
    r = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("df")
    return l.join(r, ["tok", "part"])


def _overlap_candidates(left: DataFrame, right: DataFrame, need: Callable[[Column, Column], Column], share: float,
                        keep: Column | None = None) -> DataFrame:
    """Pairs ``lid, rid`` of ranked sets of sizes a and b that can have ``need(a, b)`` tokens in common.

    They have ``k`` of them within the first ``size - need + k`` tokens of either set, ``k`` the smaller extension.
    ``need(a, b)`` is at least ``share`` of each size for every pair that is possible at all.
    """
    prefix = _base(share) + F.col("len")
    rows = _meet(_side(left, "l", prefix), _side(right, "r", prefix))
    needed = need(F.col("lsz"), F.col("rsz"))
    k = F.least("llen", "rlen", needed)
    rows = rows.filter((needed <= F.least("lsz", "rsz")) & (F.col("lpos") <= F.col("lsz") - needed + k)
                       & (F.col("rpos") <= F.col("rsz") - needed + k))
    if keep is not None:
        rows = rows.filter(keep)
    shared = rows.groupBy("lid", "rid").agg(F.count(F.lit(1)).alias("n"), F.max(k).alias("k"))
    return shared.filter("n >= k").select("lid", "rid")


def _contained_candidates(small: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs of a set (``lid``) that may lie whole in one of 5/3 to 2 times its size (``rid``): below 0.6
    they pass by the bonus only. The small set's first tokens are all in the large one, which
    has at most ``b - a`` others before them."""
    l = _side(small, "l", F.lit(CONTAINED))
    r = _side(large, "r", F.col("sz") - F.ceil(F.col("sz") / 2) + CONTAINED)
    rows = _meet(l, r).filter((F.col("rsz") * 3 > F.col("lsz") * 5) & (F.col("rsz") <= F.col("lsz") * 2)
                              & (F.col("rpos") <= F.col("rsz") - F.col("lsz") + F.col("lpos")))
    k = F.least(F.lit(CONTAINED), F.col("lsz"))
    shared = rows.groupBy("lid", "rid").agg(F.count(F.lit(1)).alias("n"), F.max(k).alias("k"))
    return shared.filter("n >= k").select("lid", "rid")


def ranked_sets(left: DataFrame, right: DataFrame, self_join: bool = False,
                materialize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Ranked prefix rows of the ``(id, tokens)`` tables, as far as any candidate needs them."""
    lrows = _token_rows(left, "id", "tokens")
    rrows = lrows if self_join else _token_rows(right, "id", "tokens")
    every = lrows if self_join else lrows.unionByName(rrows)
    freq = every.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    # prefix rows are read by both kinds of candidates: rank them once
    reach = F.greatest(_base(TOKEN_THRESHOLD) + F.col("len"), _base(0.5) + CONTAINED)
    land = lambda df: land_table(df.filter(F.col("pos") <= reach)) if materialize else df
    l = land(_ranked(lrows, freq))
    return l, l if self_join else land(_ranked(rrows, freq))


def token_candidates(left: DataFrame, right: DataFrame, self_join: bool = False,
                     materialize: bool = True) -> DataFrame:
    """Distinct pairs ``(lid, rid)`` of ``(id, tokens)`` tables that can score 0.6; see :func:`token_similarity_pairs`."""
    if not (self_join and materialize):
        return _candidates(*ranked_sets(left, right, self_join, materialize), self_join)
    sets = _numbered(left)
    ids = sets.select("n", "id")
    pairs = _self_candidates(_signed(sets)).join(ids.toDF("a", "l"), "a").join(ids.toDF("b", "r"), "b").filter("l <> r")
    return pairs.select(F.greatest("l", "r").alias("lid"), F.least("l", "r").alias("rid"))


def _candidates(l: DataFrame, r: DataFrame, self_join: bool) -> DataFrame:
    """:func:`token_candidates` of ranked sets."""
    swapped = _contained_candidates(r, l).select(F.col("rid").alias("lid"), F.col("lid").alias("rid"))
    if self_join:
        contained = swapped.select(F.greatest("lid", "rid").alias("lid"), F.least("lid", "rid").alias("rid"))
    else:
        contained = _contained_candidates(l, r).unionByName(swapped)
    # sizes keep the two kinds apart, so no pair comes twice
    jaccard = _overlap_candidates(l, r, lambda a, b: F.ceil((a + b) * 3 / 8), TOKEN_THRESHOLD,
                                  F.col("rid") < F.col("lid") if self_join else None)
    return jaccard.unionByName(contained)


def candidate_rounds(load: float, rows: float) -> int:
    """Rounds that keep the load of one (joined rows, or bytes that move) within ROUND_ROWS times the prefix rows: it may grow
    with the square of the sets, the disk of a round then grows with the sets only."""
    return max(1, math.ceil((load or 0) / max(ROUND_ROWS * (rows or 0), LEAST_ROUND)))


def _met_rows(l: DataFrame, r: DataFrame) -> tuple[float, float]:
    """Joined rows of two ranked tables before sizes and positions are compared, and the prefix rows of both."""
    prefix = F.col("pos") <= _base(TOKEN_THRESHOLD) + F.col("len")
    count = lambda df: df.filter(prefix).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    met = count(l).join(count(r).withColumnRenamed("n", "m"), "tok").select((F.col("n") * F.col("m")).alias("met"), (F.col("n") + F.col("m")).alias("rows"))
    total = met.agg(F.sum("met").cast("double").alias("met"), F.sum("rows").alias("rows")).first()
    return total["met"], total["rows"]


# A table with itself: prefix rows meet in Arrow kernels, no joined row is written (see set_sketch).
def _numbered(sets: DataFrame) -> DataFrame:
    """The sets landed with a number ``n`` for each row; ids may repeat."""
    return land_table(sets.withColumn("n", F.monotonically_increasing_id()))


def _signed(sets: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Signatures of the numbered sets, of those in ``kept`` (``n``) if given: size, sketch, rarest tokens."""
    spark = sets.sparkSession
    hashed = sets.select("n", F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))
    with dropped_shuffles(spark):
        # one row per hash bucket at most, a fixed number of them
        counted = hashed.select("h").mapInArrow(S.count_buckets, S.COUNTS).groupBy("bucket").agg(F.sum("n").alias("n"))
        cls = F.least(F.lit(S.CLASSES - 1), F.ceil(F.log2("n") * S.STEPS)).cast("byte")
        got = counted.filter("n > 1").select("bucket", cls.alias("cls")).toArrow()
    table = np.zeros(1 << S.BUCKET_BITS, np.uint8)
    table[got["bucket"].to_numpy()] = got["cls"].to_numpy()
    shared = spark.sparkContext.broadcast(table)
    signed = hashed.mapInArrow(S.sign_sets(lambda: shared.value, LONG_POSTINGS * POSTING_ROWS), S.SIGNED)
    out = land_table(signed if kept is None else signed.join(kept, "n", "left_semi"))
    shared.destroy()
    return out


def _deal_labels(spark, parts: int) -> list[int]:
    """Numbers that a hash partitioning of this many parts deals to part 0, 1, ..."""
    rows = spark.range(20 * parts).select(F.col("id").cast("int").alias("v")).select("v", F.pmod(F.hash("v"), F.lit(parts)).alias("p")).toArrow()
    found = dict(zip(rows["p"].to_pylist(), rows["v"].to_pylist(), strict=True))
    return [found.get(p, p) for p in range(parts)]


def _self_candidates(signed: DataFrame) -> DataFrame:
    """Distinct pairs of numbers ``a, b`` whose sets can score 0.6, and the score ``at_most`` that their sketches allow.

    Prefix rows are dealt by token over parts, a set's rows of one part with one copy of its sketch, in rounds
    of whole parts (see :func:`candidate_rounds`).
    """
    spark = signed.sparkSession
    with dropped_shuffles(spark):
        entries = signed.agg(F.sum(F.size("keys"))).first()[0] or 0
        parts = max(1, math.ceil(entries / PART_ENTRIES))
        moved = F.least(F.size("keys"), F.lit(parts)) * (F.length("sketch") + 24) + 8 * F.size("keys")
        load = signed.agg(F.sum(moved)).first()[0]
    rounds = candidate_rounds(load, entries)
    each = math.ceil(parts / rounds)
    labels = _deal_labels(spark, each)
    labels = [labels[p // rounds] for p in range(each * rounds)]
    done = [land_table(signed.mapInArrow(S.deal_entries(each * rounds, rounds, k, labels), S.DEALT).repartition(each, "deal")
                       .mapInArrow(S.meet_entries, S.MET).distinct()) for k in range(rounds)]
    return land_table(functools.reduce(DataFrame.unionByName, done).distinct()) if rounds > 1 else done[0]


def _self_pairs(sets: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """:func:`token_similarity_pairs` of numbered sets with themselves."""
    signed = _signed(sets)
    cand = _self_candidates(signed)
    done = _verified_rounds(cand, _met_sets(sets, cand), signed)
    return done.select(F.col("lid").alias(left_id), F.col("rid").alias(right_id), "inter", "score")


def _met_sets(sets: DataFrame, cand: DataFrame) -> DataFrame:
    met = cand.select(F.explode(F.array("a", "b")).alias("n")).distinct()
    return land_table(sets.select("n", "id", "tokens").join(met, "n", "left_semi"))  # only the sets that are met move


def _verified_rounds(pairs: DataFrame, met: DataFrame, signed: DataFrame) -> DataFrame:
    """``lid, rid, inter, score`` of the landed pairs of numbers that score 0.6, the greater id at the left."""
    with dropped_shuffles(signed.sparkSession):
        size = signed.agg(F.sum(F.size("keys")).alias("entries"), F.avg("sz").alias("sz")).first()
        n = candidate_rounds(pairs.count() * 16 * (size["sz"] or 0), size["entries"])

    def verified(some: DataFrame) -> DataFrame:
        both = some.select("a", "b").join(met.toDF("a", "lid", "lt"), "a").join(met.toDF("b", "rid", "rt"), "b").filter("lid <> rid")
        return _scored(both, F.greatest("lid", "rid").alias("lid"), F.least("lid", "rid").alias("rid"))

    done = [land_table(verified(pairs.filter(F.pmod(F.hash("a"), F.lit(n)) == k) if n > 1 else pairs)) for k in range(n)]
    return functools.reduce(DataFrame.unionByName, done)


def _best_of_self(sets: DataFrame, kept: DataFrame) -> DataFrame:
    """Best earlier partner ``lid, rid, score`` of the numbered sets in ``kept``, as :func:`best_match` of all pairs.

    A set's candidates are verified from those on that can score most, in BEST_STEPS; after each, those that cannot
    beat the best partner found go unverified, so a cluster of near copies does not have all its pairs verified.
    """
    signed = _signed(sets, kept)
    cand = _self_candidates(signed)
    ids = sets.select("n", "id").join(kept, "n", "left_semi")
    named = cand.join(ids.toDF("a", "l"), "a").join(ids.toDF("b", "r"), "b").filter("l <> r").select(
        "a", "b", "at_most", F.greatest("l", "r").alias("lid"), F.least("l", "r").alias("rid"))
    place = F.row_number().over(Window.partitionBy("lid").orderBy(F.desc("at_most"), "rid"))
    left, met = land_table(named.withColumn("place", place)), _met_sets(sets, cand)
    best = _verified_rounds(left.filter(F.col("place") <= BEST_STEPS[0]), met, signed)
    for least, most in zip(BEST_STEPS, (*BEST_STEPS[1:], None), strict=True):
        best = best_match(best, "lid", "rid")
        known = best.toDF("lid", "_r", "_s")
        beats = F.col("_s").isNull() | (F.col("at_most") > F.col("_s")) | ((F.col("at_most") == F.col("_s")) & (F.col("rid") < F.col("_r")))
        left = land_table(left.filter(F.col("place") > least).join(known, "lid", "left").filter(beats).drop("_r", "_s"))
        if left.isEmpty():
            break
        step = left if most is None else left.filter(F.col("place") <= most)
        best = best.unionByName(_verified_rounds(step, met, signed).drop("inter"))
    return best_match(best, "lid", "rid")


def _scored(pairs: DataFrame, left_id: Column, right_id: Column) -> DataFrame:
    """Pairs of sets ``lt``, ``rt`` that score 0.6: the ids, ``inter`` and ``score``."""
    inter = F.size(F.array_intersect("lt", "rt"))
    ls, rs = F.size("lt"), F.size("rt")
    jacc = inter.cast("double") / (ls + rs - inter).cast("double")
    score = jacc + F.when(inter == F.least(ls, rs), F.lit(CONTAINMENT_BONUS)).otherwise(F.lit(0.0))
    return pairs.select(left_id, right_id, inter.alias("inter"), score.alias("score")).filter(F.col("score") >= F.lit(TOKEN_THRESHOLD))


def token_similarity_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                           left_tokens: str = "tokens", right_tokens: str = "tokens",
                           self_join: bool = False, materialize: bool = True) -> DataFrame:
    """All pairs with token score >= 0.6: ``(left_id, right_id, inter, score)``.

    score = |a&b| / |a|b| + 0.1 if one set contains the other. A pair passes with a Jaccard of
    0.6, or with 0.5 if one set contains the other. Candidates (lossless) come from equi-joins
    on prefixes of the sets in one global frequency order: extended prefixes with a per-set
    extension for the first kind, the rarest tokens of the small set for the second. Posting lists
    of hot tokens are split over tasks. Candidates are verified with ``array_intersect``.
    With ``materialize`` the left sets go in rounds (see :func:`candidate_rounds`), each of which lands
    its candidates and its verified pairs.
    With ``self_join`` both sides are the same table and only ``right_id < left_id`` pairs
    are produced; with ``materialize`` too, prefix rows meet by :func:`_self_candidates`. Empty token sets never pair.
    """
    def sets(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.col(tokens).alias("tokens")).filter(F.size("tokens") > 0)

    l = sets(left, left_id, left_tokens)
    if self_join and materialize:
        return _self_pairs(_numbered(l), left_id, right_id)
    r = l if self_join else sets(right, right_id, right_tokens)

    def verified(cand: DataFrame) -> DataFrame:
        ver = (cand.join(l.select(F.col("id").alias("lid"), F.col("tokens").alias("lt")), "lid")
               .join(r.select(F.col("id").alias("rid"), F.col("tokens").alias("rt"))
                     .join(cand.select("rid"), "rid", "left_semi"), "rid"))  # only the sets that are met move
        return _scored(ver, F.col("lid").alias(left_id), F.col("rid").alias(right_id))

    lrows, rrows = ranked_sets(l, r, self_join, materialize)
    if not materialize:
        return verified(_candidates(lrows, rrows, self_join))
    n = candidate_rounds(*_met_rows(lrows, rrows))
    of_round = lambda k: lrows.filter(F.pmod(F.hash("id"), F.lit(n)) == k) if n > 1 else lrows
    # candidates land first: then their size tells how to join them with the sets
    done = [land_table(verified(land_table(_candidates(of_round(k), rrows, self_join)))) for k in range(n)]
    return functools.reduce(DataFrame.unionByName, done)


def best_match(pairs: DataFrame, left_id: str, right_id: str, score: str = "score") -> DataFrame:
    """Top-1 per left id by score desc, ties by the smallest right id.

    One aggregation with ``min_by`` on a struct key (partial aggregation, no window).
    """
    best = pairs.groupBy(left_id).agg(
        F.min_by(F.struct(F.col(right_id).alias("_r"), F.col(score).alias("_s")),
                 F.struct(-F.col(score), F.col(right_id))).alias("_b"))
    return best.select(left_id, F.col("_b._r").alias(right_id), F.col("_b._s").alias(score))


def best_earlier_match(docs: DataFrame, id_col: str, tokens: str = "tokens",
                       match_col: str = "match_id", materialize: bool = True) -> DataFrame:
    """Best earlier partner of every set by token score (>= 0.6), ties by smallest id:
    ``(id, match_id, score)``.

    Exact copies are collapsed first: identical sets score 1.1, the maximum, and only tie
    with each other, so every copy's answer is the smallest id of its group (when that is
    earlier) and only one representative per distinct set enters the similarity join. A
    group of copies holding a large share of the rows therefore costs one hash
    aggregation, not a quadratic number of candidate pairs.
    """
    # generated columns: a filter on the sets or hashes does not compute them again below
    s = docs.select(F.col(id_col).alias("_id"), F.explode(F.array(tokens)).alias("_t")).filter(F.size("_t") > 0)
    s = s.select("_id", F.inline(F.array(F.struct("_t", F.sha2(F.array_join(F.sort_array("_t"), " "), 256).alias("_h")))))
    if materialize:
        s = _numbered(s.toDF("id", "tokens", "_h"))  # the sets are made and written once
        ids = s.select(F.col("id").alias("_id"), "_h", "n")
        first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n")))
        groups = ids.groupBy("_h").agg(first.alias("_f")).select("_h", F.col("_f._id").alias("_rep"), F.col("_f.n").alias("_n"))
        best = _best_of_self(s, groups.select(F.col("_n").alias("n"))).toDF("_id", "_m", "score")
    else:
        ids = s.select("_id", "_h")
        groups = ids.groupBy("_h").agg(F.min("_id").alias("_rep"))
        reps = s.join(groups, "_h").filter(F.col("_id") == F.col("_rep")).select("_id", "_t")
        best = best_match(token_similarity_pairs(reps, reps, "_id", "_m", "_t", "_t", self_join=True, materialize=False), "_id", "_m")
    copies = ids.join(groups, "_h").filter(F.col("_id") != F.col("_rep")).select(
        F.col("_id").alias(id_col), F.col("_rep").alias(match_col),
        F.lit(1.0 + CONTAINMENT_BONUS).alias("score"))
    best = best.select(F.col("_id").alias(id_col), F.col("_m").alias(match_col), "score")
    return best.unionByName(copies)


def match_tokens(names: DataFrame, universe: DataFrame, name: str = "name", norm: str = "norm",
                 stopwords=STOPWORDS, materialize: bool = True) -> DataFrame:
    """Best universe entry per name by token score (>= 0.6): ``(name, canon, score)``.

    Ties: the smallest universe entry. Names with an empty token set get no row here.
    """
    n = names.select(F.col(name).alias("_n")).distinct().withColumn(
        "tokens", token_set(F.col("_n"), stopwords, normalized=True))
    u = universe.select(F.col(norm).alias("_u")).distinct().withColumn(
        "tokens", token_set(F.col("_u"), stopwords, normalized=True))
    pairs = token_similarity_pairs(n, u, "_n", "_u", materialize=materialize)
    best = best_match(pairs, "_n", "_u")
    return best.select(F.col("_n").alias(name), F.col("_u").alias("canon"), "score")


# --- J7: string similarity -------------------------------------------------------------------
def sequence_ratio(threshold: float):
    """Arrow UDF (cand, name): difflib ratio with the name as the second sequence (as
    ``get_close_matches``); pairs whose cheap upper bounds miss ``threshold`` get 0.0."""
    @F.pandas_udf(T.DoubleType())
    def ratio(cand: pd.Series, name: pd.Series) -> pd.Series:
        out = [0.0] * len(cand)
        sm = difflib.SequenceMatcher()
        # the second sequence is indexed once per name
        for i in sorted(range(len(name)), key=lambda k: name.iloc[k]):
            if sm.b != name.iloc[i]:
                sm.set_seq2(name.iloc[i])
            sm.set_seq1(cand.iloc[i])
            if sm.real_quick_ratio() >= threshold and sm.quick_ratio() >= threshold:
                out[i] = sm.ratio()
        return pd.Series(out, dtype="float64")

    return ratio


QGRAM = 2


def levenshtein_need(length: Column, threshold: float) -> Column:
    """Bigrams that a string of this length shares at least with a match.

    Similarity >= t means lev <= (1-t)*M, M the longer length; one edit spoils at most two
    bigrams, so (M-1) - 2*(1-t)*M remain, which grows with M >= length.
    """
    return F.ceil(length * F.lit(1 - QGRAM * (1 - threshold)) - QGRAM + 1 - 1e-9)


def ratio_need(length: Column, threshold: float) -> Column:
    """Bigrams that a string of this length shares at least with a match.

    Ratio 2M/(a+b) >= t: M characters match in order, at most a+b-2M gaps split them, so
    3M - (a+b) - 1 >= (1.5t-1)(a+b) - 1 adjacent pairs stay; a+b >= 2*length/(2-t).
    """
    return F.ceil(length * F.lit((1.5 * threshold - 1) * 2 / (2 - threshold)) - 1 - 1e-9)


def _qgram_rows(df: DataFrame, col: str, need) -> DataFrame:
    """``(_s, _l, g, need)``: the bigrams of each string made unique by occurrence number
    (so sets behave as multisets), and the overlap a match needs at least."""
    base = df.select(F.col(col).alias("_s"))
    s = F.col("_s")
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - QGRAM + 1), lambda i: F.substring(s, i, QGRAM))
    uniq = F.transform(grams, lambda g, i: F.concat(
        g, F.lit("\u0000"), F.size(F.filter(F.slice(grams, 1, i), lambda h: h == g)).cast("string")))
    base = base.select("_s", F.length(s).alias("_l"), need(F.length(s)).alias("need"),
                       F.when(F.length(s) >= QGRAM, uniq).otherwise(F.array().cast("array<string>")).alias("_g"))
    return base.select("_s", "_l", "need", F.explode_outer("_g").alias("g"))


def _character_rows(df: DataFrame) -> DataFrame:
    """``id, sz, tok``: the characters of each string, made unique by occurrence number."""
    s = F.col("id")
    chars = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, 1))
    numbered = F.transform("_c", lambda c, i: F.concat(
        c, F.lit("\u0000"), F.size(F.filter(F.slice("_c", 1, i), lambda d: d == c)).cast("string")))
    rows = df.select("id", chars.alias("_c")).select("id", numbered.alias("_k"))
    return rows.select("id", F.inline(F.transform("_k", lambda k: F.struct(k.alias("tok"), F.size("_k").alias("sz")))))


def string_candidates(names: DataFrame, universe: DataFrame, need, common, share: float) -> DataFrame:
    """Pairs ``(_n, _u, _ln, _lu)`` that can match.

    Strings with a positive ``need`` keep their ``|G| - need + 1`` rarest bigrams (one global
    frequency order); two such strings can only match if those prefixes share a bigram
    (equi-join). Where either string is too short for a positive bound (or the threshold too
    low), the pair is found by its characters: a match has ``common(ln, lu)`` of them in common, at least ``share`` of
    either string, so extended prefixes of the rarest characters share several (as for token
    sets). Lossless at every threshold.
    """
    nr = _qgram_rows(names.select("_n"), "_n", need).withColumn("side", F.lit("n"))
    ur = _qgram_rows(universe.select("_u"), "_u", need).withColumn("side", F.lit("u"))
    rows = nr.unionByName(ur)
    freq = rows.filter(F.col("g").isNotNull()).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("side", "_s").orderBy("df", "g")
    ranked = rows.filter(F.col("need") >= 1).join(freq, "g").withColumn("pos", F.row_number().over(w))
    n_grams = F.col("_l") - QGRAM + 1
    pref = ranked.filter(F.col("pos") <= n_grams - F.col("need") + 1)
    lp = pref.filter(F.col("side") == "n").select(F.col("_s").alias("_n"), F.col("_l").alias("_ln"), "g")
    rp = pref.filter(F.col("side") == "u").select(F.col("_s").alias("_u"), F.col("_l").alias("_lu"), "g")
    possible = common(F.col("_ln"), F.col("_lu")) <= F.least("_ln", "_lu")
    blocked = lp.join(rp, "g").filter(possible).select("_n", "_u").distinct()
    nc = _character_rows(names.select(F.col("_n").alias("id")))
    uc = _character_rows(universe.select(F.col("_u").alias("id")))
    chars = nc.unionByName(uc).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    short = lambda c: need(F.length(c)) < 1
    by_chars = _overlap_candidates(_ranked(nc, chars, share), _ranked(uc, chars, share), common, share, short("lid") | short("rid"))
    pairs = blocked.unionByName(by_chars.select(F.col("lid").alias("_n"), F.col("rid").alias("_u")))
    return pairs.withColumns({"_ln": F.length("_n"), "_lu": F.length("_u")})


def match_strings(names: DataFrame, universe: DataFrame, name: str = "name", norm: str = "norm",
                  method: str = "ratio", threshold: float = STRING_THRESHOLD) -> DataFrame:
    """Best universe entry per name by string similarity >= threshold: (name, canon, score).

    ``ratio``: the sequence-matcher ratio; only pairs with 2*min/(la+lb) >= threshold can
    pass, which bounds lengths to [t/(2-t), (2-t)/t]. Ties -> greatest entry.
    ``levenshtein``: 1 - lev/max(la, lb), lengths within [t, 1/t], native thresholded
    distance. Ties -> greatest entry.
    """
    n = names.select(F.col(name).alias("_n")).distinct().filter(F.length("_n") > 0)
    u = universe.select(F.col(norm).alias("_u")).distinct().filter(F.length("_u") > 0)
    if method == "ratio":
        # t <= 2M/(a+b) with M characters in common, and M <= the shorter length
        pairs = string_candidates(n, u, lambda l: ratio_need(l, threshold),
                                  lambda a, b: F.ceil((a + b) * (threshold / 2) - 1e-9), threshold / (2 - threshold))
        scored = pairs.withColumn("score", sequence_ratio(threshold)(F.col("_u"), F.col("_n")))
    elif method == "levenshtein":
        # at most (1-t)max(a,b) edits leave t*max(a,b) characters in place
        pairs = string_candidates(n, u, lambda l: levenshtein_need(l, threshold),
                                  lambda a, b: F.ceil(F.greatest(a, b) * threshold - 1e-9), threshold)
        mx = F.greatest(F.col("_ln"), F.col("_lu"))
        k = F.floor(mx * F.lit(1 - threshold) + 1e-9).cast("int")
        d = F.call_function("levenshtein", F.col("_n"), F.col("_u"), k)
        scored = pairs.withColumn("score", F.when(d >= 0, F.lit(1.0) - d / mx).otherwise(F.lit(0.0)))
    else:
        raise ValueError(method)
    hits = scored.filter(F.col("score") >= F.lit(threshold)).select("_n", "_u", "score")
    best = hits.groupBy("_n").agg(
        F.max_by(F.struct("_u", "score"), F.struct("score", "_u")).alias("_b"))
    return best.select(F.col("_n").alias(name), F.col("_b._u").alias("canon"),
                       F.col("_b.score").alias("score"))


# --- J8 --------------------------------------------------------------------------------------
STAGES = ("rules", "exact", "tokens", "strings")


def canonicalize(names: DataFrame, universe: DataFrame, name: str = "name", norm: str = "norm",
                 rules: Sequence[tuple[str, str]] = ALIAS_RULES, stages: Sequence[str] = STAGES,
                 string_method: str = "ratio", stopwords=STOPWORDS,
                 materialize: bool = True) -> DataFrame:
    """Canonical form of every distinct normalised name: ``(name, canon, stage)``.

    The distinct names feed five branches (rules, exact, residual, final join); with
    ``materialize`` they, the distinct universe, the residual of the cheap stages and the token
    matches are computed once and checkpointed in the shared folder, so no input is
    scanned and no stage computed twice; an empty residual ends the work there.

    Precedence rules -> exact -> tokens -> strings -> unchanged. The cheap stages see
    every distinct name; the token and string stages only the names the cheap stages left
    (and only those with a non-empty token set: an empty one skips both and stays
    unchanged). Each stage is computed once and the winner per name is one ``min_by`` on
    the stage rank, so no stage result is recomputed for a residual. An empty name maps to
    "". Output of a stage is not fed back to the rules.
    """
    d = names.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct()
    u = universe.select(F.col(norm).alias("norm")).distinct()
    if materialize:
        d, u = cut_lineage(d), cut_lineage(u)
    cands, cheap = [], []
    if "rules" in stages:
        r = d.select("name", match_rules(F.col("name"), rules).alias("canon"))
        r = r.filter(F.col("canon").isNotNull() & (F.col("name") != ""))
        cands.append(r.select("name", "canon", F.lit(1).alias("rank"), F.lit("rules").alias("stage")))
        cheap.append(r.select("name"))
    if "exact" in stages:
        e = match_exact(d, u, "name", "norm")
        cands.append(e.select("name", "canon", F.lit(2).alias("rank"), F.lit("exact").alias("stage")))
        cheap.append(e.select("name"))
    rest = d
    if cheap:
        done = cheap[0]
        for c in cheap[1:]:
            done = done.unionByName(c)
        rest = d.join(done, "name", "left_anti")
    rest = rest.filter(F.size(token_set(F.col("name"), stopwords, normalized=True)) > 0)
    if materialize and ("tokens" in stages or "strings" in stages):
        rest = cut_lineage(rest)
        if rest.isEmpty():  # nothing is left for the costly stages
            stages = [s for s in stages if s not in ("tokens", "strings")]
    if "tokens" in stages:
        t = match_tokens(rest, u, "name", "norm", stopwords, materialize)
        if materialize:
            t = cut_lineage(t)  # read by the winner and by the residual of the string stage
        cands.append(t.select("name", "canon", F.lit(3).alias("rank"), F.lit("tokens").alias("stage")))
    if "strings" in stages:
        # the residual of the token stage only
        left = rest.join(t.select("name"), "name", "left_anti") if "tokens" in stages else rest
        st = match_strings(left, u, "name", "norm", string_method)
        cands.append(st.select("name", "canon", F.lit(4).alias("rank"), F.lit("strings").alias("stage")))
    out = d.select("name", F.col("name").alias("canon"), F.lit("unchanged").alias("stage"))
    if cands:
        allc = cands[0]
        for c in cands[1:]:
            allc = allc.unionByName(c)
        best = allc.groupBy("name").agg(F.min_by(F.struct("canon", "stage"), "rank").alias("_b"))
        out = d.join(best, "name", "left").select(
            "name", F.coalesce(F.col("_b.canon"), F.col("name")).alias("canon"),
            F.coalesce(F.col("_b.stage"), F.lit("unchanged")).alias("stage"))
    return out.withColumnRenamed("name", name)
