"""Set-retrieval metrics over long (key, item) tables.

Predictions and gold are long DataFrames ``(*keys, item)``. The comparison is one union
and two aggregations, never a per-key collection:

1. tag pred rows ``p`` and gold rows ``g``, union them;
2. ``groupBy(keys + item)`` -> ``max(p), max(g)`` (partial aggregation collapses repeated
   items map-side, so a key holding a third of all rows is reduced before the shuffle and
   spread over partitions by item);
3. ``groupBy(keys)`` -> ``count_if`` of the three cells (again partially aggregated).

``TN`` comes from the universe size, taken as a scalar subquery (or per universe key
through an equi-join), so no cross join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT_COLS = ("tp", "fp", "fn", "tn")
METRIC_COLS = ("precision", "recall", "f1", "denom", "mcc", "npv", "fdr")


def _as_list(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def collect_predictions(records: DataFrame, keys: Sequence[str], item: str = "item") -> DataFrame:
    """Union of items over all records of a key: distinct ``(keys, item)`` rows."""
    keys = _as_list(keys)
    return records.select(*keys, item).filter(F.col(item).isNotNull()).distinct()


def seen_keys(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys that occur in the records, with or without items."""
    keys = _as_list(keys)
    return records.select(*keys).distinct()


def first_raw_key(records: DataFrame, keys: Sequence[str], raw: str, pos: str) -> DataFrame:
    """First raw spelling per normalised key, by record position."""
    keys = _as_list(keys)
    return records.groupBy(*keys).agg(F.min_by(F.col(raw), F.col(pos)).alias(raw))


def in_universe(df: DataFrame, universe: DataFrame, item: str = "item", norm: str = "norm",
                universe_keys: Sequence[str] = ()) -> DataFrame:
    """Keep rows whose item is a member of the universe (hash semi join).

    The universe is not hinted for broadcast: its size is data-dependent, so AQE decides
    at run time from measured sizes (``spark.sql.autoBroadcastJoinThreshold``).
    """
    ukeys = _as_list(universe_keys)
    u = universe.select(*ukeys, F.col(norm).alias(item))
    return df.join(u, [*ukeys, item], "left_semi")


def universe_size(universe: DataFrame, norm: str = "norm") -> Column:
    """|U| as a scalar subquery (evaluated once, inlined as a literal)."""
    return universe.select(F.count_distinct(F.col(norm))).scalar()


def attach_gold(seen: DataFrame, gold: DataFrame, gold_keys: Sequence[str]) -> DataFrame:
    """Replicate gold ``(gold_keys, item)`` onto every seen key that shares ``gold_keys``."""
    return seen.join(gold, _as_list(gold_keys), "inner")


def skipped_keys(seen: DataFrame, gold: DataFrame, gold_keys: Sequence[str]) -> DataFrame:
    """Seen keys without any gold item (``NOT EXISTS``)."""
    gk = _as_list(gold_keys)
    return seen.join(gold.select(*gk), gk, "left_anti")


def evaluated_keys(seen: DataFrame, gold: DataFrame, gold_keys: Sequence[str]) -> DataFrame:
    """Seen keys with at least one gold item (``EXISTS``)."""
    gk = _as_list(gold_keys)
    return seen.join(gold.select(*gk), gk, "left_semi")


def set_confusion(pred: DataFrame, gold: DataFrame, keys: Sequence[str], item: str = "item",
                  universe: DataFrame | None = None, universe_norm: str = "norm",
                  universe_keys: Sequence[str] = (), universe_size_col: Column | None = None
                  ) -> DataFrame:
    """TP, FP, FN, TN per evaluated key from separate pred and gold tables.

    ``pred`` and ``gold`` are ``(*keys, item)`` with duplicates allowed; gold must already
    be attached to the keys (see :func:`attach_gold`).
    """
    keys = _as_list(keys)
    p = pred.select(*keys, F.col(item).alias("item"), F.lit(True).alias("p"), F.lit(False).alias("g"))
    g = gold.select(*keys, F.col(item).alias("item"), F.lit(False).alias("p"), F.lit(True).alias("g"))
    return confusion_from_cells(p.unionByName(g), keys, "item", "p", "g", universe, universe_norm,
                                universe_keys, universe_size_col)


def confusion_from_cells(cells: DataFrame, keys: Sequence[str], item: str = "item",
                         p: str = "p", g: str = "g", universe: DataFrame | None = None,
                         universe_norm: str = "norm", universe_keys: Sequence[str] = (),
                         universe_size_col: Column | None = None) -> DataFrame:
    """TP, FP, FN, TN per evaluated key from one tagged table ``(*keys, item, p, g)``.

    ``p`` / ``g`` say whether a row puts the item in the predicted / gold set of its key;
    an item may occur in many rows. Items outside the universe are dropped on both sides.
    A key is evaluated when it has at least one gold item; such a key with no prediction
    still gets a row (all its gold items are FN).
    TN = max(|U| - TP - FP - FN, 0), |U| per ``universe_keys`` when given.
    """
    keys = _as_list(keys)
    ukeys = _as_list(universe_keys)
    cells = cells.select(*keys, F.col(item).alias("item"), F.col(p).alias("p"), F.col(g).alias("g"))
    cells = cells.filter((F.col("p") | F.col("g")) & F.col("item").isNotNull())
    if universe is not None:
        cells = in_universe(cells, universe, "item", universe_norm, ukeys)
    per_item = cells.groupBy(*keys, "item").agg(F.max("p").alias("p"), F.max("g").alias("g"))
    conf = (per_item.groupBy(*keys)
            .agg(F.count_if(F.col("p") & F.col("g")).alias("tp"),
                 F.count_if(F.col("p") & ~F.col("g")).alias("fp"),
                 F.count_if(~F.col("p") & F.col("g")).alias("fn"))
            .filter((F.col("tp") + F.col("fn")) > 0))
    if ukeys:
        sizes = (universe.groupBy(*ukeys)
                 .agg(F.count_distinct(F.col(universe_norm)).alias("_usize")))
        conf = conf.join(sizes, ukeys, "left")
        size = F.coalesce(F.col("_usize"), F.lit(0))
    elif universe_size_col is not None:
        size = universe_size_col
    elif universe is not None:
        size = universe_size(universe, universe_norm)
    else:
        raise ValueError("set_confusion needs a universe or universe_size_col for TN")
    conf = conf.withColumn(
        "tn", F.greatest(size.cast("long") - F.col("tp") - F.col("fp") - F.col("fn"),
                         F.lit(0).cast("long")))
    return conf.drop("_usize")


def metric_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """The seven metrics; every zero denominator gives 0.0, never NULL."""
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    zero = F.lit(0.0)
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(zero)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(zero)
    f1 = F.when(precision + recall > 0,
                (F.lit(2.0) * precision * recall) / (precision + recall)).otherwise(zero)
    # each factor is a double: a bigint product overflows on large universes
    denom = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when(denom > 0, (tp * tn - fp * fn) / F.sqrt(denom)).otherwise(zero)
    npv = F.when(tn + fn > 0, tn / (tn + fn)).otherwise(zero)
    fdr = F.when(tp + fp > 0, fp / (tp + fp)).otherwise(zero)
    return {"precision": precision, "recall": recall, "f1": f1, "denom": denom,
            "mcc": mcc, "npv": npv, "fdr": fdr}


def set_metrics(conf: DataFrame) -> DataFrame:
    """Add precision, recall, f1, denom, mcc, npv, fdr to a confusion table."""
    cols = metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return conf.withColumns(cols)


def macro_average(metrics: DataFrame, group_cols: Sequence[str],
                  groups: DataFrame | None = None) -> DataFrame:
    """Mean of the seven metrics over evaluated keys per group, plus the evaluated count.

    ``groups`` lists every group that must appear (a group with no evaluated key gets
    0.0 everywhere, as a report with zero scenarios does).
    """
    group_cols = _as_list(group_cols)
    agg = metrics.groupBy(*group_cols).agg(
        *[F.avg(m).alias(m) for m in METRIC_COLS], F.count(F.lit(1)).alias("evaluated"))
    if groups is None:
        return agg
    out = groups.select(*group_cols).distinct().join(agg, group_cols, "left")
    return out.select(*group_cols,
                      *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in METRIC_COLS],
                      F.coalesce(F.col("evaluated"), F.lit(0)).cast("long").alias("evaluated"))


def totals(metrics: DataFrame, group_cols: Sequence[str], skipped: DataFrame | None = None,
           groups: DataFrame | None = None, seen_counts: DataFrame | None = None) -> DataFrame:
    """Sum of TP, FP, FN, TN per group, evaluated and skipped counts.

    Skipped keys stay a long table (:func:`skipped_keys`); here only their number. With
    ``seen_counts`` (``group_cols, n_seen``) the number is ``n_seen - evaluated``, which
    needs no anti join against the (expensive) evaluated keys.
    """
    group_cols = _as_list(group_cols)
    if seen_counts is not None:
        agg = metrics.groupBy(*group_cols).agg(
            *[F.sum(c).alias(c) for c in COUNT_COLS], F.count(F.lit(1)).alias("evaluated"))
        base = seen_counts.select(*group_cols, "n_seen")
        out = base.join(agg, group_cols, "left")
        ev = F.coalesce(F.col("evaluated"), F.lit(0)).cast("long")
        return out.select(*group_cols,
                          *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNT_COLS],
                          ev.alias("evaluated"), (F.col("n_seen").cast("long") - ev).alias("skipped"))
    agg = metrics.groupBy(*group_cols).agg(
        *[F.sum(c).alias(c) for c in COUNT_COLS], F.count(F.lit(1)).alias("evaluated"))
    base = groups.select(*group_cols).distinct() if groups is not None else None
    if skipped is not None:
        sk = skipped.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("skipped"))
        if base is None:
            base = agg.select(*group_cols).unionByName(sk.select(*group_cols)).distinct()
    if base is not None:
        agg = base.join(agg, group_cols, "left")
    if skipped is not None:
        agg = agg.join(sk, group_cols, "left")
    else:
        agg = agg.withColumn("skipped", F.lit(None).cast("long"))
    return agg.select(*group_cols,
                      *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNT_COLS],
                      F.coalesce(F.col("evaluated"), F.lit(0)).cast("long").alias("evaluated"),
                      F.coalesce(F.col("skipped"), F.lit(0)).cast("long").alias("skipped"))


def array_confusion(pred: Column, gold: Column, universe_size_col: Column) -> dict[str, Column]:
    """Array form for small per-key sets (export / reports): sizes of set algebra."""
    tp = F.size(F.array_intersect(pred, gold))
    fp = F.size(F.array_except(pred, gold))
    fn = F.size(F.array_except(gold, pred))
    tn = F.greatest(universe_size_col - tp - fp - fn, F.lit(0))
    return {"tp": tp.cast("long"), "fp": fp.cast("long"), "fn": fn.cast("long"),
            "tn": tn.cast("long")}
