"""The scoring job (X1): result records -> per-key metrics, macro averages, totals.

Plan shape: one scan of the records; distinct item names are canonicalised once (the
costly stages see each distinct name once, not once per record) and joined back; the
universe and gold are joined by key; the comparison is the union-and-aggregate of
:mod:`labelset.operators.metrics`. With ``materialize`` the parsed records and the name map are
written once as checkpoints, which runs jobs inside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelset.functions import replies as RP
from labelset.functions.text import normalize_text_df
from labelset.operators import metrics as M
from labelset.operators.match import ALIAS_RULES, canonicalize
from labelset.operators.records import UNKNOWN_MODEL, resolve_key
from labelset.session import cut_lineage
from labelset.sources.json_docs import record_raw

KEYS = ("source", "model", "sid_norm")
GROUPS = ("source", "model")


@dataclass
class Scores:
    per_key: DataFrame    # source, model, sid_norm, sid_raw, tp..tn, seven metrics
    macro: DataFrame      # source, model, seven averages, evaluated
    totals: DataFrame     # source, model, tp..tn, evaluated, skipped
    skipped: DataFrame    # source, model, sid_norm, sid_raw
    pred: DataFrame       # source, model, sid_norm, item (distinct, in U)
    gold: DataFrame       # source, model, sid_norm, item (gold attached to seen keys)


def record_rows(records: DataFrame) -> DataFrame:
    """``(source, pos, model, sid_raw, sid_norm, names)`` from ``(_source_file, pos,
    record)``: model defaults to ``unknown_model``; names come from ``parsed_items`` or,
    failing that, from the first array in ``output``."""
    m = F.from_json(F.col("record"), "map<string,variant>", RP.STRICT_JSON)
    parsed = record_raw(F.col("record"), "parsed_items")
    base = records.select(F.col("_source_file").alias("source"), "pos", m.alias("_m"),
                          parsed.alias("_parsed"))
    mv = RP.entry_last(F.col("_m"), "model")
    model = RP.let(mv, lambda v: F.when(RP.truthy(v), RP.py_str(v)).otherwise(F.lit(UNKNOWN_MODEL)))
    raw, _ = resolve_key(F.col("_m"))
    ov = RP.entry_last(F.col("_m"), "output")
    output = RP.let(ov, lambda v: F.when(RP.kind(v) == "STRING", F.try_variant_get(v, "$", "string")))
    step = base.select("source", "pos", model.alias("model"), raw.alias("sid_raw"),
                       RP.extract_items(F.col("_parsed"), output).alias("names"))
    return normalize_text_df(step, "sid_raw", "sid_norm").select(
        "source", "pos", "model", "sid_raw", "sid_norm", "names")


def evaluate_runs(records: DataFrame, universe: DataFrame, gold: DataFrame,
                  rules=ALIAS_RULES, string_method: str = "ratio",
                  materialize: bool = True) -> Scores:
    """Score result records against gold over a universe.

    ``records``: ``(_source_file, pos, record)`` (see ``read_results``); ``universe``:
    ``(norm, ...)``; ``gold``: ``(sid_norm, item)`` already canonical and in U.

    The parsed records feed every branch (groups, seen keys, names); with ``materialize``
    they are written once as a reliable checkpoint in the shared checkpoint folder, so the
    JSON is parsed once and a lost executor recomputes from the checkpoint, not the scan.
    """
    rows = record_rows(records)
    if materialize:
        rows = cut_lineage(rows)
    groups = rows.select(*GROUPS).distinct()
    keyed = rows.filter(F.col("sid_norm") != "")
    seen = keyed.groupBy(*KEYS).agg(F.min_by("sid_raw", "pos").alias("sid_raw"))
    names = normalize_text_df(keyed.select(*KEYS, F.explode("names").alias("raw_name")),
                              "raw_name", "name").select(*KEYS, "name")
    cmap = canonicalize(names.select("name"), universe, "name", "norm", rules=rules,
                        string_method=string_method)
    if materialize:
        # one row per distinct name; read by the scores and by report lists
        cmap = cut_lineage(cmap)
    # keep only names whose canonical form is in U: filtered on the distinct-name map,
    # then joined back to the name rows
    kept = M.in_universe(cmap.select("name", "canon"), universe, "canon", "norm")
    pred = names.join(kept, "name").select(*KEYS, F.col("canon").alias("item")).distinct()
    # a gold row becomes a cell of every run that has its key: parts joined up to the advised size by their
    # compressed bytes would hold too many cells for one task, so the session's number of partitions stands
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gold_att = seen.select(*KEYS).join(gold.select("sid_norm", "item").repartition(parts, "sid_norm"), "sid_norm")
    conf = M.set_confusion(pred, gold_att, list(KEYS), "item", universe=universe)
    per_key = M.set_metrics(conf).join(seen, list(KEYS))
    skipped = M.skipped_keys(seen, conf.select(*KEYS), list(KEYS))
    macro = M.macro_average(per_key, list(GROUPS), groups)
    # skipped per group = seen - evaluated (no anti join against the confusion subtree)
    n_seen = seen.groupBy(*GROUPS).agg(F.count(F.lit(1)).alias("n_seen"))
    seen_counts = groups.join(n_seen, list(GROUPS), "left").select(
        *GROUPS, F.coalesce(F.col("n_seen"), F.lit(0)).alias("n_seen"))
    tot = M.totals(per_key, list(GROUPS), seen_counts=seen_counts)
    return Scores(per_key, macro, tot, skipped, pred, gold_att)


def scenario_report(scores: Scores) -> DataFrame:
    """Per evaluated key: metrics plus the sorted predicted and gold lists (the report's
    per-scenario entry), ordered by source, model and normalised key."""
    lists = report_lists(scores.pred, scores.gold)
    rep = scores.per_key.join(lists, list(KEYS), "left")
    empty = F.array().cast("array<string>")
    rep = rep.withColumns({"pred": F.coalesce("pred", empty), "gold": F.coalesce("gold", empty)})
    return rep.orderBy(*KEYS)


def report_lists(pred: DataFrame, gold: DataFrame, keys=KEYS) -> DataFrame:
    """Sorted predicted and gold lists per key, for export next to the metrics.

    Each list is bounded by the universe size; use the long tables for analysis.
    """
    keys = list(keys)
    p = pred.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("pred"))
    g = gold.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("gold"))
    return p.join(g, keys, "full_outer")
