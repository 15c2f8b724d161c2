"""Sinks: scored reports, result records and named sheets.

Writes are distributed (one file per task) and partitioned where a later reader prunes by
a column; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelset.functions.text import sheet_name, slug


# --- S9 --------------------------------------------------------------------------------------
def write_reports(per_key: DataFrame, out_dir: str, source: str = "source",
                  model: str = "model") -> None:
    """Per-key report rows as JSON lines, partitioned by source and model slug, so that a
    reader of one (file, model) report prunes every other partition."""
    df = per_key.withColumn("model_slug", slug(F.col(model)))
    (df.write.mode("overwrite").partitionBy(source, "model_slug").json(out_dir))


_COUNTS = {"TP": "tp", "FP": "fp", "FN": "fn", "TN": "tn"}
_METRICS = ("precision", "recall", "f1", "denom", "mcc", "npv", "fdr")


def _json_text(c: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def write_report_documents(per_key: DataFrame, macro: DataFrame, totals: DataFrame, skipped: DataFrame,
                           out_dir: str) -> None:
    """One report document per (source, model): ``by_scenario``, ``macro_avg``, ``totals``, counts, ``skipped_scenarios``.

    Inputs are the tables of ``evaluate_runs`` (``per_key`` may carry ``pred`` and ``gold`` lists); every row of
    ``macro`` gets a document. A document is written line by line from its sorted rows, one scenario a line, by
    Spark's own text writer and commit: no list of a document's rows is gathered. Folders are
    ``source=/model_slug=/model=``, so models of one slug stay apart.
    """
    def line(df: DataFrame, place: int, sid, text: Column) -> DataFrame:
        return df.select("source", "model", F.lit(place).alias("place"), sid.alias("sid"), text.alias("line"))

    none = F.lit(None).cast("string")
    counts = [F.col(c).alias(n) for n, c in _COUNTS.items()]
    lists = [c for c in ("pred", "gold") if c in per_key.columns]
    entry = F.to_json(F.struct(*counts, *_METRICS, *lists, "sid_norm"))
    open_ = F.concat(F.lit('{"file": '), _json_text(F.col("source")), F.lit(', "model_name": '), _json_text(F.col("model")), F.lit(', "by_scenario": {'))
    whole = macro.select("source", "model", F.to_json(F.struct(*_METRICS)).alias("_avg"), F.col("evaluated").alias("_n")).join(
        totals.select("source", "model", F.to_json(F.struct(*counts)).alias("_sum")), ["source", "model"])
    middle = F.concat(F.lit('}, "macro_avg": '), "_avg", F.lit(', "totals": '), "_sum", F.lit(', "evaluated_scenarios": '),
                      F.col("_n").cast("string"), F.lit(', "skipped_scenarios": ['))
    rows = (line(macro, 0, none, open_)
            .unionByName(line(per_key, 1, F.col("sid_norm"), F.concat(_json_text(F.col("sid_raw")), F.lit(": "), entry)))
            .unionByName(line(whole, 2, none, middle))
            .unionByName(line(skipped, 3, F.col("sid_norm"), _json_text(F.col("sid_raw"))))
            .unionByName(line(macro, 4, none, F.lit("]}"))))
    in_order = Window.partitionBy("source", "model").orderBy("place", "sid")
    comma = F.when(F.lag("place").over(in_order) == F.col("place"), ",").otherwise("")
    (rows.select("source", slug(F.col("model")).alias("model_slug"), "model", F.concat(comma, "line").alias("value"))
     .write.mode("overwrite").partitionBy("source", "model_slug", "model").text(out_dir))


# --- S10 -------------------------------------------------------------------------------------
def write_results(records: DataFrame, out_dir: str) -> None:
    """Persist result records for a run, replacing earlier output."""
    records.write.mode("overwrite").json(out_dir)


# --- S11 -------------------------------------------------------------------------------------
def write_sheets(sheets: Mapping[str, DataFrame], out_dir: str, stem: str,
                 fmt: str = "csv") -> list[str]:
    """Each named DataFrame to ``{out_dir}/{stem}__{name}`` (CSV with header, or Parquet).

    Names stay whole (only path separators become ``_``); two names that lead to one path
    raise before anything is written. Returns the written paths; an empty mapping writes
    nothing.
    """
    safe = {name: _file_name(name) for name in sheets}
    if len({x.casefold() for x in safe.values()}) < len(safe):
        raise ValueError(f"sheet names lead to the same path: {sorted(safe.values())}")
    written = []
    for name, df in sheets.items():
        path = f"{out_dir.rstrip('/')}/{stem}__{safe[name]}"
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(path)
        else:
            w.parquet(path)
        written.append(path)
    return written


def _file_name(name: str) -> str:
    return str(name).replace("/", "_").replace("\\", "_")


__all__ = ["write_report_documents", "write_reports", "write_results", "write_sheets", "sheet_name"]
