"""Chart tables (X4): macro metrics of the reports, flattened runs, tokens vs latency and
the per-label correlation summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from labelset.operators import records as R
from labelset.operators.regression import regression_summary
from labelset.sources.dimensions import DEFAULT_REPORT_LABEL, MODEL_LABELS, REPORT_FILES, RESULT_FILES
from labelset.sources.json_docs import read_reports, read_runs, results_table

NUMERIC = ("latency_s", "total_tokens", "prompt_tokens", "completion_tokens")


def runs_table(runs: DataFrame, labels: Mapping[str, str] = MODEL_LABELS) -> DataFrame:
    """Typed runs with the minimum columns, total tokens filled and display labels."""
    df = R.ensure_columns(runs)
    df = df.withColumns({c: R.coerce_numeric_col(c) for c in NUMERIC})
    df = R.fill_total(df)
    return R.map_label(df, "model", labels, out="model_label")


def tokens_latency(runs: DataFrame) -> DataFrame:
    """Runs with both measures present (NULL/NaN dropped), run columns only."""
    return R.project_runs(R.drop_missing(runs, ["total_tokens", "latency_s"]))


def corr_summary(tok: DataFrame) -> DataFrame:
    """Latency on total tokens per model label plus the overall row."""
    return regression_summary(tok, "total_tokens", "latency_s", "model_label")


def chart_tables(spark: SparkSession, base_dir: str,
                 report_files: Mapping[str, str] = REPORT_FILES,
                 result_files: Sequence[str] = RESULT_FILES,
                 labels: Mapping[str, str] = MODEL_LABELS) -> dict[str, DataFrame]:
    """The four chart tables; missing files are skipped. Sorting is applied to the
    exported runs and tokens tables (range-partitioned sort, NULLs last)."""
    b = base_dir.rstrip("/")
    macro = read_reports(spark, {run: f"{b}/{f}" for run, f in report_files.items()}, labels,
                         DEFAULT_REPORT_LABEL)
    runs = runs_table(results_table(read_runs(spark, [f"{b}/{f}" for f in result_files])), labels)
    tok = tokens_latency(runs)
    return {"macro": macro, "runs": R.sort_runs(R.project_runs(runs)),
            "tokens_latency": R.sort_runs(tok), "corr_summary": corr_summary(tok)}
