"""Record-level projections, filters and reshaping (all built-in column expressions)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelset.functions.text import coalesce_truthy, normalize_text

UNKNOWN_MODEL = "unknown_model"
RUN_COLUMNS = ("_source_file", "model", "model_label", "scenario_id", "condition",
               "total_tokens", "prompt_tokens", "completion_tokens", "latency_s", "request_id")
MIN_RUN_COLUMNS = {"latency_s": "double", "total_tokens": "double", "prompt_tokens": "double",
                   "completion_tokens": "double", "model": "string", "scenario_id": "string",
                   "condition": "string", "request_id": "string", "_source_file": "string"}
ID_FIELDS = ("scenario_id", "scenario", "id", "slug", "name")
NESTED_ID_FIELDS = ("id", "slug", "name")
NAME_FIELDS = ("kpi", "nome", "metric", "name")


# --- P1: case-insensitive lookup ---------------------------------------------------------
def get_ci(m: Column, key: str) -> Column:
    """Value of the first map entry whose key equals ``key`` ignoring case."""
    hits = F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == F.lit(key.lower()))
    return F.try_element_at(hits, F.lit(1))["value"]


# --- P3/P4: scenario key -------------------------------------------------------------------
def resolve_key(record_map: Column) -> tuple[Column, Column]:
    """(raw, normalised) scenario id of a record given as ``map<string, variant>``.

    The first truthy of scenario_id | scenario | id | slug | name is taken; an object
    yields its first truthy id | slug | name, a string itself, anything else "". A
    non-string choice normalises to "" (the record is then dropped by ``drop_unkeyed``).
    """
    from labelset.functions import replies as RP

    def on_cand(cand):
        inner = F.try_variant_get(cand, "$", "map<string,variant>")
        nested = RP.let(inner, lambda m: RP.first_truthy([RP.entry_last(m, f) for f in NESTED_ID_FIELDS]))
        nested_str = RP.let(nested, lambda n: F.when(RP.kind(n) == "STRING",
                                                     F.try_variant_get(n, "$", "string")))
        return RP.let(RP.kind(cand), lambda k: (
            F.when(k == "OBJECT", F.coalesce(nested_str, F.lit("")))
            .when(k == "STRING", F.try_variant_get(cand, "$", "string"))
            .otherwise(F.lit(""))))

    raw = RP.let(record_map, lambda m: RP.let(
        RP.first_truthy([RP.entry_last(m, k) for k in ID_FIELDS]), on_cand))
    return raw, normalize_text(raw)


def drop_unkeyed(df: DataFrame, key_norm: str = "sid_norm") -> DataFrame:
    """Skip records without a usable key."""
    return df.filter(F.col(key_norm) != "")


def default_model(c: Column) -> Column:
    """Missing or empty model -> ``unknown_model``."""
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(UNKNOWN_MODEL))


# --- P6 / J9: labels -----------------------------------------------------------------------
def map_label(df: DataFrame, col: str, labels: Mapping[str, str], out: str = "model_label",
              default: str | None = None) -> DataFrame:
    """Display label from a fixed map, falling back to the raw value (or ``default``).

    The map is a literal expression: no join, no shuffle.
    """
    m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
    raw = F.col(col) if default is None else F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(default))
    return df.withColumn(out, F.coalesce(F.try_element_at(m, F.col(col)), raw))


def label_lookup(df: DataFrame, labels: DataFrame, col: str, label_col: str = "label",
                 out: str = "model_label") -> DataFrame:
    """Join form of :func:`map_label` for a label table of any size: AQE broadcasts it at run
    time if its measured size is under the threshold."""
    lab = labels.select(F.col(col).alias("_k"), F.col(label_col).alias("_lab"))
    j = df.join(lab, F.col(col) == F.col("_k"), "left")
    return j.withColumn(out, F.coalesce(F.col("_lab"), F.col(col))).drop("_k", "_lab")


# --- P7-P11 ---------------------------------------------------------------------------------
def fill_total(df: DataFrame, total: str = "total_tokens", prompt: str = "prompt_tokens",
               completion: str = "completion_tokens") -> DataFrame:
    """NULL total <- prompt + completion with NULLs as 0."""
    fill = F.coalesce(F.col(prompt), F.lit(0)) + F.coalesce(F.col(completion), F.lit(0))
    return df.withColumn(total, F.coalesce(F.col(total), fill.cast("double")))


def coerce_numeric_col(c: str) -> Column:
    """A column to double whatever its type (strings parsed, unparsable -> NULL)."""
    from labelset.functions.text import coerce_numeric

    return coerce_numeric(F.col(c))


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows where every column is present (NULL and NaN count as missing)."""
    cond = F.lit(True)
    for c in cols:
        x = F.col(c)
        cond = cond & x.isNotNull() & ~F.isnan(x.cast("double"))
    return df.filter(cond)


def finite_only(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for c in cols:
        x = F.col(c).cast("double")
        cond = cond & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return df.filter(cond)


def project_runs(df: DataFrame, cols: Sequence[str] = RUN_COLUMNS) -> DataFrame:
    return df.select(*cols)


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(failed, scored) records."""
    if error not in df.columns:
        return df.limit(0), df
    return df.filter(F.col(error).isNotNull()), df.filter(F.col(error).isNull())


# --- S4 / S5: shape --------------------------------------------------------------------------
def flatten_records(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs -> dotted top-level columns; arrays and maps stay as they are."""
    def walk(dtype: T.DataType, path: list[str]):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield from walk(f.dataType, path + [f.name])
        else:
            yield path

    cols = []
    for f in df.schema.fields:
        for path in walk(f.dataType, [f.name]):
            ref = F.col("`" + path[0] + "`")
            for p in path[1:]:
                ref = ref.getField(p)
            cols.append(ref.alias(sep.join(path)))
    return df.select(*cols)


def ensure_columns(df: DataFrame, columns: Mapping[str, str] = MIN_RUN_COLUMNS) -> DataFrame:
    """Add missing columns as typed NULLs."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


# --- O2 / O4 -----------------------------------------------------------------------------------
def sort_runs(df: DataFrame, keys: Sequence[str] = ("_source_file", "model_label", "scenario_id",
                                                      "condition")) -> DataFrame:
    """Global order by the run keys, NULLs last (range-partitioned sort)."""
    return df.orderBy(*[F.asc_nulls_last(k) for k in keys])


def cap_items(items: Column, limited: Column, n: int = 4) -> Column:
    """First ``n`` items in reply order when the condition is limited."""
    return F.when(limited & (F.size(items) > n), F.slice(items, 1, n)).otherwise(items)


def item_name(item: Column) -> Column:
    """First truthy of kpi | nome | metric | name of a ``map<string,string>`` item."""
    return coalesce_truthy(*[get_ci(item, k) for k in NAME_FIELDS])

