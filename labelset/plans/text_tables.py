"""Text functions, numeric coercion, labels and regression on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelset.functions import text as T
from labelset.operators import records as R
from labelset.operators.regression import regression_summary
from labelset.plans.registry import r6, register, table


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_normalize(expr: str) -> str:
    """DuckDB form of ``normalize_text`` (accent strip, drop non-ASCII, lower, squash)."""
    folded = f"regexp_replace(strip_accents({expr}), '[^\\x00-\\x7F]', '', 'g')"
    return f"coalesce(trim(regexp_replace(lower({folded}), '[^a-z0-9]+', ' ', 'g')), '')"


def sql_token_list(norm_expr: str, stopwords=T.STOPWORDS) -> str:
    return (f"list_distinct(list_filter(string_split({norm_expr}, ' '), "
            f"lambda x: x <> '' AND NOT list_contains({_sql_list(stopwords)}, x)))")


@register("normalize_text", sql=f"""
SELECT doc_id, {sql_normalize('text')} AS norm, length({sql_normalize('text')}) AS norm_chars
FROM documents
""")
def q_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = T.normalize_text_df(docs, "text", "norm")
    return out.select("doc_id", "norm", F.length("norm").alias("norm_chars"))


@register("token_set", sql=f"""
WITH n AS (SELECT doc_id, {sql_normalize('text')} AS norm FROM documents),
t AS (SELECT doc_id, norm, {sql_token_list('norm')} AS toks FROM n)
SELECT doc_id,
       len(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS n_words,
       len(toks) AS n_tokens,
       sha256(array_to_string(list_sort(toks), ' ')) AS tokens_sha
FROM t
""")
def q_token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.select("doc_id", T.normalize_text(F.col("text")).alias("norm"))
    toks = T.token_set(F.col("norm"), normalized=True)
    return n.select(
        "doc_id",
        F.size(F.filter(F.split("norm", " "), lambda w: w != "")).alias("n_words"),
        F.size(toks).alias("n_tokens"),
        F.sha2(F.array_join(F.array_sort(toks), " "), 256).alias("tokens_sha"))


_PART_DISPLAY = "concat(p_name, ' (', p_type, ') (', p_brand, ')')"
_CONSTS_SQL = ", ".join(f"('{a}', '{a.upper()}')" for a in T.UNIVERSE_ABBREVIATIONS)


@register("extract_abbreviations", sql=f"""
WITH raw AS (SELECT {_PART_DISPLAY} AS canon FROM part),
ab AS (SELECT unnest(regexp_extract_all(canon, '{T.ABBREVIATION_PATTERN}', 1)) AS canon FROM raw),
allr AS (
  SELECT {sql_normalize('canon')} AS norm, canon FROM raw
  UNION ALL SELECT {sql_normalize('canon')} AS norm, canon FROM ab
  UNION ALL SELECT * FROM (VALUES {_CONSTS_SQL}) v(norm, canon)),
g AS (SELECT norm, min(canon) AS canon FROM allr WHERE norm <> '' GROUP BY norm)
SELECT norm, canon, len({sql_token_list('norm')}) AS n_tokens FROM g
""")
def q_extract_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.expr(_PART_DISPLAY).alias("display"))
    u = T.expand_universe(part, "display")
    return u.select("norm", "canon", F.size("tokens").alias("n_tokens"))


@register("slug", sql=r"""
SELECT page_id,
       coalesce(nullif(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS url_slug,
       substr(regexp_replace(url, '[:\\/?*\[\]]', '_', 'g'), 1, 31) AS sheet
FROM pages
""")
def q_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", T.slug(F.col("url")).alias("url_slug"),
                        T.sheet_name(F.col("url")).alias("sheet"))


@register("regression_summary", sql="""
WITH g AS (
  SELECT CASE WHEN grouping(l_returnflag) = 1 THEN '_overall_' ELSE l_returnflag END AS l_returnflag,
         count(*) AS n, count(*) AS nf,
         corr(l_extendedprice, l_quantity) AS c,
         regr_slope(l_extendedprice, l_quantity) AS s,
         regr_intercept(l_extendedprice, l_quantity) AS i
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ()))
SELECT l_returnflag, n,
       round(CASE WHEN nf < 2 OR isnan(c) THEN NULL ELSE c END, 6) AS corr,
       round(CASE WHEN nf < 2 OR isnan(s) THEN NULL ELSE s END, 6) AS slope,
       round(CASE WHEN nf < 2 OR isnan(i) THEN NULL ELSE i END, 6) AS intercept
FROM g
""")
def q_regression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    s = regression_summary(li, "l_quantity", "l_extendedprice", "l_returnflag")
    return s.select("l_returnflag", "n", r6("corr").alias("corr"), r6("slope").alias("slope"),
                    r6("intercept").alias("intercept"))


@register("coerce_numeric", sql="""
SELECT event_id,
       TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE) AS prompt_tokens,
       TRY_CAST(trim(CAST(value AS VARCHAR)) AS DOUBLE) AS completion_tokens,
       TRY_CAST(trim(event_type) AS DOUBLE) AS type_num,
       coalesce(TRY_CAST(json_extract_string(props, '$.total') AS DOUBLE),
                coalesce(TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE), 0)
                + coalesce(TRY_CAST(trim(CAST(value AS VARCHAR)) AS DOUBLE), 0)) AS total_tokens
FROM events
""")
def q_coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "props", "value", "event_type")
    df = ev.select(
        "event_id",
        T.coerce_numeric(F.get_json_object("props", "$.k")).alias("prompt_tokens"),
        T.coerce_numeric(F.col("value")).alias("completion_tokens"),
        T.coerce_numeric(F.col("event_type")).alias("type_num"),
        T.coerce_numeric(F.get_json_object("props", "$.total")).alias("total_tokens"))
    return R.fill_total(df).select("event_id", "prompt_tokens", "completion_tokens", "type_num",
                                   "total_tokens")


# label map used by map_label: display labels for two of the event types
EVENT_LABELS = {"click": "Click", "purchase": "Purchase"}


@register("map_label", sql="""
WITH m(event_type, label) AS (VALUES ('click', 'Click'), ('purchase', 'Purchase'))
SELECT coalesce(m.label, coalesce(nullif(e.event_type, ''), 'unknown_model')) AS model_label,
       count(*) AS n
FROM events e LEFT JOIN m ON e.event_type = m.event_type
GROUP BY 1
""")
def q_map_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(R.default_model(F.col("event_type")).alias("model"))
    labelled = R.map_label(ev, "model", EVENT_LABELS, out="model_label")
    return labelled.groupBy("model_label").agg(F.count(F.lit(1)).alias("n"))


@register("corr_summary", sql="""
WITH r AS (
  SELECT coalesce(CASE event_type WHEN 'click' THEN 'Click' WHEN 'purchase' THEN 'Purchase' END,
                  event_type) AS model_label,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS total_tokens,
         value AS latency_s
  FROM events),
g AS (SELECT CASE WHEN grouping(model_label) = 1 THEN '_overall_' ELSE model_label END AS model_label,
             count(*) AS n, corr(latency_s, total_tokens) AS c,
             regr_slope(latency_s, total_tokens) AS s, regr_intercept(latency_s, total_tokens) AS i
      FROM r GROUP BY GROUPING SETS ((model_label), ()))
SELECT model_label, n,
       round(CASE WHEN isnan(c) THEN NULL ELSE c END, 6) AS corr,
       round(CASE WHEN isnan(s) THEN NULL ELSE s END, 6) AS slope,
       round(CASE WHEN isnan(i) THEN NULL ELSE i END, 6) AS intercept
FROM g
""")
def q_corr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart tables on runs derived from events: model = event type, latency = value,
    prompt tokens = props.k, total filled from the parts."""
    from labelset.plans.charts import corr_summary, runs_table, tokens_latency

    ev = table(spark, sf_dir, "events")
    runs = ev.select(F.col("event_type").alias("model"), F.col("value").alias("latency_s"),
                     F.get_json_object("props", "$.k").alias("prompt_tokens"),
                     F.col("event_id").cast("string").alias("request_id"))
    s = corr_summary(tokens_latency(runs_table(runs, EVENT_LABELS)))
    return s.select("model_label", "n", r6("corr").alias("corr"), r6("slope").alias("slope"),
                    r6("intercept").alias("intercept"))
