"""Set scoring on the driver tables.

Customer history as prediction: for each customer, how well do the part names bought
before a cut-off date predict the part names bought from that date on? The customer is
the scored key, the market segment plays the role of the model, ``part.p_name`` is the
item universe. Every branch of the scoring job is hit: keys with no prediction (only
later orders), keys without gold (skipped), overlaps and misses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelset.operators import metrics as M
import uuid

from labelset.plans.registry import register, round_cols, sql_metrics, table
from labelset.session import cut_lineage, scratch_path
from labelset.sources.json_docs import read_report_folder, read_report_scenarios
from labelset.sources.sinks import write_report_documents, write_reports

CUTOFF = "1998-01-01 00:00:00"
LONG_DOC_CHARS = 1000  # prediction rule of binary_label_metrics: long documents are "good"


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(c_custkey, item, p, g)``: one row per bought line, tagged history / future.

    Two equi-joins (orderkey, partkey); the repeated (customer, name) rows are collapsed
    by the partial aggregation inside the confusion step, before any further shuffle.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    future = F.col("o_orderdate") >= F.lit(CUTOFF).cast("timestamp_ntz")
    lo = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("c_custkey"), "l_partkey", (~future).alias("p"), future.alias("g"))
    return lo.join(p, lo.l_partkey == p.p_partkey).select(
        "c_custkey", F.col("p_name").alias("item"), "p", "g")


def part_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("norm"))


def customer_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with any order: the keys the 'model' saw."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return o.distinct()


def customer_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion_from_cells(customer_cells(spark, sf_dir), ["c_custkey"], "item", "p", "g",
                                  universe=part_universe(spark, sf_dir))


def customer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")


@register("set_confusion", sql=f"""
WITH f AS (
  SELECT DISTINCT o.o_custkey AS c_custkey, p.p_name AS item,
         o.o_orderdate >= TIMESTAMP '{CUTOFF}' AS fut
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey),
pr AS (SELECT DISTINCT c_custkey, item FROM f WHERE NOT fut),
go AS (SELECT DISTINCT c_custkey, item FROM f WHERE fut),
j AS (SELECT coalesce(pr.c_custkey, go.c_custkey) AS c_custkey,
             pr.item IS NOT NULL AS ip, go.item IS NOT NULL AS ig
      FROM pr FULL OUTER JOIN go ON pr.c_custkey = go.c_custkey AND pr.item = go.item),
c AS (SELECT c_custkey,
             count(*) FILTER (WHERE ip AND ig) AS tp,
             count(*) FILTER (WHERE ip AND NOT ig) AS fp,
             count(*) FILTER (WHERE ig AND NOT ip) AS fn
      FROM j GROUP BY c_custkey HAVING count(*) FILTER (WHERE ig) > 0),
u AS (SELECT count(DISTINCT p_name) AS n FROM part)
SELECT c.c_custkey, c.tp, c.fp, c.fn, greatest(u.n - c.tp - c.fp - c.fn, 0) AS tn
FROM c CROSS JOIN u
""")
def q_set_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_confusion(spark, sf_dir).select("c_custkey", "tp", "fp", "fn", "tn")


_CONF_SQL = f"""
WITH f AS (
  SELECT DISTINCT o.o_custkey AS c_custkey, p.p_name AS item,
         o.o_orderdate >= TIMESTAMP '{CUTOFF}' AS fut
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey),
pr AS (SELECT DISTINCT c_custkey, item FROM f WHERE NOT fut),
go AS (SELECT DISTINCT c_custkey, item FROM f WHERE fut),
j AS (SELECT coalesce(pr.c_custkey, go.c_custkey) AS c_custkey,
             pr.item IS NOT NULL AS ip, go.item IS NOT NULL AS ig
      FROM pr FULL OUTER JOIN go ON pr.c_custkey = go.c_custkey AND pr.item = go.item),
c0 AS (SELECT c_custkey,
             count(*) FILTER (WHERE ip AND ig) AS tp,
             count(*) FILTER (WHERE ip AND NOT ig) AS fp,
             count(*) FILTER (WHERE ig AND NOT ip) AS fn
      FROM j GROUP BY c_custkey HAVING count(*) FILTER (WHERE ig) > 0),
u AS (SELECT count(DISTINCT p_name) AS n FROM part),
c AS (SELECT c0.*, greatest(u.n - c0.tp - c0.fp - c0.fn, 0) AS tn FROM c0 CROSS JOIN u),
m AS (SELECT c.*, {sql_metrics(rounded=False)} FROM c)
"""


@register("set_metrics", sql=_CONF_SQL + """
SELECT c_custkey, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, round(denom, 6) AS denom, round(mcc, 6) AS mcc,
       round(npv, 6) AS npv, round(fdr, 6) AS fdr
FROM m
""")
def q_set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.set_metrics(customer_confusion(spark, sf_dir))
    return round_cols(m.select("c_custkey", *M.COUNT_COLS, *M.METRIC_COLS), M.METRIC_COLS)


def _segment_metrics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seg = customer_segments(spark, sf_dir)
    m = M.set_metrics(customer_confusion(spark, sf_dir)).join(seg, "c_custkey")
    groups = customer_seen(spark, sf_dir).join(seg, "c_custkey").select("c_mktsegment")
    return m, groups


@register("macro_average", sql=_CONF_SQL + """
SELECT cu.c_mktsegment,
       round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1, round(avg(denom), 6) AS denom, round(avg(mcc), 6) AS mcc,
       round(avg(npv), 6) AS npv, round(avg(fdr), 6) AS fdr, count(*) AS evaluated
FROM m JOIN customer cu ON m.c_custkey = cu.c_custkey
GROUP BY cu.c_mktsegment
""")
def q_macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, groups = _segment_metrics(spark, sf_dir)
    return round_cols(M.macro_average(m, ["c_mktsegment"], groups), M.METRIC_COLS)


@register("totals", sql=_CONF_SQL + """,
seen AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders),
sk AS (SELECT s.c_custkey FROM seen s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.c_custkey = s.c_custkey)),
segs AS (SELECT DISTINCT cu.c_mktsegment FROM seen s JOIN customer cu ON s.c_custkey = cu.c_custkey),
t AS (SELECT cu.c_mktsegment, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn,
             count(*) AS evaluated
      FROM c JOIN customer cu ON c.c_custkey = cu.c_custkey GROUP BY 1),
ks AS (SELECT cu.c_mktsegment, count(*) AS skipped
       FROM sk JOIN customer cu ON sk.c_custkey = cu.c_custkey GROUP BY 1)
SELECT segs.c_mktsegment,
       CAST(coalesce(t.tp, 0) AS BIGINT) AS tp, CAST(coalesce(t.fp, 0) AS BIGINT) AS fp,
       CAST(coalesce(t.fn, 0) AS BIGINT) AS fn, CAST(coalesce(t.tn, 0) AS BIGINT) AS tn,
       coalesce(t.evaluated, 0) AS evaluated, coalesce(ks.skipped, 0) AS skipped
FROM segs LEFT JOIN t ON segs.c_mktsegment = t.c_mktsegment
LEFT JOIN ks ON segs.c_mktsegment = ks.c_mktsegment
""")
def q_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, groups = _segment_metrics(spark, sf_dir)
    # skipped = seen - evaluated per segment: no second pass over the confusion subtree
    seen = groups.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_seen"))
    return M.totals(m, ["c_mktsegment"], seen_counts=seen)


def _skipped(spark: SparkSession, sf_dir: str, evaluated: DataFrame) -> DataFrame:
    """Seen customers that were not evaluated, i.e. have no gold item (anti join)."""
    return M.skipped_keys(customer_seen(spark, sf_dir), evaluated.select("c_custkey"), ["c_custkey"])


@register("skipped_keys", sql=f"""
SELECT s.c_custkey, cu.c_mktsegment
FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders) s
JOIN customer cu ON s.c_custkey = cu.c_custkey
WHERE NOT EXISTS (
  SELECT 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  WHERE o.o_custkey = s.c_custkey AND o.o_orderdate >= TIMESTAMP '{CUTOFF}')
""")
def q_skipped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_skipped(spark, sf_dir, customer_confusion(spark, sf_dir))
            .join(customer_segments(spark, sf_dir), "c_custkey")
            .select("c_custkey", "c_mktsegment"))


@register("binary_label_metrics", sql=f"""
WITH u AS (
  SELECT d.lang, d.doc_id, d.n_chars >= {LONG_DOC_CHARS} AS ip, l.quality = 1 AS ig
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c0 AS (SELECT lang, count(*) FILTER (WHERE ip AND ig) AS tp,
              count(*) FILTER (WHERE ip AND NOT ig) AS fp,
              count(*) FILTER (WHERE ig AND NOT ip) AS fn,
              count(DISTINCT doc_id) AS n
       FROM u GROUP BY lang HAVING count(*) FILTER (WHERE ig) > 0),
c AS (SELECT lang, tp, fp, fn, greatest(n - tp - fp - fn, 0) AS tn FROM c0)
SELECT lang, tp, fp, fn, tn, {sql_metrics()} FROM c
""")
def q_binary_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    labelled = docs.join(labels, "doc_id")
    cells = labelled.select("lang", F.col("doc_id").alias("item"),
                            (F.col("n_chars") >= LONG_DOC_CHARS).alias("p"),
                            (F.col("quality") == 1).alias("g"))
    universe = labelled.select("lang", F.col("doc_id").alias("norm"))
    conf = M.confusion_from_cells(cells, ["lang"], "item", "p", "g", universe=universe,
                                  universe_keys=["lang"])
    m = M.set_metrics(conf)
    return round_cols(m.select("lang", *M.COUNT_COLS, *M.METRIC_COLS), M.METRIC_COLS)


@register("write_reports", sql=_CONF_SQL + """
SELECT cu.c_mktsegment, m.c_custkey, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, round(mcc, 6) AS mcc
FROM m JOIN customer cu ON m.c_custkey = cu.c_custkey
""")
def q_write_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write per-customer metrics as report rows partitioned by source and model slug, then
    read all partitions back."""
    m, _ = _segment_metrics(spark, sf_dir)
    out = scratch_path(spark, f"write_reports-{uuid.uuid4().hex}")
    rows = m.select(F.lit("orders").alias("source"), "c_mktsegment", "c_custkey", *M.COUNT_COLS,
                    *M.METRIC_COLS)
    write_reports(rows, out, source="source", model="c_mktsegment")
    back = spark.read.json(out)
    back = back.select("c_mktsegment", F.col("c_custkey").cast("long").alias("c_custkey"),
                       *[F.col(c).cast("long").alias(c) for c in M.COUNT_COLS],
                       *[F.col(c) for c in ("precision", "recall", "f1", "mcc")])
    return round_cols(back, ["precision", "recall", "f1", "mcc"])


def _write_segment_reports(spark: SparkSession, sf_dir: str) -> str:
    """Report documents of all segments (the models) over their customers (the scenarios); their folder."""
    out = scratch_path(spark, f"report_documents-{uuid.uuid4().hex}")
    m, _ = _segment_metrics(spark, sf_dir)
    seen = customer_seen(spark, sf_dir).join(customer_segments(spark, sf_dir), "c_custkey")
    name = [F.lit("orders").alias("source"), F.col("c_mktsegment").alias("model")]
    sid = [F.concat(F.lit("cust "), F.col("c_custkey").cast("string")).alias("sid_norm"),
           F.concat(F.lit('Cust "'), F.col("c_custkey").cast("string"), F.lit('"')).alias("sid_raw")]
    m, seen = cut_lineage(m), cut_lineage(seen)
    skipped = M.skipped_keys(seen, m.select("c_custkey"), ["c_custkey"])
    segments = seen.select("c_mktsegment").distinct()
    macro = M.macro_average(m, ["c_mktsegment"], segments)
    totals = M.totals(m, ["c_mktsegment"], groups=segments)
    write_report_documents(m.select(*name, *sid, *M.COUNT_COLS, *M.METRIC_COLS), macro.select(*name, *M.METRIC_COLS, "evaluated"),
                           totals.select(*name, *M.COUNT_COLS), skipped.select(*name, *sid), out)
    return out


@register("report_documents", sql=_CONF_SQL + """,
a AS (SELECT cu.c_mktsegment, avg(precision) AS ap, avg(f1) AS af, avg(mcc) AS am
      FROM m JOIN customer cu ON m.c_custkey = cu.c_custkey GROUP BY 1)
SELECT cu.c_mktsegment AS model, 'Cust "' || m.c_custkey || '"' AS sid_raw, tp, fp, fn, tn, round(f1, 6) AS f1, round(mcc, 6) AS mcc,
       round(ap, 6) AS macro_precision, round(af, 6) AS macro_f1, round(am, 6) AS macro_mcc
FROM m JOIN customer cu ON m.c_custkey = cu.c_custkey JOIN a ON a.c_mktsegment = cu.c_mktsegment
""")
def q_report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report documents of all segments, written and read back: every scenario with its document's macro averages."""
    out = _write_segment_reports(spark, sf_dir)
    macro = read_report_folder(spark, out, {}, "none").select(F.col("model_raw").alias("model"), "macro_precision", "macro_f1", "macro_mcc")
    rows = read_report_scenarios(spark, out)
    rows = rows.select("model", "sid_raw", *[F.col(c.upper()).alias(c) for c in M.COUNT_COLS], "f1", "mcc").join(macro, "model")
    return round_cols(rows, ["f1", "mcc", "macro_precision", "macro_f1", "macro_mcc"])
