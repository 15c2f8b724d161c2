"""Reply salvage, record keys, lenient documents and the whole scoring job on the driver
tables.

Replies and records are synthesised from ``events`` / ``orders`` rows in several shapes
(fenced, trailing prose, unbalanced, a lone object, no JSON), so the oracle knows the
expected result by construction.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelset.functions import replies as RP
from labelset.functions.text import UNIVERSE_ABBREVIATIONS, expand_universe, normalize_text
from labelset.operators import metrics as M
from labelset.operators.records import flatten_records, label_lookup, resolve_key, split_errors
from labelset.plans.charts import chart_tables
from labelset.plans.registry import r6, register, sql_metrics, table
from labelset.plans.scoring import evaluate_runs, scenario_report
from labelset.plans.scoring_tables import CUTOFF
from labelset.session import cut_lineage, scratch_path
from labelset.sources.json_docs import read_gold, read_results, read_universe, results_table
from labelset.sources.sinks import write_results

_K = "get_json_object(props, '$.k')"


def event_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply per event; its shape depends on the event type."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    k = F.expr(_K)
    view_objs = F.concat(F.lit('{"KPI": "v1-'), k, F.lit('"}, {"kpi": "v2"}, {"Kpi": "v3"}, '
                                                    '{"kpi": "v4"}, {"kpi": "v5", "Métrica": ["x"]}'))
    reply = (F.when(F.col("event_type") == "click",
                    F.concat(F.lit('```json\n[{"kpi": "click '), k, F.lit('", "metricas": "a, b;c"}]\n```')))
             .when(F.col("event_type") == "view",
                   F.concat(F.lit("Sure! ["), view_objs, F.lit("] hope it helps ]")))
             .when(F.col("event_type") == "purchase", F.concat(F.lit('[{"kpi": "p'), k, F.lit('"}')))
             .when(F.col("event_type") == "signup",
                   F.concat(F.lit('{"kpi": "s'), k, F.lit('", "formula": '),
                            F.col("value").cast("string"), F.lit("}")))
             .otherwise(F.concat(F.lit("no json here "), k)))
    return ev.select("event_id", reply.alias("reply"),
                     (F.col("event_type") == "view").alias("limited"))


@register("sanitize_replies", sql=f"""
SELECT event_id,
       CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 4 WHEN 'purchase' THEN 1
                       WHEN 'signup' THEN 1 ELSE 0 END AS n_items,
       event_type <> 'error' AS valid,
       CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN ''
                       WHEN 'error' THEN 'array_parse_failed,unrecoverable_objects'
                       ELSE 'array_parse_failed' END AS issues,
       CASE event_type WHEN 'click' THEN 'click ' || json_extract_string(props, '$.k')
                       WHEN 'view' THEN 'v1-' || json_extract_string(props, '$.k') || '|v2|v3|v4'
                       WHEN 'purchase' THEN 'p' || json_extract_string(props, '$.k')
                       WHEN 'signup' THEN 's' || json_extract_string(props, '$.k')
                       ELSE '' END AS kpis,
       CASE event_type WHEN 'click' THEN 3 ELSE 0 END AS n_metricas
FROM events
""")
def q_sanitize_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = event_replies(spark, sf_dir)
    s = r.select("event_id", RP.sanitize_reply(F.col("reply"), F.col("limited")).alias("s"))
    items = F.col("s.items")
    return s.select(
        "event_id", F.size(items).alias("n_items"), F.col("s.valid").alias("valid"),
        F.array_join(F.col("s.issues"), ",").alias("issues"),
        F.array_join(F.transform(items, lambda it: it["kpi"]), "|").alias("kpis"),
        F.aggregate(items, F.lit(0), lambda acc, it: acc + F.size(it["metricas"])).alias("n_metricas"))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON record per event with the scenario key spelled in several ways."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props")
    uid = F.col("user_id").cast("string")
    k = F.expr(_K)
    rec = (F.when(F.col("event_type") == "click",
                  F.concat(F.lit('{"scenario_id": "S-'), uid, F.lit('", "model": "m'), k, F.lit('"}')))
           .when(F.col("event_type") == "view",
                 F.concat(F.lit('{"scenario": {"slug": "View '), uid, F.lit('"}, "model": ""}')))
           .when(F.col("event_type") == "purchase", F.concat(F.lit('{"id": '), uid, F.lit("}")))
           .when(F.col("event_type") == "signup",
                 F.concat(F.lit('{"slug": "", "name": "N'), uid, F.lit('"}')))
           .otherwise(F.lit('{"scenario_id": 0, "scenario": {"id": 7, "name": "x"}}')))
    return ev.select("event_id", rec.alias("record"))


@register("resolve_key", sql="""
SELECT event_id,
       CASE event_type WHEN 'click' THEN 'S-' || user_id WHEN 'view' THEN 'View ' || user_id
                       WHEN 'signup' THEN 'N' || user_id ELSE '' END AS sid_raw,
       CASE event_type WHEN 'click' THEN 's ' || user_id WHEN 'view' THEN 'view ' || user_id
                       WHEN 'signup' THEN 'n' || user_id ELSE '' END AS sid_norm,
       CASE event_type WHEN 'click' THEN 'm' || json_extract_string(props, '$.k')
                       ELSE 'unknown_model' END AS model
FROM events
""")
def q_resolve_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labelset.plans.scoring import record_rows

    recs = event_records(spark, sf_dir).select(
        F.lit("events").alias("_source_file"), F.col("event_id").alias("pos"), "record")
    rows = record_rows(recs)
    return rows.select(F.col("pos").alias("event_id"), "sid_raw", "sid_norm", "model")


@register("results_roundtrip", sql="""
SELECT CAST(event_id AS VARCHAR) AS request_id, 'user-' || user_id AS scenario_id, event_type AS model,
       round(value, 6) AS latency_s, 'it''s "' || event_type || '", ok' AS output, event_type <> 'error' AS valid
FROM events
""")
def q_results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a result record, written by the results sink and read by the results source."""
    ev = table(spark, sf_dir, "events")
    recs = ev.select(
        F.col("event_id").cast("string").alias("request_id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("scenario_id"),
        F.col("event_type").alias("model"), F.col("value").cast("double").alias("latency_s"),
        F.concat(F.lit("it's \""), "event_type", F.lit("\", ok")).alias("output"), (F.col("event_type") != "error").alias("valid"))
    path = scratch_path(spark, f"results-{uuid.uuid4().hex}")
    write_results(recs, path)
    back = results_table(read_results(spark, path))
    return back.select("request_id", "scenario_id", "model", r6("latency_s").alias("latency_s"), "output", "valid")


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result record per order placed before the cut-off: the customer is the
    scenario, the order priority the model, the bought part names (spelled upper-case on
    line 1, in plural on line 2) the predicted items."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    o = o.filter(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = li.join(part, li.l_partkey == part.p_partkey).select("l_orderkey", "l_linenumber", "p_name")
    spelled = (F.when(F.col("l_linenumber") == 1, F.upper("p_name"))
               .when(F.col("l_linenumber") == 2, F.concat("p_name", F.lit("s")))
               .otherwise(F.col("p_name")))
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    per_order = j.groupBy("o_orderkey", "o_custkey", "o_orderpriority").agg(
        F.collect_list(F.when(F.col("p_name").isNotNull(), F.struct(spelled.alias("KPI")))).alias("items"))
    rec = F.to_json(F.struct(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("scenario_id"),
                             F.col("o_orderpriority").alias("model"),
                             F.col("items").alias("parsed_items")))
    return per_order.select(F.lit("orders").alias("_source_file"), F.col("o_orderkey").alias("pos"),
                            rec.alias("record"))


def order_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o = o.filter(F.col("o_orderdate") >= F.lit(CUTOFF).cast("timestamp_ntz"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    g = o.join(li, o.o_orderkey == li.l_orderkey).join(part, li.l_partkey == part.p_partkey)
    return g.select(normalize_text(F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))).alias("sid_norm"),
                    F.col("p_name").alias("item"))


_CONSTS = ", ".join(f"'{a}'" for a in UNIVERSE_ABBREVIATIONS)


@register("evaluate_runs", sql=f"""
WITH h AS (
  SELECT o.o_custkey, o.o_orderpriority AS model, p.p_name
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  WHERE o.o_orderdate < TIMESTAMP '{CUTOFF}'),
seen AS (SELECT DISTINCT model, 'cust ' || o_custkey AS sid_norm FROM h),
pr AS (SELECT DISTINCT model, 'cust ' || o_custkey AS sid_norm, p_name AS item FROM h
       WHERE p_name IS NOT NULL),
gd AS (SELECT DISTINCT 'cust ' || o.o_custkey AS sid_norm, p.p_name AS item
       FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
       JOIN part p ON l.l_partkey = p.p_partkey WHERE o.o_orderdate >= TIMESTAMP '{CUTOFF}'),
ga AS (SELECT s.model, s.sid_norm, g.item FROM seen s JOIN gd g ON s.sid_norm = g.sid_norm),
j AS (SELECT coalesce(pr.model, ga.model) AS model, coalesce(pr.sid_norm, ga.sid_norm) AS sid_norm,
             pr.item IS NOT NULL AS ip, ga.item IS NOT NULL AS ig
      FROM pr FULL OUTER JOIN ga ON pr.model = ga.model AND pr.sid_norm = ga.sid_norm AND pr.item = ga.item),
c0 AS (SELECT model, sid_norm, count(*) FILTER (WHERE ip AND ig) AS tp,
              count(*) FILTER (WHERE ip AND NOT ig) AS fp, count(*) FILTER (WHERE ig AND NOT ip) AS fn
       FROM j GROUP BY 1, 2 HAVING count(*) FILTER (WHERE ig) > 0),
u AS (SELECT count(*) AS n FROM (SELECT p_name AS x FROM part UNION SELECT unnest([{_CONSTS}]) AS x)),
c AS (SELECT model, sid_norm, tp, fp, fn, greatest(u.n - tp - fp - fn, 0) AS tn FROM c0 CROSS JOIN u)
SELECT model, sid_norm, tp, fp, fn, tn, {sql_metrics()} FROM c
""")
def q_evaluate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_name")
    universe = expand_universe(part, "p_name")
    scores = evaluate_runs(order_records(spark, sf_dir), universe, order_gold(spark, sf_dir))
    pk = scores.per_key
    return pk.select("model", "sid_norm", *M.COUNT_COLS, *[r6(m).alias(m) for m in M.METRIC_COLS])


RECORDS_PER_DOC = 1000  # events per written results document


@register("lenient_read", sql="""
SELECT CAST(event_id AS VARCHAR) AS request_id, event_type AS scenario_id,
       'u' || user_id AS model, value AS latency_s,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS prompt_tokens
FROM events
""")
def q_lenient_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write result documents (trailing commas, bare arrays and ``{"results": ...}``),
    read them back leniently. Each document holds at most RECORDS_PER_DOC records."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", "props")
    rec = F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"),
                             F.col("event_type").alias("scenario_id"),
                             F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("model"),
                             F.col("value").alias("latency_s"),
                             F.expr(_K).cast("long").alias("prompt_tokens")))
    bare = F.col("event_type").isin("click", "view")
    docs = (ev.select(F.col("event_type"), F.floor(F.col("event_id") / RECORDS_PER_DOC).alias("chunk"),
                      rec.alias("rec"), bare.alias("bare"))
            .groupBy("event_type", "chunk", "bare")
            .agg(F.array_join(F.collect_list("rec"), ",\n").alias("body")))
    text = F.when(F.col("bare"), F.concat(F.lit("[\n"), F.col("body"), F.lit(",\n]")))\
        .otherwise(F.concat(F.lit('{"results": [\n'), F.col("body"), F.lit(",\n],}")))
    out = scratch_path(spark, f"lenient_read-{uuid.uuid4().hex}")
    (docs.select(F.concat_ws("-", "event_type", F.col("chunk").cast("string")).alias("doc"),
                 text.alias("value"))
     .repartition("doc").write.partitionBy("doc").text(out))
    recs = results_table(read_results(spark, f"{out}/*/*.txt"))
    return recs.select("request_id", "scenario_id", "model", "latency_s", "prompt_tokens")


@register("split_read", sql="""
SELECT CAST(event_id AS VARCHAR) AS request_id, event_type AS scenario_id, 'u' || user_id AS model, value AS latency_s,
       row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos
FROM events
""")
def q_split_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a type in one results document, with a trailing comma, read in parts by byte ranges."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    bare = F.col("event_type").isin("click", "view")
    rec = F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), F.col("event_type").alias("scenario_id"),
                             F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("model"), F.col("value").alias("latency_s")))
    lines = ev.select("event_type", F.lit(1).alias("place"), "event_id", F.concat(rec, F.lit(",")).alias("line"))
    types = ev.select("event_type").distinct()
    edge = lambda place, a, b: types.select(
        "event_type", F.lit(place).alias("place"), F.lit(None).cast("long").alias("event_id"), F.when(bare, a).otherwise(b).alias("line"))
    doc = lines.unionByName(edge(0, "[", '{"results": [')).unionByName(edge(2, "]", '], "kind": {"n": 1}}'))
    out = scratch_path(spark, f"split_read-{uuid.uuid4().hex}")
    (doc.repartition("event_type").sortWithinPartitions("event_type", "place", "event_id")
     .select("event_type", "line").write.partitionBy("event_type").text(out))
    recs = results_table(read_results(spark, f"{out}/*/*.txt", layout="documents", split_bytes=0))
    return recs.select("request_id", "scenario_id", "model", "latency_s", "pos")


@register("union_files", sql="""
SELECT CAST(event_id AS VARCHAR) AS request_id, event_type AS folder,
       CASE WHEN event_type = 'error' THEN 'lost' END AS error,
       CASE WHEN event_type IN ('click', 'view') THEN value END AS latency_s,
       CASE WHEN event_type <> 'view' THEN 'u' || user_id END AS model
FROM events
""")
def q_union_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result records of several folders, each with fields of its own, in one scan."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    kind = F.col("event_type")
    rec = F.to_json(F.struct(F.col("event_id").cast("string").alias("request_id"), F.when(kind == "error", "lost").alias("error"),
                             F.when(kind.isin("click", "view"), F.col("value")).alias("latency_s"),
                             F.when(kind != "view", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("model")))
    out = scratch_path(spark, f"union_files-{uuid.uuid4().hex}")
    ev.select("event_type", rec.alias("value")).write.partitionBy("event_type").text(out)
    kinds = [r["event_type"] for r in ev.select("event_type").distinct().collect()]
    runs = results_table(read_results(spark, [f"{out}/event_type={k}" for k in kinds], layout="lines"))
    return runs.select("request_id", F.regexp_extract("_source_file", "event_type=(.*)$", 1).alias("folder"), "error", "latency_s", "model")


def _write_document(lines: DataFrame, path: str, head: str, tail: str) -> None:
    """One JSON document from the sorted ``line`` rows (each with its comma), written by one task row by row."""
    edge = lines.sparkSession.createDataFrame([(0, head), (2, tail)], "place int, line string")
    body = lines.select(F.lit(1).alias("place"), "line").unionByName(edge)
    body.repartition(1).sortWithinPartitions("place", "line").select("line").write.text(path)


@register("gold_read", sql=f"""
SELECT DISTINCT 'cust ' || o.o_custkey AS sid_norm, p.p_name AS item
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
WHERE o.o_orderdate >= TIMESTAMP '{CUTOFF}'
""")
def q_gold_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universe and gold documents written from parts and orders, read back by the sources; the gold spells its names in plural."""
    base = scratch_path(spark, f"gold_read-{uuid.uuid4().hex}")
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    quoted = F.regexp_extract(F.to_json(F.array("p_name")), r"^\[(.*)\]$", 1)
    _write_document(names.select(F.concat(quoted, F.lit(",")).alias("line")), f"{base}/universe", "[", "]")
    sold = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit(CUTOFF).cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    bought = sold.join(li, sold.o_orderkey == li.l_orderkey).join(part, li.l_partkey == part.p_partkey)
    gold = bought.groupBy("o_custkey").agg(F.collect_set(F.struct(F.concat(F.upper("p_name"), F.lit("s")).alias("KPI"))).alias("items"))
    entry = F.concat(F.lit('"Cust-'), F.col("o_custkey").cast("string"), F.lit('": '), F.to_json("items"), F.lit(","))
    _write_document(gold.select(entry.alias("line")), f"{base}/gold", "{", '"none": "no list"}')
    universe = cut_lineage(read_universe(spark, f"{base}/universe/part-*"))
    return read_gold(spark, f"{base}/gold/part-*", universe).select("sid_norm", "item")


@register("chart_runs", sql="""
SELECT CAST(event_id AS VARCHAR) AS request_id, CASE event_type WHEN 'click' THEN 'Clicks' ELSE event_type END AS model_label,
       CASE WHEN event_type = 'view' THEN NULL ELSE value END AS latency_s,
       CASE WHEN event_type = 'purchase' THEN 7.0 ELSE coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) + 2 END AS total_tokens,
       event_type <> 'view' AS in_tokens_table, event_type = 'error' AS failed
FROM events
""")
def q_chart_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written as results, read into the sorted chart tables: totals filled, labels joined from a table, failed
    runs told apart, and runs with both measures marked."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    kind = F.col("event_type")
    rec = ev.select(F.col("event_id").cast("string").alias("request_id"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("scenario_id"),
                    kind.alias("model"), F.lit("unlimited").alias("condition"),
                    F.when(kind == "view", "n/a").otherwise(F.col("value").cast("string")).alias("latency_s"),
                    F.expr(_K).cast("long").alias("prompt_tokens"), F.lit(2).alias("completion_tokens"),
                    F.when(kind == "purchase", " 7 ").alias("total_tokens"), F.when(kind == "error", "lost").alias("error"))
    base = scratch_path(spark, f"chart_runs-{uuid.uuid4().hex}")
    write_results(rec, f"{base}/results.json")
    charts = chart_tables(spark, base, report_files={}, result_files=["results.json", "absent.json"], labels={})
    both = charts["tokens_latency"].select("request_id", F.lit(True).alias("_both"))
    labels = spark.createDataFrame([("click", "Clicks")], "model string, label string")
    runs = label_lookup(charts["runs"].drop("model_label"), labels, "model")
    raw = results_table(read_results(spark, f"{base}/results.json"))
    failed, scored = split_errors(raw)
    known = failed.select("request_id", F.lit(True).alias("failed")).unionByName(scored.select("request_id", F.lit(False).alias("failed")))
    out = runs.join(both, "request_id", "left").join(known, "request_id")
    return out.select("request_id", "model_label", "latency_s", "total_tokens", F.coalesce("_both", F.lit(False)).alias("in_tokens_table"), "failed")


@register("flatten_records", sql="""
SELECT conv_id AS "rec.conv_id", turn AS "rec.meta.turn", role AS "rec.meta.role",
       length(text) AS n_chars
FROM conversations
""")
def q_flatten_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    nested = c.select(F.struct("conv_id", F.struct("turn", "role").alias("meta")).alias("rec"),
                      F.length("text").alias("n_chars"))
    return flatten_records(nested)


STREAM_BATCHES = 8  # micro-batches of the streamed job, at least; a customer's orders span them


def _evaluate_runs_sql() -> str:
    from labelset.plans.registry import REGISTRY

    return REGISTRY["evaluate_runs"].sql


@register("evaluate_stream", sql=_evaluate_runs_sql())
def q_evaluate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring job run incrementally: order records land as files, the two streams score
    them in ``STREAM_BATCHES`` batches or more; the final scores equal the batch job."""
    from labelset.streaming.incremental import current_scores, evaluate_stream

    base = scratch_path(spark, f"evaluate_stream-{uuid.uuid4().hex}")
    src = f"{base}/landing"
    files = max(STREAM_BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    recs = order_records(spark, sf_dir)
    recs.select("pos", "record").repartition(files).write.json(src)
    part = table(spark, sf_dir, "part").select("p_name")
    universe = expand_universe(part, "p_name")
    per_batch = -(-files // STREAM_BATCHES)
    evaluate_stream(spark, src, base, universe, order_gold(spark, sf_dir), source="orders",
                    max_files_per_trigger=per_batch, max_landed_files=per_batch)
    cur = current_scores(spark, base)
    return cur.select("model", "sid_norm", *M.COUNT_COLS, *[r6(m).alias(m) for m in M.METRIC_COLS])


def _scenario_report_sql() -> str:
    base = _evaluate_runs_sql()
    head, _, _ = base.rpartition("SELECT model, sid_norm, tp, fp, fn, tn,")
    return head + """,
pl AS (SELECT model, sid_norm, string_agg(item, '|' ORDER BY item) AS pred
       FROM pr GROUP BY 1, 2),
gl AS (SELECT model, sid_norm, string_agg(item, '|' ORDER BY item) AS gold
       FROM ga GROUP BY 1, 2)
SELECT c.model, c.sid_norm, 'cust-' || substr(c.sid_norm, 6) AS sid_raw, tp, fp, fn, tn,
       coalesce(pl.pred, '') AS pred, coalesce(gl.gold, '') AS gold
FROM c LEFT JOIN pl ON c.model = pl.model AND c.sid_norm = pl.sid_norm
LEFT JOIN gl ON c.model = gl.model AND c.sid_norm = gl.sid_norm
"""


@register("scenario_report", sql=_scenario_report_sql())
def q_scenario_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows of the scoring job: metrics with sorted predicted and gold lists."""
    part = table(spark, sf_dir, "part").select("p_name")
    universe = expand_universe(part, "p_name")
    rep = scenario_report(evaluate_runs(order_records(spark, sf_dir), universe, order_gold(spark, sf_dir)))
    return rep.select("model", "sid_norm", "sid_raw", *M.COUNT_COLS,
                      F.array_join("pred", "|").alias("pred"), F.array_join("gold", "|").alias("gold"))
