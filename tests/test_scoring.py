"""The scoring job end to end, its streaming form, and the driver contract."""

import json
import os

from pyspark.sql import Row
from pyspark.sql import functions as F

from labelset.plans.scoring import evaluate_runs
from labelset.functions.text import expand_universe

UNIVERSE = ["CPA", "CPL", "CTR", "Taxa de Qualificação", "Lead Time", "ROI", "Churn de Clientes"]


def _inputs(spark):
    u = expand_universe(spark.createDataFrame([(x,) for x in UNIVERSE], "n string"), "n")
    gold = spark.createDataFrame([("a", "cpa"), ("a", "cpl"), ("a", "ctr"), ("b", "lead time"),
                                  ("c", "roi")], "sid_norm string, item string")
    recs = [
        {"scenario_id": "A", "model": "m1", "parsed_items": [{"kpi": "Custo por Aquisição"}, {"KPI": "CPL"}]},
        {"scenario_id": "a", "model": "m1", "parsed_items": [{"kpi": "Taxa de qualificacao"}]},
        {"scenario": {"slug": "B"}, "model": "m1", "output": '[{"kpi":"Lead Time for Changes"}]'},
        {"scenario_id": "D", "model": "m1", "parsed_items": [{"kpi": "CPA"}]},
        {"scenario_id": "a", "model": "", "parsed_items": []},
        {"scenario_id": 5, "model": "m2"},
    ]
    df = spark.createDataFrame([("r.json", i, json.dumps(r)) for i, r in enumerate(recs)],
                               "_source_file string, pos long, record string")
    return df, u, gold


def test_evaluate_runs(spark):
    df, u, gold = _inputs(spark)
    s = evaluate_runs(df, u, gold)
    pk = {(r.model, r.sid_norm): r for r in s.per_key.collect()}
    a = pk[("m1", "a")]
    assert (a.tp, a.fp, a.fn, a.sid_raw) == (2, 1, 1, "A")
    assert pk[("m1", "b")].tp == 1
    assert pk[("unknown_model", "a")].fn == 3
    assert {(r.model, r.sid_norm) for r in s.skipped.collect()} == {("m1", "d")}
    macro = {r.model: r for r in s.macro.collect()}
    assert macro["m2"].evaluated == 0 and macro["m2"].precision == 0.0   # model with unkeyed rows only
    tot = {r.model: r for r in s.totals.collect()}
    assert (tot["m1"].evaluated, tot["m1"].skipped) == (2, 1)
    usize = u.count()
    assert all(r.tp + r.fp + r.fn + r.tn == usize for r in s.per_key.collect())


def _land(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        for r in rows:
            f.write(json.dumps({"pos": r.pos, "record": r.record}) + "\n")


def _counts(df):
    return {(r.source, r.model, r.sid_norm, r.sid_raw, r.tp, r.fp, r.fn, r.tn) for r in df.collect()}


def test_stream_equals_batch_in_any_order(spark, scratch):
    """Late files with earlier positions, repeated files, restarts between files, one record a file."""
    from labelset.streaming.incremental import compact_scores, current_macro, current_scores, evaluate_stream

    df, u, gold = _inputs(spark)
    src, base = os.path.join(scratch, "landing"), os.path.join(scratch, "stream")
    rows = df.collect()
    want = evaluate_runs(df, u, gold)
    assert compact_scores(spark, base) is None and current_scores(spark, base).count() == 0
    run = lambda: evaluate_stream(spark, src, base, u, gold, source="r.json", max_landed_files=1)
    for i, k in enumerate([4, 1]):
        _land(src, f"a{i}.json", rows[k:k + 1])
    run()
    partial = {(r.model, r.sid_norm): r for r in current_scores(spark, base).collect()}
    assert set(partial) == {("m1", "a"), ("unknown_model", "a")} and partial["m1", "a"].sid_raw == "a"
    assert compact_scores(spark, base) is not None
    _land(src, "b0.json", [rows[5], rows[3]])
    _land(src, "b1.json", [rows[0], rows[2], rows[0]])  # record 0 is the first spelling of key a, and comes twice
    run()
    assert _counts(current_scores(spark, base)) == _counts(want.per_key)
    assert sorted(map(tuple, current_macro(spark, base).collect())) == sorted(map(tuple, want.macro.collect()))
    run()  # nothing new
    last = compact_scores(spark, base)
    assert _counts(current_scores(spark, base)) == _counts(want.per_key) and compact_scores(spark, base) == last


def test_stream_emits_touched_keys_only(spark, scratch):
    """A batch's output, and the state rows it updates, follow its own keys and not the history."""
    from labelset.streaming import incremental as inc

    _, u, gold = _inputs(spark)
    src, base = os.path.join(scratch, "touched-in"), os.path.join(scratch, "touched")
    rec = lambda i, kpi: Row(pos=i, record=json.dumps({"scenario_id": f"k{i}", "model": "m", "parsed_items": [{"kpi": kpi}]}))
    _land(src, "a.json", [rec(i, "CPA") for i in range(400)])
    inc.evaluate_stream(spark, src, base, u, gold)
    _land(src, "b.json", [rec(7, "CTR"), rec(8, "CPA")])
    inc.ingest_stream(spark, src, base, u).awaitTermination()
    q = inc.score_stream(spark, base, u, gold)
    q.awaitTermination()
    ops = [p for p in q.recentProgress if p["numInputRows"]][-1]["stateOperators"]
    assert {o["operatorName"] for o in ops} == {"dedupe", "stateStoreSave"}
    assert all(o["numRowsUpdated"] <= 2 and o["numRowsTotal"] >= 400 for o in ops)
    emitted = inc._batches(spark, inc._paths(base)["out"])
    out = spark.read.parquet(f"{inc._paths(base)['out']}/batch_id={emitted[-1]}")
    assert sorted((r.sid_norm, r.tp, r.fp) for r in out.collect()) == [("k7", 0, 2), ("k8", 0, 1)]


def test_stream_replays_a_batch_that_was_not_committed(spark, scratch):
    from labelset.streaming import incremental as inc

    df, u, gold = _inputs(spark)
    src, base = os.path.join(scratch, "replay-in"), os.path.join(scratch, "replay")
    rows = df.collect()
    _land(src, "a.json", rows[:3])
    inc.evaluate_stream(spark, src, base, u, gold, source="r.json")
    _land(src, "b.json", rows[3:])
    inc.evaluate_stream(spark, src, base, u, gold, source="r.json")
    want = _counts(evaluate_runs(df, u, gold).per_key)
    assert _counts(inc.current_scores(spark, base)) == want
    for query in ("ingest_checkpoint", "score_checkpoint"):  # as if the driver was lost before the last commit
        commits = os.path.join(inc._paths(base)[query], "commits")
        last = max(int(n) for n in os.listdir(commits) if n.isdigit())
        for name in (str(last), f".{last}.crc"):
            if os.path.exists(os.path.join(commits, name)):
                os.remove(os.path.join(commits, name))
    inc.evaluate_stream(spark, src, base, u, gold, source="r.json")
    assert _counts(inc.current_scores(spark, base)) == want


def test_entry_contract(spark):
    import __spark_entry__ as E

    out = E.entry(spark)
    assert out.count() > 0
    assert "precision" in out.columns and "c_mktsegment" in out.columns
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 25


def test_attached_gold_keeps_the_partitions(spark):
    """Small compressed parts are not joined into one task, where every run of a key repeats the gold."""
    recs = [(json.dumps({"scenario_id": f"S{i}", "model": f"m{j}", "parsed_items": [{"kpi": "cpa"}]}), i * 3 + j) for i in range(40) for j in range(3)]
    df = spark.createDataFrame(recs, "record string, pos long").withColumn("_source_file", F.lit("r.json"))
    u = spark.createDataFrame([("cpa",), ("roi",)], "norm string")
    gold = spark.createDataFrame([(f"s{i}", x) for i in range(40) for x in ("cpa", "roi", "roi")], "sid_norm string, item string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 6)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        s = evaluate_runs(df, u, gold)
        assert s.gold.rdd.getNumPartitions() == 6
        assert {(r.tp, r.fp, r.fn, r.tn) for r in s.per_key.collect()} == {(1, 0, 1, 0)} and s.per_key.count() == 120
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_batches_do_not_group_the_gold_again(spark):
    """Distinct gold pairs and the sizes of their keys come ready: a batch groups only its own rows."""
    import labelset.streaming.incremental as inc

    landed = spark.createDataFrame([("s", "m", "k", None, None, "a"), ("s", "m", "k", None, None, "a"), ("s", "m", "k", None, None, "x"),
                                    ("s", "m", "k", "K", 1, None), ("s", "m", "none", "N", 2, None)], inc.LANDED_SCHEMA)
    gold = spark.createDataFrame([("k", "a"), ("k", "b")], "sid_norm string, item string")
    counts = inc.keyed_counts(landed, gold)
    assert str(counts._jdf.queryExecution().optimizedPlan().toString()).count("Aggregate [") == 2
    sizes = spark.createDataFrame([("k", 2)], "sid_norm string, _gold long")
    rows = {r.sid_norm: (r.sid_raw, r.tp, r.fp, r.fn, r.tn, r.skipped) for r in inc.with_misses(counts, sizes, 10).collect()}
    assert rows == {"k": ("K", 1, 1, 1, 7, False), "none": ("N", 0, 0, 0, 10, True)}
