"""Record keys, regression edge cases, JSON readers and sinks."""

import json
import math
import os

from pyspark.sql import functions as F

from labelset.operators import records as R
from labelset.operators.regression import regression_summary
from labelset.sources import json_docs as J
from labelset.sources.sinks import write_reports, write_results, write_sheets


def test_resolve_key_cases(spark):
    recs = ['{"scenario":{"slug":"X-1"}}', '{"scenario_id":7,"id":"x"}', '{"scenario_id":"", "name":"N 2"}',
            '{"id": {"name": "Óla"}}', '{}']
    df = spark.createDataFrame([(r,) for r in recs], "r string")
    raw, norm = R.resolve_key(F.from_json(F.col("r"), "map<string,variant>"))
    got = [(x.raw, x.norm) for x in df.select(raw.alias("raw"), norm.alias("norm")).collect()]
    assert got == [("X-1", "x 1"), ("", ""), ("N 2", "n 2"), ("Óla", "ola"), ("", "")]


def test_fill_total_and_labels(spark):
    df = spark.createDataFrame([(None, None, 5.0, "llama3.1:8b"), (3.0, 1.0, 1.0, "other"), (None, None, None, None)],
                               "total_tokens double, prompt_tokens double, completion_tokens double, model string")
    out = R.map_label(R.fill_total(df), "model", {"llama3.1:8b": "llama3.1:base"})
    got = [(r.total_tokens, r.model_label) for r in out.collect()]
    assert got == [(5.0, "llama3.1:base"), (3.0, "other"), (0.0, None)]
    assert R.ensure_columns(spark.range(1)).columns[-1] == "_source_file"


def test_regression_edge_cases(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.5), ("b", 1.0, 1.0), ("c", 5.0, 1.0), ("c", 5.0, 2.0),
            ("d", float("inf"), 1.0), ("d", 1.0, 3.0), (None, 2.0, 2.0), ("e", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in regression_summary(df, "x", "y", "g").collect()}
    assert set(got) == {"a", "b", "c", "d", "_overall_"}        # e has only a NaN row
    assert got["b"].n == 1 and got["b"].slope is None and got["b"].corr is None
    assert got["c"].n == 2 and got["c"].slope is None and got["c"].corr is None   # constant x
    assert got["d"].n == 2 and got["d"].slope is None             # one finite pair only
    assert math.isclose(got["a"].slope, 2.25) and math.isclose(got["a"].intercept, -0.3333333333333333)
    assert got["_overall_"].n == 9


def test_lenient_documents_and_results(spark, scratch):
    a = os.path.join(scratch, "results.json")
    with open(a, "w") as f:
        f.write('[{"scenario_id": "s1", "model": "m", "parsed_items": [{"kpi": "CPA"}]},\n 5, ]')
    b = os.path.join(scratch, "results_wcap.json")
    with open(b, "w") as f:
        f.write('{"results": [{"scenario_id": "s2", "latency_s": 1.5}], }')
    c = os.path.join(scratch, "broken.json")
    with open(c, "w") as f:
        f.write("{not json")
    docs = {r.file_name: r.text for r in J.read_json_lenient(spark, [a, b, c, a + ".missing"]).collect()}
    assert docs["broken.json"] is None and len(docs) == 3
    recs = J.results_table(J.read_results(spark, [a, b]))
    got = sorted((os.path.basename(r._source_file), r.scenario_id, r.latency_s) for r in recs.collect())
    assert got == [("results.json", "s1", None), ("results_wcap.json", "s2", 1.5)]


def test_same_named_files_stay_apart_and_written_results_read_back(spark, scratch):
    for k in "ab":
        os.makedirs(os.path.join(scratch, k))
        with open(os.path.join(scratch, k, "results.json"), "w") as f:
            f.write('[{"scenario_id": "%s"}]' % k)
    recs = J.read_results(spark, [os.path.join(scratch, k, "results.json") for k in "ab"])
    assert len({r._source_file for r in recs.collect()}) == 2
    df = spark.createDataFrame([("r1", "s", 1.5), ("r2", "t", None)], "request_id string, scenario_id string, latency_s double")
    out = os.path.join(scratch, "written")
    write_results(df, out)
    df.write.parquet(os.path.join(scratch, "p"))
    for path in (out, os.path.join(scratch, "p")):
        got = sorted((r.request_id, r.scenario_id, r.latency_s, r._source_file) for r in J.results_table(J.read_results(spark, path)).collect())
        assert got == [("r1", "s", 1.5, path), ("r2", "t", None, path)]


def test_single_quotes_are_not_json(spark, scratch):
    p = os.path.join(scratch, "q.json")
    with open(p, "w") as f:
        f.write("[{'scenario_id': 's1'}]")
    assert J.read_results(spark, p).count() == 0


def test_last_gold_key_of_a_normal_form_wins(spark, scratch):
    gp = os.path.join(scratch, "g2.json")
    with open(gp, "w") as f:
        f.write('{"A b": ["CPA"], "a-b": ["ROI"], "A  B": [], "c": ["Alfa\u2026Beta", "eﬁciência"]}')
    u = spark.createDataFrame([("cpa", "CPA"), ("roi", "ROI"), ("alfa beta", "x"), ("eficiencia", "y")], "norm string, canon string").withColumn("tokens", F.split("norm", " "))
    gold = {(r.sid_norm, r.item) for r in J.read_gold(spark, gp, u).collect()}
    assert gold == {("a b", "roi"), ("c", "alfa beta"), ("c", "eficiencia")}


def test_gold_and_universe(spark, scratch):
    up = os.path.join(scratch, "u.json")
    with open(up, "w") as f:
        f.write('["Custo por Aquisição (CPA)", "Taxa de Conversão", "Lead Time",]')
    u = J.read_universe(spark, up)
    norms = {r.norm for r in u.collect()}
    assert {"custo por aquisicao cpa", "cpa", "taxa de conversao", "lead time", "dau mau"} <= norms
    gp = os.path.join(scratch, "g.json")
    with open(gp, "w") as f:
        json.dump({"S-1": [{"kpi": "CPA"}, {"KPI": "Lead Time for Changes"}, {"kpi": "nada aqui"}],
                   "S-2": "not a list", "S-3": ["Taxa de Conversão Geral"]}, f)
    gold = {(r.sid_norm, r.item) for r in J.read_gold(spark, gp, u).collect()}
    assert gold == {("s 1", "cpa"), ("s 1", "lead time"), ("s 3", "taxa de conversao")}


def test_sinks(spark, scratch):
    df = spark.createDataFrame([("f.json", "llama3.1:8b", "k", 0.5)], "source string, model string, key string, v double")
    write_reports(df, os.path.join(scratch, "reports"))
    back = spark.read.json(os.path.join(scratch, "reports"))
    assert back.select("model_slug").collect()[0].model_slug == "llama3_1_8b"
    paths = write_sheets({"runs/x": df, "macro": df}, scratch, "kpi_charts_data")
    assert [os.path.basename(p) for p in paths] == ["kpi_charts_data__runs_x", "kpi_charts_data__macro"]
    assert spark.read.option("header", True).csv(paths[1]).count() == 1


def test_report_documents_are_whole_json(spark, scratch):
    from labelset.plans.scoring import evaluate_runs, scenario_report
    from labelset.sources.sinks import write_report_documents

    u = spark.createDataFrame([("cpa",), ("roi",), ("cpl",)], "norm string")
    gold = spark.createDataFrame([("a", "cpa"), ("b 1", "roi"), ("b 1", "cpl")], "sid_norm string, item string")
    recs = [{"scenario_id": "A", "model": "m/1", "parsed_items": [{"kpi": "CPA"}, {"kpi": "ROI"}]}, {"scenario_id": 'B "1"', "model": "m/1"},
            {"scenario_id": "Z\\", "model": "m/1"}, {"scenario_id": "y", "model": "m/1"}, {"scenario_id": "a", "model": "m 1"}, {"model": "none"}]
    df = spark.createDataFrame([("in/r.json", i, json.dumps(r)) for i, r in enumerate(recs)], "_source_file string, pos long, record string")
    s = evaluate_runs(df, u, gold)
    out = os.path.join(scratch, "docs")
    write_report_documents(scenario_report(s), s.macro, s.totals, s.skipped, out)
    docs = {}
    for folder, _, names in os.walk(out):
        for name in names:
            if name.startswith("part-"):
                with open(os.path.join(folder, name)) as f:
                    doc = json.load(f)
                docs[doc["model_name"]] = doc
    assert set(docs) == {"m/1", "m 1", "none"}
    doc = docs["m/1"]
    assert doc["file"] == "in/r.json" and list(doc["by_scenario"]) == ["A", 'B "1"'] and doc["skipped_scenarios"] == ["y", "Z\\"]
    assert doc["by_scenario"]["A"] == {"TP": 1, "FP": 1, "FN": 0, "TN": 1, "precision": 0.5, "recall": 1.0, "f1": doc["by_scenario"]["A"]["f1"], "denom": 4.0,
                                       "mcc": 0.5, "npv": 1.0, "fdr": 0.5, "pred": ["cpa", "roi"], "gold": ["cpa"], "sid_norm": "a"}
    assert doc["totals"] == {"TP": 1, "FP": 1, "FN": 2, "TN": 2} and doc["evaluated_scenarios"] == 2
    assert docs["none"]["by_scenario"] == {} and docs["none"]["macro_avg"]["f1"] == 0.0
    macro = {r.model_raw: r for r in J.read_report_folder(spark, out, {"m/1": "M"}, "base").collect()}
    assert set(macro) == set(docs) and macro["m/1"].model_label == "M" and macro["m/1"].run == "in/r.json"
    assert abs(macro["m/1"].macro_precision - doc["macro_avg"]["precision"]) < 1e-12
    back = {(r.model, r.sid_raw): (r.TP, r.gold) for r in J.read_report_scenarios(spark, out).collect()}
    assert back == {("m/1", "A"): (1, ["cpa"]), ("m/1", 'B "1"'): (0, ["cpl", "roi"]), ("m 1", "A" if ("m 1", "A") in back else "a"): (0, ["cpa"])}


def test_chart_tables(spark, scratch):
    from labelset.plans.charts import chart_tables

    with open(os.path.join(scratch, "eval_results__llama3_1_8b.json"), "w") as f:
        json.dump({"model_name": "llama3.1:8b", "macro_avg": {"precision": 0.5, "recall": 0.25,
                                                              "f1": 0.3, "mcc": 0.2}}, f)
    with open(os.path.join(scratch, "results.json"), "w") as f:
        json.dump([{"model": "llama3.1:8b", "scenario_id": "a", "condition": "unlimited",
                    "latency_s": 1.0, "prompt_tokens": 10, "completion_tokens": 5, "total_tokens": None},
                   {"model": "llama3.1:8b", "scenario_id": "b", "condition": "unlimited",
                    "latency_s": 2.0, "total_tokens": 30},
                   {"model": "x", "scenario_id": "c", "condition": "limited", "latency_s": None}], f)
    t = chart_tables(spark, scratch)
    macro = t["macro"].collect()
    assert [(r.run, r.model_label, r.macro_precision) for r in macro] == [("baseline_no_wcap", "llama3.1:base", 0.5)]
    assert t["runs"].count() == 3 and t["tokens_latency"].count() == 2
    cs = {r.model_label: r for r in t["corr_summary"].collect()}
    assert cs["llama3.1:base"].n == 2 and abs(cs["llama3.1:base"].slope - 1 / 15) < 1e-12
    assert cs["_overall_"].n == 2


def test_small_record_helpers(spark, scratch):
    from labelset.operators import metrics as M
    from labelset.sources.sinks import write_results

    df = spark.createDataFrame([("a", None, 1.0), ("b", "TimeoutError: x", float("nan")), ("c", None, float("inf"))],
                               "model string, error string, v double")
    failed, ok = R.split_errors(df)
    assert [r.model for r in failed.collect()] == ["b"] and ok.count() == 2
    assert [r.model for r in R.drop_missing(df, ["v"]).collect()] == ["a", "c"]
    assert [r.model for r in R.finite_only(df, ["v"]).collect()] == ["a"]
    labels = spark.createDataFrame([("a", "A!")], "model string, label string")
    assert {r.model: r.model_label for r in R.label_lookup(df, labels, "model").collect()} == \
        {"a": "A!", "b": "b", "c": "c"}
    recs = spark.createDataFrame([("k", "Raw-K", 2), ("k", "raw k", 1), ("j", "J", 5)], "sid string, raw string, pos int")
    assert {r.sid: r.raw for r in M.first_raw_key(recs, ["sid"], "raw", "pos").collect()} == {"k": "raw k", "j": "J"}
    write_results(df, os.path.join(scratch, "res"))
    assert spark.read.json(os.path.join(scratch, "res")).count() == 3


def test_scenario_report_lists(spark):
    from labelset.functions.text import expand_universe
    from labelset.plans.scoring import evaluate_runs, scenario_report

    u = expand_universe(spark.createDataFrame([("CPA",), ("CTR",), ("ROI",)], "n string"), "n")
    gold = spark.createDataFrame([("s", "ctr"), ("s", "cpa")], "sid_norm string, item string")
    recs = spark.createDataFrame([("f", 0, json.dumps({"scenario_id": "S", "model": "m",
                                                        "parsed_items": [{"kpi": "ROI"}, {"kpi": "CTR"}]}))],
                                 "_source_file string, pos long, record string")
    rep = scenario_report(evaluate_runs(recs, u, gold)).collect()
    assert len(rep) == 1 and rep[0].pred == ["ctr", "roi"] and rep[0].gold == ["cpa", "ctr"]
    assert (rep[0].tp, rep[0].fp, rep[0].fn) == (1, 1, 1)


def test_report_with_empty_model_gets_base_label(spark, scratch):
    from labelset.sources.dimensions import DEFAULT_REPORT_LABEL, MODEL_LABELS

    a = os.path.join(scratch, "a.json")
    with open(a, "w") as f:
        json.dump({"model_name": "", "macro_avg": {"precision": 0.1}}, f)
    b = os.path.join(scratch, "b.json")
    with open(b, "w") as f:
        json.dump({"model_name": "meta-llama-3.1-8b.Q4_K_M:latest", "macro_avg": {"recall": 0.2}}, f)
    df = J.read_reports(spark, {"r1": a, "r2": b, "r3": os.path.join(scratch, "missing.json")},
                        MODEL_LABELS, DEFAULT_REPORT_LABEL)
    got = {r.run: (r.model_label, r.macro_precision, r.macro_recall) for r in df.collect()}
    assert got == {"r1": ("llama3.1:base", 0.1, None), "r2": ("llama3.1:trained", None, 0.2)}


def test_many_files_with_own_columns_in_one_scan(spark, scratch):
    paths, want = [], set()
    for k in range(60):
        p = os.path.join(scratch, f"f {k}+%.jsonl") if k % 2 else os.path.join(scratch, f"d{k}")
        os.makedirs(p) if k % 2 == 0 else None
        with open(p if k % 2 else os.path.join(p, "part-0.json"), "w") as f:
            f.write(json.dumps({"request_id": f"r{k}", f"own{k}": k}) + "\n" + "not json\n")
        paths.append(p)
        want.add((p, f"r{k}", f"own{k}"))
    recs = J.read_results(spark, paths, layout="lines")
    assert {(r._source_file, json.loads(r.record)["request_id"], list(json.loads(r.record))[1]) for r in recs.collect()} == want
    plan = J.read_results(spark, paths, layout="lines")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1
