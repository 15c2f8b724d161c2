"""Set metrics: published golden rows, edge rows and properties against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from labelset.operators import metrics as M

# Fixed golden rows of the published reports (|U| = 315): (tp, fp, fn, tn) -> metrics.
GOLDEN = [
    ((2, 1, 3, 309), dict(precision=0.6666666666666666, recall=0.4, f1=0.5, denom=1450800.0,
                          mcc=0.5105888684213858, npv=0.9903846153846154, fdr=0.3333333333333333)),
    ((4, 0, 7, 304), dict(precision=1.0, recall=0.36363636363636365, f1=0.5333333333333333,
                          denom=4159936.0, mcc=0.5961976369733877, npv=0.977491961414791, fdr=0.0)),
    ((0, 0, 5, 310), dict(precision=0.0, recall=0.0, f1=0.0, denom=0.0, mcc=0.0,
                          npv=0.9841269841269841, fdr=0.0)),
    ((0, 1, 6, 308), dict(precision=0.0, recall=0.0, f1=0.0, denom=582156.0,
                          mcc=-0.007863783737848717, npv=0.9808917197452229, fdr=1.0)),
    ((0, 4, 5, 306), dict(precision=0.0, recall=0.0, f1=0.0, denom=1928200.0,
                          mcc=-0.014403033021983288, npv=0.9839228295819936, fdr=1.0)),
]


def test_golden_metric_rows(spark):
    df = spark.createDataFrame([g[0] for g in GOLDEN], "tp long, fp long, fn long, tn long")
    got = {(r.tp, r.fp, r.fn, r.tn): r for r in M.set_metrics(df).collect()}
    for counts, want in GOLDEN:
        row = got[counts]
        for k, v in want.items():
            assert math.isclose(row[k], v, rel_tol=1e-12, abs_tol=1e-15), (counts, k, row[k], v)


def test_confusion_from_published_lists(spark):
    # pred/gold lists of the first published row; the universe has 315 entries
    pred = ["cpl", "roi", "taxa de qualificacao"]
    gold = ["cpa", "cpl", "ctr", "taxa de conversao de landing page", "taxa de qualificacao"]
    universe = spark.createDataFrame([(x,) for x in set(pred + gold)] +
                                     [(f"filler {i}",) for i in range(315 - len(set(pred + gold)))],
                                     "norm string")
    p = spark.createDataFrame([("k", x) for x in pred + pred], "key string, item string")
    g = spark.createDataFrame([("k", x) for x in gold], "key string, item string")
    row = M.set_metrics(M.set_confusion(p, g, ["key"], "item", universe=universe)).collect()[0]
    assert (row.tp, row.fp, row.fn, row.tn) == (2, 1, 3, 309)
    assert math.isclose(row.mcc, 0.5105888684213858, rel_tol=1e-12)


def test_empty_prediction_and_skipped(spark):
    universe = spark.createDataFrame([(x,) for x in "abcdef"], "norm string")
    seen = spark.createDataFrame([("m", "k1"), ("m", "k2"), ("m", "k3")], "model string, key string")
    pred = spark.createDataFrame([("m", "k1", "a"), ("m", "k3", "z")], "model string, key string, item string")
    gold = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k2", "c")], "key string, item string")
    gold_att = M.attach_gold(seen, gold, ["key"])
    conf = M.set_confusion(pred, gold_att, ["model", "key"], "item", universe=universe)
    rows = {r.key: r for r in conf.collect()}
    assert set(rows) == {"k1", "k2"}               # k3 has no gold -> skipped
    assert (rows["k2"].tp, rows["k2"].fp, rows["k2"].fn, rows["k2"].tn) == (0, 0, 1, 5)
    assert (rows["k1"].tp, rows["k1"].fn, rows["k1"].tn) == (1, 1, 4)
    skipped = M.skipped_keys(seen, conf.select("model", "key"), ["model", "key"]).collect()
    assert [r.key for r in skipped] == ["k3"]
    groups = spark.createDataFrame([("m",), ("empty",)], "model string")
    macro = {r.model: r for r in M.macro_average(M.set_metrics(conf), ["model"], groups).collect()}
    assert macro["empty"].evaluated == 0 and macro["empty"].precision == 0.0
    assert macro["m"].evaluated == 2
    tot = {r.model: r for r in M.totals(M.set_metrics(conf), ["model"],
                                        M.skipped_keys(seen, conf.select("model", "key"), ["model", "key"]),
                                        groups).collect()}
    assert (tot["m"].tp, tot["m"].fn, tot["m"].skipped, tot["empty"].evaluated) == (1, 2, 1, 0)


def test_denominator_does_not_overflow(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(big, big, big, big)], "tp long, fp long, fn long, tn long")
    row = M.set_metrics(df).collect()[0]
    assert row.denom == pytest.approx(float(2 * big) ** 4)


def _brute(pred, gold, u):
    p, g = set(pred) & u, set(gold) & u
    tp, fp, fn = len(p & g), len(p - g), len(g - p)
    return tp, fp, fn, max(len(u) - tp - fp - fn, 0)


def test_confusion_matches_brute_force(spark):
    rnd = random.Random(7)
    u = {f"i{j}" for j in range(30)}
    keys = [f"k{j}" for j in range(40)]
    pred_rows, gold_rows, expect = [], [], {}
    for k in keys:
        pr = [f"i{rnd.randrange(40)}" for _ in range(rnd.randrange(8))]
        go = [f"i{rnd.randrange(40)}" for _ in range(rnd.randrange(8))]
        pred_rows += [(k, x) for x in pr]
        gold_rows += [(k, x) for x in go]
        if set(go) & u:
            expect[k] = _brute(pr, go, u)
    uni = spark.createDataFrame([(x,) for x in u], "norm string")
    p = spark.createDataFrame(pred_rows, "key string, item string")
    g = spark.createDataFrame(gold_rows, "key string, item string")
    got = {r.key: (r.tp, r.fp, r.fn, r.tn) for r in M.set_confusion(p, g, ["key"], universe=uni).collect()}
    assert got == expect
    assert all(sum(v) == len(u) for v in got.values())


def test_array_form_equals_long_form(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "d"])], "p array<string>, g array<string>")
    c = M.array_confusion(F.col("p"), F.col("g"), F.lit(10))
    row = df.select(*[v.alias(k) for k, v in c.items()]).collect()[0]
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 2, 1, 6)


# Per-scenario counts (tp, fp, fn, tn) of one published report (baseline model,
# unlimited condition), and its published macro averages and totals.
REPORT_COUNTS = [
    (2, 1, 3, 309), (1, 2, 9, 303), (2, 2, 5, 306), (4, 0, 7, 304), (2, 1, 4, 308), (1, 2, 5, 307),
    (1, 2, 7, 305), (0, 0, 5, 310), (1, 1, 5, 308), (3, 1, 3, 308), (2, 2, 3, 308), (2, 0, 3, 310),
    (0, 1, 6, 308), (1, 1, 5, 308), (2, 3, 4, 306), (2, 0, 2, 311), (0, 3, 4, 308), (2, 2, 4, 307),
    (1, 1, 3, 310), (1, 0, 3, 311), (1, 1, 4, 309), (1, 3, 4, 307), (1, 2, 4, 308), (0, 4, 5, 306),
]
REPORT_MACRO = dict(precision=0.4819444444444445, recall=0.23643127705627706, f1=0.3098644411144411,
                    denom=1649808.6666666667, mcc=0.3251564767802468, npv=0.985717113584417,
                    fdr=0.4763888888888888)
REPORT_TOTALS = (33, 35, 107, 7385)


def test_published_macro_and_totals(spark):
    df = spark.createDataFrame([("m", i, *c) for i, c in enumerate(REPORT_COUNTS)],
                               "model string, k int, tp long, fp long, fn long, tn long")
    m = M.set_metrics(df)
    macro = M.macro_average(m, ["model"]).collect()[0]
    for k, v in REPORT_MACRO.items():
        assert math.isclose(macro[k], v, rel_tol=1e-12), (k, macro[k], v)
    assert macro.evaluated == 24
    tot = M.totals(m, ["model"]).collect()[0]
    assert (tot.tp, tot.fp, tot.fn, tot.tn) == REPORT_TOTALS
