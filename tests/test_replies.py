"""Reply salvage (fixture edge cases) and the native folds against the Arrow scans."""

import random

from pyspark.sql import functions as F

from labelset.functions import replies as RP


def rows(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_fences_and_first_array(spark):
    assert rows(spark, ["```json\n[1]\n```"], RP.strip_fences) == ["[1]"]
    assert rows(spark, ['x [{"k":"a]\\"b"}] y ]', '[{"kpi":"a"}', "plain"], RP.extract_json_array) == \
        ['[{"k":"a]\\"b"}]', '[{"kpi":"a"}', "plain"]


def test_sanitize_cases(spark):
    vals = ['[{"kpi":"a"}', '{"kpi":"a"}', "[]", "no json",
            '[{"Métrica": "p, q;r|", "KPI": " x "}, {"kpi": 0}, 5, "s"]']
    out = rows(spark, vals, lambda c: RP.sanitize_reply(c))
    assert [(len(o.items), o.valid, o.issues) for o in out] == [
        (1, True, ["array_parse_failed"]), (1, True, ["array_parse_failed"]),
        (0, False, ["empty_array_after_normalize"]),
        (0, False, ["array_parse_failed", "unrecoverable_objects"]),
        (1, True, [])]
    last = out[-1].items[0]
    assert (last.kpi, last.metricas) == ("x", ["p", "q", "r"])
    assert out[-1].output == '[{"kpi":"x","importancia":"","formula":"","metricas":["p","q","r"]}]'


def test_limited_caps_after_validity(spark):
    reply = "[" + ",".join(f'{{"kpi":"k{i}"}}' for i in range(6)) + "]"
    df = spark.createDataFrame([(reply, True), (reply, False)], "t string, lim boolean")
    got = [len(r.s.items) for r in df.select(RP.sanitize_reply(F.col("t"), F.col("lim")).alias("s")).collect()]
    assert got == [4, 6]


def test_to_string_list_and_keys(spark):
    vals = ['{"metricas": "a, b;c|"}', '{"metricas": ["a", 1, null, {"x": 1}, true]}',
            '{"metricas": 3}', '{"formula": "f"}']
    out = rows(spark, vals, lambda c: RP.normalize_item(F.from_json(c, "map<string,variant>")))
    assert [o.metricas for o in out] == [["a", "b", "c"], ["a", "1", "True"], ["3"], []]
    assert rows(spark, ["Métrica", " FÓRMULA ", "other"], RP.normalize_key) == ["metricas", "formula", "other"]


def test_extract_items(spark):
    df = spark.createDataFrame([
        ('[{"KPI":"  a "},{"nome":"b"},{"name":5,"kpi":""}]', None),
        (None, '[{"kpi":"a","metricas":["x"]}]'),
        (None, 'pre ["a"," b ", 3] post'),
        ("[]", '[{"Kpi":"z"}]')], "p string, o string")
    got = [r.x for r in df.select(RP.extract_items(F.col("p"), F.col("o")).alias("x")).collect()]
    assert got == [["a", "b"], [], ["a", "b"], ["z"]]


def test_native_folds_equal_arrow_scans(spark):
    rnd = random.Random(1)
    alphabet = '[]{}"\\ ab,:'
    vals = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 25))) for _ in range(400)]
    a = rows(spark, vals, RP.extract_json_array)
    b = rows(spark, vals, RP.extract_json_array_native)
    assert a == b
    c = rows(spark, vals, RP.salvage_json_objects)
    d = rows(spark, vals, RP.salvage_json_objects_native)
    assert c == d
