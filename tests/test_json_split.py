"""Reading results documents in parts gives the rows of the whole-document reader."""

import json
import os
import random

import pytest

from labelset.sources.json_docs import read_results
from labelset.sources.json_split import split_results

CASES = {
    "bare": '[{"a": 1}, {"b": "}{][\\"x"}, {"c": {"d": [1, {"e": "\\\\"}]}}]',
    "spaces": ' \n[\n {"a": 1}\n ,\n {"b": 2}\n]\n ',
    "mixed": '[1, "x}", {"a": 1}, [2, [{"n": 1}]], null, {"b": 2}, 3.5, "y"]',
    "trailing": '[{"a": 1,}, {"b": [1, 2,]}, ]\n',
    "trailing_in_text": '[{"a": "x,]"}, {"b": "y, }"},]',
    "under": '{"results": [{"a": 1}, {"b": [{"c": 2}]}], "n": {"x": {"y": 1}}, "l": [{"z": 1}]}',
    "under_trailing": '{"results": [\n{"a": 1},\n{"b": 2},\n],}',
    "under_end": '{"results": [{"a": 1}]}',
    "under_twice": '{"results": [{"a": 1}], "results": [{"b": 2}]}',
    "under_late": '{"meta": [{"x": 1}], "results": [{"a": 1}, {"b": 2}]}',
    "no_results": '{"other": [{"a": 1}]}',
    "empty_list": "[]", "empty_under": '{"results": [ ]}', "empty": "", "blank": " \n", "word": "hello }", "object": '{"a": 1}',
    "cut": '[{"a": 1}, {"b": 2}', "cut_in_text": '[{"a": 1}, {"b": "xy', "cut_after_comma": '[{"a": 1},', "cut_under": '{"results": [{"a": 1}]',
    "no_comma": '[{"a": 1} {"b": 2}]', "two_commas": '[{"a": 1},, {"b": 2}]', "mismatch": '[{"a": 1], {"b": 2}]', "bad_value": '[{"a": tru}, {"b": 2}]',
    "bad_tail": '[{"a": 1}, {"b": 2}, x]', "after": '[{"a": 1}] {"b": 2}', "first_comma": '[, {"a": 1}]', "unicode": '[{"é": "ü}"}, {"k": "日本"}]',
    "mark": "﻿" + '[{"a": 1}, {"b": 2}]', "escape": '[{"a": "\\\\\\"}"}, {"b": "\\u007d"}]',
}


def key(rows):
    return sorted((f, p, json.dumps(r, sort_keys=True)) for f, p, r in rows)


def collected(df):
    return key((r["_source_file"].rsplit("/", 1)[-1], r["pos"], json.loads(r["record"])) for r in df.collect())


@pytest.fixture()
def small_blocks(spark):
    """Blocks of a few bytes, so that every case is cut at many places."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", n), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    for k, v in held.items():
        spark.conf.set(k, v)


def test_cases_equal_whole_reader(spark, scratch, small_blocks):
    for name, text in CASES.items():
        with open(os.path.join(scratch, f"{name}.json"), "w", encoding="utf-8") as f:
            f.write(text)
    with open(os.path.join(scratch, "bytes.json"), "wb") as f:
        f.write(b'[{"a": "x\xff}y"}, {"b": 2}]')
    want = collected(read_results(spark, f"{scratch}/*.json", layout="documents", split_bytes=1 << 40))
    assert {f for f, _, _ in want} >= {"bare.json", "mixed.json", "trailing.json", "under.json", "bytes.json", "escape.json"}
    small_blocks(24)
    assert collected(read_results(spark, f"{scratch}/*.json", layout="documents", split_bytes=0)) == want


def test_random_documents_in_many_tasks(spark, scratch, small_blocks):
    rng = random.Random(6)

    def value(depth=0):
        kind = rng.random()
        if kind < 0.4 or depth > 2:
            return rng.choice([1, None, True, "}", "a\"b", "{[", "\\", "x,]", "é", 2.5, ""])
        return [value(depth + 1) for _ in range(rng.randint(0, 3))] if kind < 0.6 else {f"k{i}": value(depth + 1) for i in range(rng.randint(0, 3))}

    for n in range(6):
        records = [{"n": i, "v": value()} for i in range(60)]
        doc = records if n % 2 else {"results": records, "meta": {"a": [{"b": value()}]}}
        with open(os.path.join(scratch, f"{n}.json"), "w") as f:
            json.dump(doc, f, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
    want = collected(read_results(spark, f"{scratch}/*.json", layout="documents", split_bytes=1 << 40))
    assert len(want) == 360
    small_blocks(500)
    paths = [os.path.join(scratch, f"{n}.json") for n in range(6)]
    assert spark.read.option("lineSep", "}").text(paths).rdd.getNumPartitions() > 30
    records, left = split_results(spark, paths)
    assert collected(records) == want and left.count() == 0


GOLD = {
    "plain": '{"s1": [{"kpi": "CPA"}, {"KPI": "Roi"}], "s2": ["lead time", "x]"], "none": "no list"}',
    "spaces": ' \n{\n "a" : [ "CPA" ]\n , "b":["ROI", {"kpi": {"n": [1]}}] \n}\n ',
    "keys": '{"A b": ["CPA"], "a-b": ["ROI"], "A  B": [], "c": "x]", "d": {"e": ["CPA"]}, "f": [["CPA"]], "g": ["CPA"]}',
    "trailing": '{"a": ["CPA",], "b": ["ROI"],}\n', "trailing_in_text": '{"a": ["x,]", "CPA"], "b]": ["ROI"],}',
    "last_list": '{"a": ["CPA"], "b": ["ROI"]}', "empty": "{}", "empty_list": '{"a": []}', "blank": " \n", "word": "hello ]",
    "list": '[["CPA"], {"a": ["ROI"]}]', "no_lists": '{"a": 1, "b": "ROI"}', "twice": '{"a": ["CPA"], "a": ["ROI"]}',
    "cut": '{"a": ["CPA"], "b": ["ROI"]', "cut_in_text": '{"a": ["CPA"], "b": ["RO', "cut_after_comma": '{"a": ["CPA"],', "no_comma": '{"a": ["CPA"] "b": ["ROI"]}',
    "two_commas": '{"a": ["CPA"],, "b": ["ROI"]}', "mismatch": '{"a": ["CPA"}, "b": ["ROI"]}', "bad_value": '{"a": [tru], "b": ["ROI"]}', "after": '{"a": ["CPA"]} ["b"]',
    "first_comma": '{, "a": ["CPA"]}', "escape": '{"a\\\\\\"]": ["CPA", "\\u005d"], "b": ["\\"]", "ROI"]}', "mark": "﻿" + '{"a": ["CPA"]}', "unicode": '{"é日": ["CPA"], "b": ["Éfi"]}',
}


def test_gold_in_parts_equals_whole_reader(spark, scratch, small_blocks):
    from labelset.sources.json_docs import _gold_members, read_gold
    from pyspark.sql import functions as F

    for name, text in GOLD.items():
        with open(os.path.join(scratch, f"{name}.json"), "w", encoding="utf-8") as f:
            f.write(text)
    with open(os.path.join(scratch, "bytes.json"), "wb") as f:
        f.write(b'{"a": ["x\xff]y"], "b": ["CPA"]}')
    found = lambda least: {(r["path"].rsplit("/", 1)[-1][:-5], r["at"], r["key"], r["value"])
                           for r in _gold_members(spark, f"{scratch}/*.json", least).collect()}
    want = found(1 << 40)
    assert {m for m, *_ in want} >= {"plain", "spaces", "keys", "trailing", "trailing_in_text", "last_list", "escape", "unicode", "bytes", "twice"}
    small_blocks(64)
    assert found(0) == want
    lists = [[{"kpi": f"n{j}"} for j in range(i % 4)] if i % 3 else f"]{i}" for i in range(200)]
    small_blocks(1500)
    big = os.path.join(scratch, "big")
    with open(big, "w") as f:
        f.write("{" + ",\n".join(f'"K-{i}": {json.dumps(v)}' for i, v in enumerate(lists)) + ',"k 7": ["n2"]}')
    u = spark.createDataFrame([("n0",), ("n2",)], "norm string").withColumn("canon", F.col("norm")).withColumn("tokens", F.split("norm", " "))
    rows = lambda least: sorted((r.sid_norm, r.sid_raw, r.item) for r in read_gold(spark, big, u, split_bytes=least).collect())
    assert rows(0) == rows(1 << 40) and ("k 7", "k 7", "n2") in rows(0)
