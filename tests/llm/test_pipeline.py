"""The pipeline stages against brute-force versions, and the registration of the queries."""

import os
import re

import pytest

import corpus_pipeline
from labelset.llm import decontaminate, jaccard_join, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(shipped, tmp_path_factory):
    """Input and output of each stage, through Parquet."""
    docs = shipped.read.parquet(f"{SF}/documents.parquet")
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / f"{k}")
        stage(shipped, docs, SF).write.parquet(path)
        after = shipped.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def test_stage_order_and_columns(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for name, (before, after) in staged.items():
        if name != "packing":
            assert after.dtypes == before.dtypes


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_quality_stage(staged):
    before, after = staged["quality_rules"]
    kept = {r.doc_id for r in quality_rules.ledger(before).where(quality_rules.passes()).select("doc_id").collect()}
    assert set(texts(after)) == kept and 0 < len(kept) < before.count()


def test_line_stage(staged):
    before, after = staged["line_dedup"]
    a, b = texts(before), texts(after)
    assert set(a) == set(b)
    seen = set()
    for i in sorted(a):
        old, new = (x.split("\n") if x else [] for x in (a[i], b[i]))
        assert set(new) <= set(old)
        for line in filter(str.strip, new):
            key = " ".join(re.findall(r"[^\x20\x09-\x0D]+", line))
            assert key not in seen
            seen.add(key)


def test_near_duplicate_stage(staged):
    before, after = staged["near_duplicates"]
    classes = {r.doc_id: r.class_id for r in jaccard_join.near_duplicates(before).collect()}
    assert set(texts(after)) == {i for i, c in classes.items() if i == c}


def test_decontamination_stage(staged, shipped):
    before, after = staged["decontamination"]
    forms = [decontaminate.normal(r.text) for r in shipped.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(texts(before)) - set(texts(after))
    for i, t in texts(before).items():
        exact = any(f and f in decontaminate.normal(t or "") for f in forms)
        assert not exact or i in gone


def test_packing_stage(staged):
    before, after = staged["packing"]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == set(texts(before))


def test_pipeline_runs_on_an_empty_table(shipped, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(shipped, docs, SF)
    assert docs.count() == 0


def test_registered_queries():
    names = list(corpus_pipeline.pipeline_queries())
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None


def test_no_other_module_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, files in os.walk(os.path.join(root, "labelset")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in folder:
                with open(os.path.join(folder, f)) as h:
                    assert "labelset.llm" not in h.read()
