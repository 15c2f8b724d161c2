"""Prompt grid, prompt hashes and the responder hook."""

import hashlib
import os
import time

import pytest

from labelset.plans import generation as G
from labelset.sources.dimensions import MODELS, scenarios_df


def test_grid_and_prompt_hash(spark):
    grid = G.build_grid(scenarios_df(spark), MODELS)
    assert grid.count() == 25 * 2 * 2
    p = G.build_prompts(grid).filter("id = 'ads_imob_cpl' AND condition = 'limited'").collect()
    assert len(p) == 2
    row = p[0]
    user = ("Contexto:\n- nicho: " + row.nicho + "\n- area: " + row.area + "\n- objetivo: " +
            row.objetivo + "\n\nTarefa: recomende KPIs até 4 adequados ao contexto.\n\n"
            "Formato OBRIGATÓRIO (array JSON bruto, sem markdown):\n"
            '[{"kpi":"...","importancia":"...","formula":"...","metricas":["..."]}, ...]')
    assert row.user == user
    want = hashlib.sha256((G.SYSTEM_PROMPT + "\n" + user).encode("utf-8")).hexdigest()[:12]
    assert row.prompt_hash == want
    first = grid.orderBy("scenario_pos", "model_pos", "condition_pos").first()
    assert (first.id, first.model, first.condition) == ("attr_streaming_mix", MODELS[0], "unlimited")


def test_responder_errors_are_recorded_per_row(spark):
    def flaky(model, system, user):
        if "boom" in user:
            raise ValueError("boom")
        return {"content": '[{"kpi": "a"}, {"kpi": "b"}, {"kpi": "c"}, {"kpi": "d"}, {"kpi": "e"}]',
                "prompt_tokens": 3, "completion_tokens": 2}

    prompts = spark.createDataFrame(
        [("r1", "s1", "m", "unlimited", "sys", "hello"), ("r2", "s2", "m", "limited", "sys", "hello"),
         ("r3", "s3", "m", "unlimited", "sys", "boom")],
        "request_id string, scenario_id string, model string, condition string, system string, user string")
    scored = G.score_replies(G.apply_responder(prompts, flaky, n_partitions=2))
    rows = {r.request_id: r for r in scored.collect()}
    assert rows["r3"].error == "ValueError: boom" and rows["r3"].parsed_items is None
    assert len(rows["r1"].parsed_items) == 5 and rows["r1"].total_tokens == 5
    assert len(rows["r2"].parsed_items) == 4 and rows["r2"].issues is None
    assert rows["r1"].issues == [] and rows["r1"].latency_s >= 0
    summ = {(r.condition, r.model): r for r in G.run_summary(scored).collect()}
    assert summ[("unlimited", "m")].n_failed == 1 and summ[("unlimited", "m")].n_valid == 1


def _prompts(spark, n=24, text="hello"):
    return spark.createDataFrame([(f"r{i}", f"s{i}", "m", "unlimited", "sys", f"{text} {i}") for i in range(n)],
                                 "request_id string, scenario_id string, model string, condition string, system string, user string")


def test_killed_run_goes_on_without_repeated_calls(spark, scratch, monkeypatch):
    log, out = os.path.join(scratch, "calls"), os.path.join(scratch, "out")

    def counted(model, system, user):
        with open(log, "a") as f:
            f.write(user + "\n")
        return {"content": '[{"kpi": "a"}]', "prompt_tokens": 1, "completion_tokens": 1}

    write, left = G._append_results, [2]

    def dies(df, folder):
        if not left[0]:
            raise KeyboardInterrupt
        left[0] -= 1
        write(df, folder)

    monkeypatch.setattr(G, "_append_results", dies)
    with pytest.raises(KeyboardInterrupt):
        G.generate_runs(_prompts(spark), out, counted, slices=5)
    monkeypatch.setattr(G, "_append_results", write)
    with open(log) as f:
        first = f.read().split("\n")[:-1]
    assert 0 < len(first) < 24
    rows = G.generate_runs(_prompts(spark), out, counted, slices=5).collect()
    with open(log) as f:
        calls = f.read().split("\n")[:-1]
    assert len(rows) == 24 and sorted(calls) == sorted(f"hello {i}" for i in range(24))
    assert len({r.run_id for r in rows}) == 2 and all(r.error is None and r.total_tokens == 2 for r in rows)
    again = G.generate_runs(_prompts(spark, 24, "other"), out, counted, slices=2).collect()  # other prompts, same ids
    assert len(again) == 24 and {r.run_id for r in again}.isdisjoint({r.run_id for r in rows})


def test_retries_timeouts_and_failed_requests(spark, scratch):
    log = os.path.join(scratch, "tries")

    def shaky(model, system, user):
        with open(log, "a") as f:
            f.write(user + "\n")
        with open(log) as f:
            tries = f.read().split("\n").count(user)
        if user.endswith(" 0") and tries < 3:
            raise ValueError("not yet")
        if user.endswith(" 1"):
            time.sleep(5)
        if user.endswith(" 2") and tries <= 2:
            raise RuntimeError("down")
        return {"content": "[]"}

    out = os.path.join(scratch, "shaky")
    got = {r.request_id: r for r in G.generate_runs(_prompts(spark, 4).filter("request_id <> 'r2'"), out, shaky, slices=1, retries=2, timeout_s=0.5, concurrency=3).collect()}
    assert (got["r0"].attempts, got["r0"].error) == (3, None)
    assert got["r1"].attempts == 3 and got["r1"].error.startswith("TimeoutError") and got["r1"].total_tokens is None
    assert got["r3"].attempts == 1
    two = _prompts(spark, 4).filter("request_id = 'r2'")
    assert G.generate_runs(two, os.path.join(scratch, "two"), shaky, slices=1, retries=1).first().error == "RuntimeError: down"
    assert G.generate_runs(two, os.path.join(scratch, "two"), shaky, slices=1, retries=1).first().error is None
    assert G.generate_runs(_prompts(spark, 1).limit(0), os.path.join(scratch, "none"), shaky).count() == 0
