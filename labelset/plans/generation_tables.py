"""Prompt grid and responder runs on the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelset.plans import generation as G
from labelset.session import scratch_path
from labelset.plans.registry import register, table
from labelset.sources.dimensions import MODELS


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_user(nicho: str, area: str, objetivo: str, limited: str) -> str:
    return (f"{_lit(G.USER_HEAD)} || {nicho} || {_lit(G.USER_AREA)} || {area} || "
            f"{_lit(G.USER_GOAL)} || {objetivo} || {_lit(G.USER_TASK)} || "
            f"CASE WHEN {limited} THEN {_lit(G.USER_LIMIT)} ELSE '' END || {_lit(G.USER_TAIL)}")


_MODELS_SQL = ", ".join(f"({i}, {_lit(m)})" for i, m in enumerate(MODELS))


def nation_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario rows from nation x its region (equi-join on the region key)."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("id"), F.col("r_name").alias("nicho"),
        F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("area"),
        F.concat(F.lit("grow sales in "), F.col("n_name")).alias("objetivo"))


@register("build_grid", sql=f"""
WITH s AS (SELECT n.n_name AS id, r.r_name AS nicho, 'nation ' || n.n_nationkey AS area,
                  'grow sales in ' || n.n_name AS objetivo
           FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
g AS (SELECT s.*, m.model, c.condition FROM s
      CROSS JOIN (VALUES {_MODELS_SQL}) m(model_pos, model)
      CROSS JOIN (VALUES ('unlimited'), ('limited')) c(condition))
SELECT id AS scenario_id, model, condition,
       substr(sha256({_lit(G.SYSTEM_PROMPT)} || chr(10) ||
              {_sql_user('nicho', 'area', 'objetivo', "condition = 'limited'")}), 1, 12) AS prompt_hash
FROM g
""")
def q_build_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = G.build_grid(nation_scenarios(spark, sf_dir), MODELS)
    p = G.build_prompts(grid)
    return p.select(F.col("id").alias("scenario_id"), "model", "condition", "prompt_hash")


def user_turn_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    base = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
                    .alias("request_id"), F.col("conv_id").cast("string").alias("scenario_id"),
                    F.lit("offline").alias("model"), F.lit(G.SYSTEM_PROMPT).alias("system"),
                    F.col("text").alias("user"))
    return base.select("*", F.explode(F.array(F.lit("unlimited"), F.lit("limited"))).alias("condition"))


@register("apply_responder", sql=r"""
WITH u AS (
  SELECT len(list_filter(string_split(text, chr(10)),
                         lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS n
  FROM conversations WHERE role = 'user')
SELECT c.condition, 'offline' AS model, count(*) AS n_records,
       sum(CASE WHEN c.condition = 'limited' THEN least(n, 4) ELSE n END) AS n_items,
       count(*) FILTER (WHERE n > 0) AS n_valid, CAST(0 AS BIGINT) AS n_failed
FROM u CROSS JOIN (VALUES ('unlimited'), ('limited')) c(condition)
GROUP BY 1
""")
def q_apply_responder(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = G.apply_responder(user_turn_prompts(spark, sf_dir))
    scored = G.score_replies(responses)
    return G.run_summary(scored).select("condition", "model", "n_records", "n_items", "n_valid",
                                        "n_failed")


@register("generation_run", sql=rf"""
WITH u AS (
  SELECT conv_id || '-' || turn AS request_id, conv_id::VARCHAR AS scenario_id, c.condition,
         substr(sha256({_lit(G.SYSTEM_PROMPT)} || chr(10) || text), 1, 12) AS prompt_hash,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) AS n
  FROM conversations CROSS JOIN (VALUES ('unlimited'), ('limited')) c(condition) WHERE role = 'user')
SELECT request_id, scenario_id, condition, prompt_hash, n AS completion_tokens,
       CASE WHEN condition = 'limited' THEN least(n, 4) ELSE n END AS n_items, n > 0 AS valid, 1 AS attempts, 1 AS runs
FROM u
""")
def q_generation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generation job over all user turns, started twice: the second run finds every request answered."""
    out = scratch_path(spark, f"generation_run-{uuid.uuid4().hex}")
    prompts = user_turn_prompts(spark, sf_dir)
    G.generate_runs(prompts, out, slices=4, concurrency=4)
    records = G.generate_runs(prompts, out, slices=4, concurrency=4)
    runs = records.select(F.count_distinct("run_id").cast("int")).scalar()
    return records.select("request_id", "scenario_id", "condition", "prompt_hash", "completion_tokens",
                          F.size("parsed_items").cast("long").alias("n_items"), "valid", "attempts", runs.alias("runs"))
