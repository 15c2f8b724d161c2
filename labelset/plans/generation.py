"""Generation side: the scenario x model x condition grid, prompts, the responder hook.

* the grid explodes the (small, fixed) model and condition lists onto the scenario rows:
  no join, the scenario table keeps its partitioning;
* prompts and their hashes are column expressions;
* the responder is a user function applied with ``mapInPandas``: each row is timed, a
  failure is recorded on that row (``Type: message``) instead of failing the task, and the
  rows can be spread over ``n_partitions`` tasks first so slow calls run in parallel.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelset.functions.replies import sanitize_reply
from labelset.session import cut_lineage
from labelset.sources.dimensions import CONDITIONS
from labelset.sources.json_docs import existing_paths

# ---------------------------------------------------------------------------
# Prompt texts of the study.
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = (
    "Você é um especialista em KPIs.\n"
    "Regras de saída:\n"
    "- Responda SOMENTE com um ARRAY JSON bruto (sem markdown, sem cercas ``` e sem rótulos "
    "como 'Input:'/'Output:').\n"
    "- Use EXATAMENTE estas chaves por item: kpi, importancia, formula, metricas (sem acentos "
    "nas chaves).\n"
    "- Todos os VALORES TEXTUAIS devem estar em Português do Brasil.\n"
    "- A lista deve ser concisa (apenas os KPIs essenciais ao contexto).\n"
    "- Fórmulas curtas, claras e computáveis.\n"
)
USER_HEAD = "Contexto:\n- nicho: "
USER_AREA = "\n- area: "
USER_GOAL = "\n- objetivo: "
USER_TASK = "\n\nTarefa: recomende KPIs "
USER_LIMIT = "até 4 "
USER_TAIL = ("adequados ao contexto.\n\n"
             "Formato OBRIGATÓRIO (array JSON bruto, sem markdown):\n"
             '[{"kpi":"...","importancia":"...","formula":"...","metricas":["..."]}, ...]')
HASH_CHARS = 12


# --- J1 --------------------------------------------------------------------------------------
def build_grid(scenarios: DataFrame, models: Sequence[str],
               conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    """Scenario rows x models x conditions, with positions for the study's order
    (scenario, then model, unlimited before limited)."""
    m = F.posexplode(F.array(*[F.lit(x) for x in models])).alias("model_pos", "model")
    g = scenarios.select("*", m)
    c = F.posexplode(F.array(*[F.lit(x) for x in conditions])).alias("condition_pos", "condition")
    return g.select("*", c)


# --- F17 / F18 / F19 / F20 ---------------------------------------------------------------------
def user_prompt(nicho: Column, area: Column, objetivo: Column, limited: Column) -> Column:
    """The user prompt; the limited condition asks for at most four items."""
    return F.concat(F.lit(USER_HEAD), nicho, F.lit(USER_AREA), area, F.lit(USER_GOAL), objetivo,
                    F.lit(USER_TASK), F.when(limited, F.lit(USER_LIMIT)).otherwise(F.lit("")),
                    F.lit(USER_TAIL))


def prompt_hash(system: Column, user: Column) -> Column:
    """First 12 hex digits of SHA-256 over system + newline + user (UTF-8)."""
    return F.substring(F.sha2(F.concat(system, F.lit("\n"), user), 256), 1, HASH_CHARS)


def build_prompts(grid: DataFrame, nicho: str = "nicho", area: str = "area",
                  objetivo: str = "objetivo", system: str = SYSTEM_PROMPT) -> DataFrame:
    limited = F.col("condition") == "limited"
    u = user_prompt(F.col(nicho), F.col(area), F.col(objetivo), limited)
    return grid.withColumns({"system": F.lit(system), "user": u}).withColumn(
        "prompt_hash", prompt_hash(F.col("system"), F.col("user")))


def run_id() -> str:
    """One id for a whole run, fixed on the driver (not a per-row ``uuid()``)."""
    return str(uuid.uuid4())


def token_totals(prompt: Column, completion: Column) -> tuple[Column, Column, Column]:
    p = F.coalesce(prompt.cast("long"), F.lit(0).cast("long"))
    c = F.coalesce(completion.cast("long"), F.lit(0).cast("long"))
    return p, c, p + c


# --- X3 --------------------------------------------------------------------------------------
RESPONSE_SCHEMA = ("content string, latency_s double, prompt_tokens long, "
                   "completion_tokens long, total_tokens long, error string, attempts int")


def echo_lines_responder(model: str, system: str, user: str) -> dict:
    """Deterministic offline responder: one item per non-blank line of the user text."""
    items = [{"kpi": ln.strip()} for ln in user.split("\n") if ln.strip()]
    return {"content": json.dumps(items), "prompt_tokens": len(system.split()) + len(user.split()),
            "completion_tokens": len(items)}


def _called(responder: Callable[[str, str, str], dict], args: tuple, timeout_s: float | None) -> dict:
    """The responder's answer; ``TimeoutError`` if it takes longer (its thread is then left behind)."""
    if timeout_s is None:
        return responder(*args) or {}
    box: dict = {}

    def work() -> None:
        try:
            box["value"] = responder(*args) or {}
        except Exception as e:  # noqa: BLE001 - raised again below
            box["error"] = e

    t = threading.Thread(target=work, daemon=True)
    t.start()
    t.join(timeout_s)
    if t.is_alive():
        raise TimeoutError(f"no answer in {timeout_s} s")
    if "error" in box:
        raise box["error"]
    return box["value"]


def _response(responder: Callable[[str, str, str], dict], args: tuple, retries: int, timeout_s: float | None) -> tuple:
    for attempt in range(1, retries + 2):
        t0 = time.perf_counter()
        try:
            r = _called(responder, args, timeout_s)
            lat = time.perf_counter() - t0
            p = int(r.get("prompt_tokens") or 0)
            c = int(r.get("completion_tokens") or 0)
            return str(r.get("content") or ""), float(lat), p, c, p + c, None, attempt
        except Exception as e:  # noqa: BLE001 - recorded per row
            error = f"{type(e).__name__}: {e}"
    return None, None, None, None, None, error, attempt


def apply_responder(prompts: DataFrame, responder: Callable[[str, str, str], dict] = echo_lines_responder,
                    n_partitions: int | None = None, retries: int = 0, timeout_s: float | None = None,
                    concurrency: int = 1) -> DataFrame:
    """Call ``responder(model, system, user)`` for every prompt row.

    Adds content, latency_s (of the last call), prompt/completion/total tokens, ``error`` (``Type:
    message`` when the last call raised or took longer than ``timeout_s``; the other fields are
    then NULL) and ``attempts``. A failed call is repeated up to ``retries`` times; a task has at
    most ``concurrency`` calls under way.
    """
    src = prompts.repartition(n_partitions) if n_partitions else prompts
    in_cols = src.columns
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    out_schema = f"{out_schema}, {RESPONSE_SCHEMA}"
    names = [c.split()[0] for c in RESPONSE_SCHEMA.split(", ")]

    def run(batches):
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                rows = list(pool.map(lambda args: _response(responder, args, retries, timeout_s),
                                     zip(pdf["model"], pdf["system"], pdf["user"])))
                extra = pd.DataFrame(rows, columns=names)
                extra = extra.astype({"latency_s": "float64", "prompt_tokens": "Int64", "completion_tokens": "Int64",
                                      "total_tokens": "Int64", "attempts": "Int32"})
                yield pd.concat([pdf[in_cols].reset_index(drop=True), extra], axis=1)

    return src.mapInPandas(run, out_schema)


REQUEST_KEYS = ("request_id", "model", "condition", "prompt_hash")


def _append_results(df: DataFrame, out_dir: str) -> None:
    df.write.mode("append").parquet(out_dir)


def generate_runs(prompts: DataFrame, out_dir: str, responder: Callable[[str, str, str], dict] = echo_lines_responder,
                  slices: int = 8, retries: int = 0, timeout_s: float | None = None, concurrency: int = 1) -> DataFrame:
    """The generation job from prompts to persisted result records; goes on where an earlier run stopped.

    ``prompts``: ``request_id, scenario_id, model, condition, system, user``, one row a request. Requests
    whose record in ``out_dir`` has the same prompt hash and no error are left out (anti join), so a changed prompt
    is called again. The others are called in ``slices`` by hash of their key; each slice's records
    are committed before the next starts, so a lost run loses the calls of one slice. Failed
    requests keep their record with its error and are called again by the next run. Returns all records, the
    latest of each request.
    """
    spark = prompts.sparkSession
    hashed = prompts.withColumn("prompt_hash", prompt_hash(F.col("system"), F.col("user")))
    schema = T.StructType([f for f in score_replies(apply_responder(hashed.limit(0), responder)).schema.fields if f.name not in ("system", "user")])
    schema = schema.add("run_id", T.StringType()).add("slice", T.IntegerType()).add("finished_at", T.TimestampType())
    finished = lambda: spark.read.schema(schema).parquet(out_dir)
    pending = hashed
    if existing_paths(spark, [out_dir]):
        done = finished().filter(F.col("error").isNull()).select(*REQUEST_KEYS)
        pending = hashed.join(done, list(REQUEST_KEYS), "left_anti")
    pending = cut_lineage(pending.withColumn("slice", F.pmod(F.xxhash64(*REQUEST_KEYS), F.lit(slices)).cast("int")))
    run = run_id()
    for k in [r["slice"] for r in pending.select("slice").distinct().orderBy("slice").collect()]:  # at most ``slices`` numbers
        answered = apply_responder(pending.filter(F.col("slice") == k).drop("slice"), responder, None, retries, timeout_s, concurrency)
        p, c, total = token_totals(F.col("prompt_tokens"), F.col("completion_tokens"))
        ok = F.col("error").isNull()  # a failed record has no counts
        counts = {"prompt_tokens": F.when(ok, p), "completion_tokens": F.when(ok, c), "total_tokens": F.when(ok, total)}
        scored = score_replies(answered).withColumns(counts).drop("system", "user")
        scored = scored.withColumns({"run_id": F.lit(run), "slice": F.lit(k), "finished_at": F.current_timestamp()})
        _append_results(scored.select(*schema.names), out_dir)
    if not existing_paths(spark, [out_dir]):
        return spark.createDataFrame([], schema)
    rest = [c for c in schema.names if c not in ("request_id", "model", "condition")]
    latest = finished().groupBy("request_id", "model", "condition").agg(F.max_by(F.struct(*rest), "finished_at").alias("_r"))
    return latest.select("request_id", "model", "condition", "_r.*")


def score_replies(responses: DataFrame) -> DataFrame:
    """Salvage items from each reply (limited rows capped at 4); failed calls keep their
    error and get no items. ``issues`` is kept for the unlimited condition only."""
    limited = F.col("condition") == "limited"
    s = responses.withColumn("_s", F.when(F.col("error").isNull(),
                                          sanitize_reply(F.col("content"), limited)))
    return s.select(
        *[c for c in responses.columns if c != "content"],
        F.col("_s.output").alias("output"), F.col("_s.items").alias("parsed_items"),
        F.col("_s.valid").alias("valid"),
        F.when(~limited, F.col("_s.issues")).alias("issues")).drop("_s")


# --- A10 -------------------------------------------------------------------------------------
def run_summary(records: DataFrame, keys: Sequence[str] = ("condition", "model")) -> DataFrame:
    """Records, items, valid and failed counts per condition and model."""
    items = F.coalesce(F.size("parsed_items"), F.lit(0))
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(items).alias("n_items"),
        F.avg(items).alias("avg_items"), F.count_if(F.coalesce(F.col("valid"), F.lit(False))).alias("n_valid"),
        F.count_if(F.col("error").isNotNull()).alias("n_failed"))
