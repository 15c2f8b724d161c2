"""Conversation structure repair: cheapest edits by a DAG of scalar big-integer weights.

The rows of a conversation are taken by turn (nulls first; rows of one turn by role, then text).
Each row's first fault counts: blank (no character but 0x20 and 0x09-0x0D), duplicate (role and
text seen earlier in the conversation), truncated (last such character not one of ``.!?``).
The repaired conversation's role initials are ``(s?(ua)+)?``. Edits and their costs: Keep 0,
Rerole to user or assistant 1, Delete 2 (the only one for blank and duplicate rows), Insert of
an empty-text user or assistant row 5; a truncated row that is not deleted adds 5. The audit is
the initials of the cheapest edits in order, the ASCII-least of equal cost.

Method. The rows of a conversation are edges of a DAG over (row, state of the role grammar). An
edge weighs one integer: the cost in the high digits and the edit's letter at the row's place
among the low base-5 digits (D 1, I 2, K 3, R 4, and 0 after the end), so that plain integer
minima settle cost and audit at once. Insert needs no edge: as 5 > 2 + 2, leaving out an
inserted row and deleting the row it forms a user/assistant pair with (and a system row, if it
then stands alone) is always cheaper, so an inserting script is never the cheapest.

Rows are numbered by a range sort over (conversation, turn, ...), so a conversation of any size
spreads over tasks. Rows are cut into segments of at most ``SEGMENT``; each segment's DAG gives
the least weight for every state before and after it. A conversation's segments are a short
chain of the same kind, with the rank of the equal-length audits before a segment as the
digit between its cost and its letters. No group holds more than a segment's rows or a
conversation's segment summaries (about 4 bytes a row); texts are never gathered.

Defined results: null role or text reads as one space; a null conversation id is one
conversation, a null turn sorts first; repeated rows are duplicates; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelset.llm.landing import land

SEGMENT = 512
RANGE_ROWS = 1 << 20  # rows a task of the numbering sort, about
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
UNFINISHED = 5  # added by a truncated row that is not deleted
LETTER = {"D": 1, "I": 2, "K": 3, "R": 4}
BASE = len(LETTER) + 1
#: States of ``(s?(ua)+)?``: empty, after s, after u, after a; whole in the first and last.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
WHOLE = (EMPTY, ASSISTANT)
NEXT = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_WORD = r"[^\x20\x09-\x0D]"


def row_edits(state: int, initial: str, fault: int) -> list[tuple[int, str, str, int]]:
    """(cost, edit, new role initial or "", next state) of each edit that a row allows in a grammar state."""
    out = [(COST["D"], "D", "", state)]
    if fault not in (BLANK, DUPLICATE):
        extra = UNFINISHED if fault == TRUNCATED else 0
        for role, to in NEXT[state].items():
            if role == initial:
                out.append((COST["K"] + extra, "K", role, to))
            elif role != "s":
                out.append((COST["R"] + extra, "R", role, to))
    return out


def segment_weights(initials: list[str], faults: list[int]) -> dict[tuple[int, int], tuple[int, str]]:
    """(cost, audit) of the cheapest way through a segment's rows for each state before and after it."""
    n = len(initials)
    unit = BASE ** n
    out = {}
    for start in range(4):
        best = {start: 0}
        for i in range(n):
            digit, step = BASE ** (n - 1 - i), {}
            for state, weight in best.items():
                for cost, edit, _, to in row_edits(state, initials[i], faults[i]):
                    w = weight + cost * unit + LETTER[edit] * digit
                    if to not in step or w < step[to]:
                        step[to] = w
            best = step
        for state, weight in best.items():
            cost, low = divmod(weight, unit)
            letters = []
            for _ in range(n):
                low, d = divmod(low, BASE)
                letters.append(" DIKR"[d])
            out[start, state] = (cost, "".join(reversed(letters)))
    return out


def chain(segments: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """Least cost of a conversation and, for each segment, the state before it and its part of the audit."""
    best: dict[int, tuple[int, int]] = {EMPTY: (0, 0)}  # state -> cost, rank of its audit among equal lengths
    back: list[dict[int, int]] = []
    for weights in segments:
        n = len(next(iter(weights.values()))[1])
        unit = BASE ** n
        step: dict[int, tuple[int, int]] = {}
        for (start, end), (cost, audit) in weights.items():
            if start in best:
                low = best[start][1] * unit + _digits(audit)
                w = (best[start][0] + cost) * unit * BASE + low  # ranks are below 4
                if end not in step or w < step[end][0]:
                    step[end] = (w, start)
        order = {low: k for k, low in enumerate(sorted({w % (unit * BASE) for w, _ in step.values()}))}
        best = {end: (w // (unit * BASE), order[w % (unit * BASE)]) for end, (w, _) in step.items()}
        back.append({end: start for end, (_, start) in step.items()})
    end = min((s for s in WHOLE if s in best), key=lambda s: best[s])
    cost, path = best[end][0], []
    for weights, came in zip(reversed(segments), reversed(back)):
        path.append((came[end], weights[came[end], end][1]))
        end = came[end]
    return cost, path[::-1]


def _digits(audit: str) -> int:
    return int(audit.translate(str.maketrans("DIKR", "1234")) or "0", BASE)


def replay(state: int, audit: str, initials: str) -> tuple[str, int]:
    """New role initial of each row (``-`` if deleted) and the state behind them."""
    out = []
    for edit, initial in zip(audit, initials):
        if edit == "D":
            out.append("-")
            continue
        role = initial if edit == "K" else next(r for r in NEXT[state] if r != "s")
        out.append(role)
        state = NEXT[state][role]
    return "".join(out), state


def _space(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def number_rows(rows: DataFrame) -> DataFrame:
    """Landed ``conv_id, turn, role, text, pos, seg``: ``pos`` rises in conversation order over the whole table."""
    rows = rows.select("conv_id", "turn", _space("role").alias("role"), _space("text").alias("text"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // RANGE_ROWS)
    h = F.xxhash64("role", "text")
    return land(rows.repartitionByRange(parts, "conv_id", "turn", h).sortWithinPartitions("conv_id", "turn", "role", "text")
                .withColumn("pos", F.monotonically_increasing_id())
                .withColumn("seg", F.expr(f"pos div {SEGMENT}")))


def segments(numbered: DataFrame) -> DataFrame:
    """One row for each segment of a conversation: its weights, fault counts, turns and role initials."""
    key = [F.xxhash64("role", "text").alias("k1"), F.hash("text", "role").alias("k2"), F.char_length("text").alias("k3")]
    end = F.regexp_extract("text", rf"({_WORD})[\x20\x09-\x0D]*\z", 1)
    light = numbered.select("conv_id", "turn", "pos", "seg", F.substring("role", 1, 1).alias("initial"), *key,
                            F.when(~F.col("text").rlike(_WORD), BLANK).when(~end.isin(".", "!", "?"), TRUNCATED)
                            .otherwise(NONE).alias("fault"))
    seen = (light.where(F.col("fault") != BLANK).groupBy("conv_id", "k1", "k2", "k3")
            .agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
            .select(F.col("conv_id").alias("c"), F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.col("k3").alias("s3"), "first"))
    known = light.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))
                       & (F.col("k3") == F.col("s3")), "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("pos") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    grouped = known.groupBy("conv_id", "seg").agg(
        F.array_sort(F.collect_list(F.struct("pos", "initial", fault.alias("fault"), "turn"))).alias("rows"))
    id_type = numbered.schema["conv_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, seg, rows in zip(*(c.to_pylist() for c in batch.columns)):
                initials, faults = [r["initial"] for r in rows], [r["fault"] for r in rows]
                turns = [r["turn"] for r in rows if r["turn"] is not None]
                out.append({
                    "conv_id": conv, "seg": seg, "first": rows[0]["pos"], "initials": initials,
                    "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
                    "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                    "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
                    "weights": [{"start": a, "end": b, "cost": c, "audit": s}
                                for (a, b), (c, s) in segment_weights(initials, faults).items()]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                batch.schema.field("conv_id"), ("seg", pa.int64()), ("first", pa.int64()), ("initials", pa.list_(pa.string())),
                ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
                ("weights", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]))

    return grouped.mapInArrow(weigh, (
        f"conv_id {id_type}, seg bigint, first bigint, initials array<string>, blank bigint, duplicate bigint, truncated bigint, "
        "illegal bigint, low bigint, high bigint, turns bigint, weights array<struct<start: int, end: int, cost: bigint, audit: string>>"))


def plan_repairs(numbered: DataFrame) -> DataFrame:
    """Landed, one row a conversation: ``gaps, blank, duplicate, truncated, illegal, cost, audit`` and
    ``parts``, for each segment its first row, its part of the audit and the new role initials."""
    parts = segments(numbered)
    names = [c for c in parts.columns if c not in ("conv_id", "seg")]
    grouped = parts.groupBy("conv_id").agg(F.collect_list(F.struct("seg", *names)).alias("segs"))
    id_type = numbered.schema["conv_id"].dataType.simpleString()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, segs in zip(*(c.to_pylist() for c in batch.columns)):
                segs.sort(key=lambda s: s["seg"])
                cost, path = chain([{(w["start"], w["end"]): (w["cost"], w["audit"]) for w in s["weights"]} for s in segs])
                parts = [{"seg": s["seg"], "first": s["first"], "audit": audit, "roles": replay(state, audit, s["initials"])[0]}
                         for s, (state, audit) in zip(segs, path)]
                total = {k: sum(s[k] for s in segs) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
                total["illegal"] += sum(a["initials"][-1] + b["initials"][0] not in ("su", "ua", "au") for a, b in zip(segs, segs[1:]))
                timed = [s for s in segs if s["turns"]]
                shared = sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
                gaps = timed[-1]["high"] - timed[0]["low"] + 1 - (total.pop("turns") - shared) if timed else total.pop("turns")
                out.append({"conv_id": conv, "gaps": min(gaps, 2**63 - 1), **total, "cost": cost,
                            "audit": "".join(p["audit"] for p in parts), "parts": parts})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                batch.schema.field("conv_id"), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                ("audit", pa.string()),
                ("parts", pa.list_(pa.struct([("seg", pa.int64()), ("first", pa.int64()), ("audit", pa.string()), ("roles", pa.string())])))]))

    return land(grouped.mapInArrow(settle, (
        f"conv_id {id_type}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
        "parts array<struct<seg: bigint, first: bigint, audit: string, roles: string>>")))


def repaired_rows(numbered: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, pos, edit, role, text`` of the rows that stay, with their new roles."""
    p = plans.select(F.col("conv_id").alias("_c"), F.explode("parts").alias("_p"))
    at = (F.col("pos") - F.col("_p.first") + 1).cast("int")
    rows = numbered.join(p, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("seg") == F.col("_p.seg")))
    rows = rows.withColumn("edit", F.substr("_p.audit", at, F.lit(1))).withColumn("_r", F.substr("_p.roles", at, F.lit(1)))
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("_r") == "u", "user").otherwise("assistant")
    return rows.where("edit <> 'D'").select("conv_id", "pos", "edit", role.alias("role"), "text")


def conversation_digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: hash of the newline-joined ``role:text`` rows, streamed in order.

    A hash is sequential by nature: one conversation's rows pass through one task, one batch at a time.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, h = None, None, None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0), ("repaired_sha256", pa.string())])
            ids, shas = [], []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if h is None or conv != now:
                    if h is not None:
                        ids.append(now)
                        shas.append(h.hexdigest())
                    now, h = conv, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    h.update(f"\n{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(shas, pa.string())], schema=schema)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], schema.field(0).type), pa.array([h.hexdigest()])], schema=schema)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "role", "text")
    return ordered.mapInArrow(digest, f"conv_id {id_type}, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20 (nulls as one space): 0 drops a row, 1 empties its text,
    2 removes ``.!?`` from it, 3 repeats the row, 4 makes it a user row."""
    kind = F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", _space("role").alias("role"), _space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The report of every conversation id of ``conversations`` over its ``rows``; ids without rows get zeros."""
    numbered = number_rows(rows)
    plans = plan_repairs(numbered)
    digests = conversation_digests(repaired_rows(numbered, plans))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = conversations.select("conv_id").distinct()
    blank = [F.lit(None).cast("bigint").alias(c) for c in counts]
    text = F.lit(None).cast("string")
    both = (every.select("conv_id", *blank, text.alias("audit"), text.alias("repaired_sha256"))
            .unionByName(plans.select("conv_id", *counts, "audit", text.alias("repaired_sha256")))
            .unionByName(digests.select("conv_id", *blank, text.alias("audit"), "repaired_sha256")))
    return both.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts),
                                       F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                       F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
