"""Benchmark passages in documents by pigeonhole edit matching.

Texts are compared in normal form: lower case, ASCII punctuation and white space as one space,
UTF-8 bytes. An item of L bytes may be found with up to e = L // EDIT_EVERY edits. It is cut
into e + 1 pieces; e edits cannot touch all of them, so every occurrence holds at least one
piece unchanged. One automaton finds the exact hits of all pieces in a document, hits of an
item on overlapping windows are merged, and Myers' bit-parallel algorithm verifies each window.

The benchmark is a stated query set: its items go to the tasks in blocks of at most about
``BLOCK_BYTES`` of text, one pass over the documents per block, so no bound is set on it.

Defined results: null or empty texts and items never match; items shorter than EDIT_EVERY
match only unchanged; equal items match alike, each under its own id; repeated documents give
repeated rows; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelset.llm.textcore import text_chunks

EDIT_EVERY = 16
BLOCK_BYTES = 16 << 20
MATCHES = "doc_id long, item_id long, distance int"
_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def normal(text: str) -> str:
    """Normal form of a text; each character stands for one byte of it."""
    return b" ".join(text.lower().encode().translate(_PLAIN).split()).decode("latin-1")


def cut(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal size with their offsets."""
    at = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


def best_distance(item: str, text: str, masks: dict[str, int] | None = None) -> int:
    """Smallest edit distance of ``item`` to a substring of ``text`` (Myers, search form)."""
    m = len(item)
    masks = peq(item) if masks is None else masks
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
    return best


def peq(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    """Finds the items of one block in normal texts."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        by_text: dict[str, list[int]] = {}
        for key, text in items:
            if form := normal(text or ""):
                by_text.setdefault(form, []).append(key)
        self.items = [(text, len(text) // EDIT_EVERY, peq(text), keys) for text, keys in by_text.items()]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (text, edits, _, _) in enumerate(self.items):
            for at, piece in cut(text, edits):
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(item id, distance) of every item within its edit budget somewhere in ``text``."""
        if not self.items or not text:
            return
        starts: dict[int, list[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, at in places:
                starts.setdefault(k, []).append(end + 1 - size - at)
        for k, found in starts.items():
            item, edits, masks, keys = self.items[k]
            best, to = edits + 1, 0
            windows: list[list[int]] = []
            for s in sorted(found):
                a, b = max(0, s - edits), min(len(text), s + len(item) + edits)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            for a, b in windows:
                best = min(best, best_distance(item, text[a:b], masks))
                if not best:
                    break
            if best <= edits:
                for key in keys:
                    yield key, best


def find_items(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (MATCHES) per document and benchmark item found in it."""
    items = benchmark.select(F.col(item_id).cast("long").alias("k"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block) if blocks > 1 else items
        listed = [(r["k"], r["t"]) for r in mine.orderBy("k").collect()]  # about block_bytes at most
        part = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan(listed), MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def _scan(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in batches:
            for part in text_chunks(batch):
                rows = [(key, item, best) for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)
                        for item, best in matcher.find(normal(text))]
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32())],
                                                 names=["doc_id", "item_id", "distance"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """``docs`` without the documents in which an item was found; null ids stay."""
    bad = find_items(docs, benchmark, doc_id, text, **names).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[doc_id] == bad["_bad"], "left_anti")
