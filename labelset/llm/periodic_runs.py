"""Periodic runs of words: Lyndon arrays from suffix grouping, roots extended into runs.

A run is a stretch of consecutive words of one text with smallest period q (words q apart are
equal) and at least ``max(min_length, min_exponent * q)`` words that no neighbouring word
extends. A word is dropped if a run holds it after that run's first q words.

Method, per text: the words are grouped as in the first phase of Baier's suffix sorter. Groups
start as the positions of one word; the highest group u is taken, each of its positions points
to the nearest position on its left that is not taken yet, and positions met c times move from
their group to a new one right above it, their context grown by c times u. A position's
context when it is taken is the longest Lyndon word that starts there, so this phase alone
gives the Lyndon array. Done for an order of the words and for its reverse, it holds a Lyndon
root of every run; a root (i, p) is extended to both sides by the longest common extensions of
i and i + p. Those come from prefix fingerprints and a binary search over all roots of a chunk
at once, and are verified on the words.

Only words that can lie in a run are grouped: in a run of at least 4 periods and 6 words each
3-word window occurs three times, so text that is not covered by such windows holds no run.
This holds for ``min_exponent`` >= 4 and ``min_length`` >= 6, which is asked for.

Texts are independent: one pass, no shuffle; a task holds one chunk of texts (1 MiB, or one
text) at a time.

Defined results: null text has no words; empty texts and texts without runs have an empty run
list and keep all words; equal rows are judged each for itself; a null id changes nothing;
an empty table gives an empty table; columns other than the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelset.llm.textcore import U, Words, mix, text_chunks

MIN_LENGTH, MIN_EXPONENT = 6, 4
WINDOW, WINDOW_COUNT = 3, 3  # every 3-word window of a run occurs at least 3 times in it
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word from each position on (the end counts as smaller than any word).

    ``ranks`` are dense: 0 to k - 1, each in use.
    """
    n = len(ranks)
    length, group = [1] * n, list(ranks)
    members: list[list[int]] = [[] for _ in range(max(ranks, default=-1) + 1)]
    for i, g in enumerate(ranks):
        members[g].append(i)
    size = [len(m) for m in members]
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    # neighbours among the positions that are not taken yet; the last entry stands for both ends
    left, right = list(range(-1, n)), list(range(1, n + 2))
    left[n] = n - 1
    top = len(members) - 1
    while top >= 0:
        here = [i for i in members[top] if group[i] == top]
        members[top] = []
        here.sort()
        met: list[tuple[int, int]] = []
        last, count = -1, 0
        for i in here:  # from the left, so that earlier members are gone already
            p, r = left[i], right[i]
            left[r] = p
            if p < 0:
                continue
            right[p] = r
            if p == last:
                count += 1
            else:
                if count:
                    met.append((count, last))
                last, count = p, 1
        if count:
            met.append((count, last))
        if met:
            step = length[here[0]]
            if len(met) == 1 and size[group[last]] == 1:
                length[last] += step * count
            else:
                met.sort(reverse=True)
                made: dict[int, int] = {}
                now = met[0][0]
                for count, j in met:
                    if count != now:
                        made, now = {}, count
                    old = group[j]
                    new = made.get(old, -1)
                    if new < 0:
                        new = made[old] = len(members)
                        members.append([])
                        size.append(0)
                        up = above[old]
                        below.append(old)
                        above.append(up)
                        above[old] = new
                        below[up] = new
                    group[j] = new
                    members[new].append(j)
                    size[new] += 1
                    size[old] -= 1
                    length[j] += step * count
        top = below[top]
    return length


class _Prints:
    """Prefix fingerprints of a rank sequence, for longest common extensions of many pairs at once."""

    def __init__(self, ranks: np.ndarray):
        n = self.n = len(ranks)
        self.up = np.cumprod(np.r_[U(1), np.full(n, U(0xD6E8FEB86659FD93), dtype=np.uint64)], dtype=np.uint64)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(ranks.astype(np.uint64) + U(1)) * self.up[:n], out=self.total[1:])

    def same(self, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        """True where the k words from a and from b on (a < b) are equal."""
        return (self.total[a + k] - self.total[a]) * self.up[b - a] == self.total[b + k] - self.total[b]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension to the right of a < b, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.same(a, b, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for the words before a and before b."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.same(a - mid, b - mid, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def _verified(ranks: np.ndarray, s: int, e: int, p: int, root: int, lo: int, hi: int) -> tuple[int, int]:
    """Bounds of the stretch around ``root`` whose words p apart are equal; as given, unless fingerprints met by chance."""
    if np.array_equal(ranks[s:e - p], ranks[s + p:e]):
        return s, e
    s, e = root, root + p
    while e < hi and ranks[e] == ranks[e - p]:
        e += 1
    while s > lo and ranks[s - 1] == ranks[s - 1 + p]:
        s -= 1
    return s, e


def runs_of(ranks: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH,
            min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """Sorted (start, end, period) of the runs of each stretch ``bounds[k]`` to ``bounds[k + 1]`` of the ranks."""
    roots, periods = [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        dense = np.unique(ranks[lo:hi], return_inverse=True)[1]
        for order in (dense, dense.max(initial=0) - dense):
            roots.append(np.arange(lo, hi))
            periods.append(np.array(lyndon_lengths(order.tolist()), dtype=np.int64))
    if not roots:
        return []
    root, period = np.concatenate(roots), np.concatenate(periods)
    at = np.searchsorted(bounds, root, side="right") - 1
    lo, hi = bounds[at], bounds[at + 1]
    prints = _Prints(ranks)
    fits = np.flatnonzero(root + 3 * period <= hi)  # the first root of such a run has two more copies behind it
    fits = fits[prints.same(root[fits], root[fits] + period[fits], 2 * period[fits])]
    root, period, lo, hi = root[fits], period[fits], lo[fits], hi[fits]
    s = root - prints.backward(root, root + period, root - lo)
    e = root + period + prints.forward(root, root + period, hi - root - period)
    found = np.unique(np.stack([s, e, period, lo, hi], axis=1), axis=0, return_index=True)
    out = set()
    for (s_, e_, p_, lo_, hi_), first in zip(found[0].tolist(), found[1].tolist()):
        s_, e_ = _verified(ranks, s_, e_, p_, int(root[first]), lo_, hi_)
        if e_ - s_ >= max(min_length, min_exponent * p_):
            out.add((s_, e_, p_))
    return sorted(out)


def _stretches(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the word stretches (each in one row) that 3-word windows with enough repeats cover."""
    n = len(words)
    ok = np.flatnonzero(words.whole(WINDOW))
    gram, place = words.grams(WINDOW)[ok], words.doc[ok]
    start = end = np.zeros(0, dtype=np.int64)
    while len(ok):
        key = mix(gram ^ mix(place.astype(np.uint64) + U(1)))
        _, inv, count = np.unique(key, return_inverse=True, return_counts=True)
        often = count[inv] >= WINDOW_COUNT
        full = often.all()
        ok, gram = ok[often], gram[often]
        # windows that overlap or touch in one row make one stretch
        new = np.ones(len(ok), dtype=bool)
        new[1:] = (np.diff(ok) > WINDOW) | (words.doc[ok[1:]] != words.doc[ok[:-1]])
        start = ok[new]
        end = ok[np.r_[np.flatnonzero(new)[1:], len(ok)] - 1] + WINDOW if len(ok) else ok
        place = np.cumsum(new)  # the next round counts within a stretch
        long = end - start >= MIN_LENGTH
        start, end, keep = start[long], end[long], long[place - 1] if len(ok) else np.zeros(0, bool)
        if full and keep.all():
            break
        ok, gram, place = ok[keep], gram[keep], place[keep]
    assert (end <= n).all()
    return start, end


def _chunk(texts: pa.Array, min_length: int, min_exponent: int) -> tuple[list[int], list[list[dict]], list[str]]:
    words = Words(texts)
    start, end = _stretches(words)
    by_row: dict[int, list[tuple[int, int, int]]] = {}
    if len(start):
        where = np.concatenate([np.arange(a, b) for a, b in zip(start, end)])
        ids: dict[bytes, int] = {}
        data = words.data.tobytes()
        ranks = np.array([ids.setdefault(data[a:b], len(ids)) for a, b in
                          zip(words.start[where].tolist(), words.end[where].tolist())], dtype=np.int64)
        bounds = np.r_[0, np.cumsum(end - start)]
        for s, e, p in runs_of(ranks, bounds, min_length, min_exponent):
            row = int(words.doc[where[s]])
            by_row.setdefault(row, []).append((int(where[s] - words.first[row]), e - s, p))
    runs, kept = [], []
    for row in range(len(texts)):
        mine = sorted(by_row.get(row, ()), key=lambda r: (r[0], r[2]))
        parts = words.bytes_of(row).split()  # on 0x20 and 0x09-0x0D
        if mine:
            gone = np.zeros(len(parts) + 1, dtype=np.int64)
            for s, n, p in mine:
                gone[s + p] += 1
                gone[s + n] -= 1
            parts = [w for w, g in zip(parts, np.cumsum(gone[:-1]).tolist()) if not g]
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in mine])
        kept.append(b" ".join(parts).decode())
    return np.diff(words.first).tolist(), runs, kept


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``id_col``, ``n_words``, ``runs`` (by start, then period) and ``collapsed`` (kept words, one space between) per row."""
    if min_length < MIN_LENGTH or min_exponent < MIN_EXPONENT:
        raise ValueError(f"runs of fewer than {MIN_LENGTH} words or {MIN_EXPONENT} periods are not looked for")
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in text_chunks(batch, "_text"):
                n, runs, kept = _chunk(part.column(1), min_length, min_exponent)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(runs, shape), pa.array(kept, pa.string())],
                    names=["_id", "n_words", "runs", "collapsed"])

    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
        scan, f"_id {id_type}, n_words bigint, runs {RUNS}, collapsed string")
    return found.withColumnRenamed("_id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first by start, then period; none: null."""
    more = lambda a, r: (r["length"] * a["period"]) > (a["length"] * r["period"])
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(more(a, r), r).otherwise(a))


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic tail in the texts whose h = crc32(id as text) is divisible by 10.

    With g = floor(h / 10) and n words, each word i >= a = g % n becomes word a + (i - a) % p,
    p = 1 + floor((n - a) / (3 + g % 8)). Texts without words, with null text or a null id stay.
    """
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"),
                       F.crc32(F.col(id_col).cast("string").cast("binary")).alias("_h"))
    words = F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hit = held.withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_g", F.floor(F.col("_h") / 10))
    n = F.size("_w").cast("bigint")
    hit = hit.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    hit = hit.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    planted = F.expr("array_join(transform(_w, (w, i) -> IF(i < _a, w, element_at(_w, int(_a + (i - _a) % _p) + 1))), ' ')")
    text = F.when(n > 0, planted).otherwise(F.col("_text"))
    return hit.select(*(text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
