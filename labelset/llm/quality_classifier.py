"""Quality classifier: Naive Bayes support vector machine.

A text is its set of hashed n-gram indicators: 1- to 3-grams of words, word endings, 1- to 3-grams
of word shapes, and, as extra features beside the n-grams, steps of how much of the text repeated 3-grams and
repeated neighbours make up. Indicators are scaled by the class log-count ratios, which are
counted over all labelled training rows; a linear hinge-loss model on the scaled indicators is
fitted by dual coordinate descent on a bounded sample of them (about SAMPLE rows, chosen by a
hash of the id), one fifth of which calibrates the margins to probabilities. The sample is
ordered and split by hashes of its rows, so the same rows give the same model and scores however they
are partitioned. Only the text enters a score.

Defined results: null text is empty and has no indicators, its score is the calibrated margin
0; repeated rows are scored alike; labels without a document, or null labels, are ignored;
several labels of one id count as the smallest; without labels of both classes every score is
the share of label 1 (0.5 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelset.llm.landing import small
from labelset.llm.textcore import U, Words, mix, text_chunks

FEATURES = 1 << 20
SAMPLE = 8000
COST, EPOCHS = 1.0, 12
BROADCAST_LABELS = 400_000
_KIND = np.zeros(256, dtype=np.uint8)  # byte classes as bits: lower 1, upper 2, digit 4, symbol 8, other 16
_KIND[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = 1
_KIND[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = 2
_KIND[np.frombuffer(b"0123456789", np.uint8)] = 4
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 8
_KIND[128:] = 16


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, bounds): the distinct features of row r are features[bounds[r]:bounds[r + 1]]."""
    w = Words(texts)
    n, rows = len(w), len(texts)
    kind = _KIND[w.data]
    shape = np.bitwise_or.reduceat(kind, w.start).astype(np.uint64) if n else np.zeros(0, np.uint64)
    if n:  # white space between words has no class bit, so the ranges may run on to the next word
        tail = w.data[w.end - 1].astype(np.uint64)
        for k in (2, 3):
            tail = tail * U(257) + np.where(w.end - w.start >= k, w.data[np.maximum(w.end - k, 0)], 0).astype(np.uint64)
    else:
        tail = np.zeros(0, np.uint64)
    found = [(w.hash, w.doc), (mix(tail + U(1 << 40)), w.doc)]
    found += [(w.grams(k)[ok], w.doc[ok]) for k in (2, 3) for ok in (w.whole(k),)]
    code = shape + U(32) * (np.minimum(w.end - w.start, 12) // 3).astype(np.uint64)
    for k in (1, 2, 3):
        ok = w.whole(k)
        gram = sum((np.roll(code, -j) * U(1009 ** j) for j in range(k)), start=np.zeros(n, np.uint64))
        found.append((mix(gram + U(k << 48))[ok], w.doc[ok]))
    # shares of words in repeated 3-grams and of words equal to the one before, in steps
    ok = w.whole(3)
    g, d = w.grams(3)[ok], w.doc[ok]
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    same = np.zeros(len(g), bool)
    same[1:] = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    alike = np.zeros(n, bool)
    alike[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    size = np.maximum(np.bincount(w.doc, minlength=rows), 1)
    for name, where in ((1, d[same]), (2, w.doc[alike])):
        share = np.bincount(where, minlength=rows) / size
        for step, least in enumerate((0.05, 0.15, 0.3, 0.45)):
            hit = np.flatnonzero(share >= least)
            found.append((np.full(len(hit), mix(np.array([(name << 56) + step], np.uint64))[0]), hit))
    f = (np.concatenate([x for x, _ in found]) % U(FEATURES)).astype(np.int64)
    key = np.unique(np.concatenate([x for _, x in found]).astype(np.int64) * FEATURES + f)
    return key % FEATURES, np.searchsorted(key // FEATURES, np.arange(rows + 1))


@dataclass
class Model:
    weights: np.ndarray  # per feature: log-count ratio times fitted weight
    bias: float
    slope: float
    shift: float

    def margins(self, f: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        # summed row by row, so a row's sum does not depend on its neighbours in a chunk
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        return np.bincount(row, weights=self.weights[f], minlength=len(bounds) - 1) + self.bias * (bounds[1:] > bounds[:-1])

    def scores(self, f: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(f, bounds) + self.shift, -30, 30)))


def feature_counts(rows: DataFrame) -> DataFrame:
    """``f``, ``n0``, ``n1``: labelled rows (text, y) of each class that have the feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, FEATURES + 1), dtype=np.int64)
        for batch in batches:
            for part in text_chunks(batch):
                f, bounds = indicators(part.column("text"))
                y = part.column("y").to_numpy()
                of = np.repeat(y, np.diff(bounds))
                for k in (0, 1):
                    count[k, :FEATURES] += np.bincount(f[of == k], minlength=FEATURES)
                    count[k, FEATURES] += (y == k).sum()
        own = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count[0, own]), pa.array(count[1, own])], names=["f", "n0", "n1"])

    return rows.mapInArrow(run, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def descend(sets: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss linear machine; classes weigh in inverse to their size."""
    sign = np.where(y > 0, 1.0, -1.0)
    upper = cost * len(y) / (2 * np.maximum(np.where(y > 0, (y > 0).sum(), (y == 0).sum()), 1))
    w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
    norm = np.array([(ratio[s] ** 2).sum() + 1 for s in sets])
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            s = sets[i]
            r = ratio[s]
            new = min(max(alpha[i] - (sign[i] * (w[s] @ r + b) - 1) / norm[i], 0.0), upper[i])
            if step := (new - alpha[i]) * sign[i]:
                w[s] += step * r
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins (Newton steps, smoothed targets)."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y == 0).sum() + 2))
    x = np.stack([margin, np.ones(len(margin))])
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - t) + 1e-3 * ab)
        ab = ab - np.clip(step, -2, 2)
    return max(float(ab[0]), 1e-3), float(ab[1])


def fit(rows: DataFrame) -> Model:
    """Model from labelled training rows (doc_id, text, y)."""
    counts = np.zeros((2, FEATURES + 1))
    got = feature_counts(rows).toArrow()  # one row per hashed feature at most
    counts[:, got.column("f").to_numpy()] = got.column("n0").to_numpy(), got.column("n1").to_numpy()
    totals = counts[:, FEATURES]
    if not totals.all():
        share = totals[1] / totals.sum() if totals.sum() else 0.5
        return Model(np.zeros(FEATURES), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    p = (counts[:, :FEATURES] + 1) / (totals[:, None] + 2)
    ratio = np.log(p[1] / p[0])
    share = min(1.0, SAMPLE / totals.sum())
    sample = rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(
        "text", "y", F.xxhash64(F.lit(7), "doc_id").alias("h"), F.xxhash64("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                f, bounds = indicators(part.column("text"))
                sets = pa.ListArray.from_arrays(bounds.astype(np.int32), f.astype(np.int32))
                yield pa.RecordBatch.from_arrays([sets, *(part.column(c) for c in ("y", "h", "t"))], names=["f", "y", "h", "t"])

    got = sample.mapInArrow(run, "f array<int>, y int, h long, t long").toArrow()  # about SAMPLE rows
    y, h, t = (got.column(c).to_numpy() for c in ("y", "h", "t"))
    # each row's features stay where Arrow put them
    lists = [x for chunk in got.column("f").chunks for x in _views(chunk)]
    order = np.lexsort((y, t, h))  # rows of one id and text are alike
    test = h.astype(np.uint64) % U(5) == 0
    fitted, tried = order[~test[order]], order[test[order]]
    w, b = descend([lists[i] for i in fitted], y[fitted], ratio)
    m = Model(w * ratio, b, 1.0, 0.0)
    bounds = np.array([0, 0])
    margin = np.array([m.margins(lists[i], bounds + [0, len(lists[i])])[0] for i in tried])
    m.slope, m.shift = calibrate(margin, y[tried])
    return m


def _views(chunk: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list array as slices of its one buffer."""
    flat, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def held_out(doc_id: str = "doc_id", parts: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``score`` and ``predicted``."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    y = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    rows = d.where(~held_out()).join(small(y, BROADCAST_LABELS), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                s = shared.value.scores(*indicators(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    return d.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
