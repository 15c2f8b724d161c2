"""Exact top-k search by inner product with multi-resolution segment statistics.

Each component x of a vector becomes floor(256 * x). For a query q and a candidate c,
q.c = (|q|^2 + |c|^2 - d^2) / 2, so the highest scores are the least squared distances d^2 for
given norms. A vector is cut into segments; with segment means m and deviations s,
d^2 >= sum of len * ((m_q - m_c)^2 + (s_q - s_c)^2), the lower-bound distance. Norms and bound
together bound the score by sum of len * (m_q m_c + s_q s_c): itself an inner product of
short vectors. The levels go from one segment to a quarter of the dimensions; a pair goes
on to the next level, and at last to its exact integer product, only while its bound reaches
the query's k-th best score so far. Bounds carry a slack for rounding, so no pair is lost.

Queries are numbered, cut into blocks of at most ``BLOCK_BYTES`` and landed. A block at a time
goes to the executors as a broadcast of that bounded size, which scan every candidate once:
candidates are not shuffled. A query's first threshold is its k-th best among the
first ``SEEDS`` queries of its block, which are candidates as well. Each task keeps k pairs a
query and returns them; the k best of all tasks follow by a window with a partial limit.
Each block's result is written before the next one starts.

Work grows with queries times candidates where bounds do not prune; nothing is skipped then.

Defined results: vectors that are null, hold a null or a non-finite component, or whose
components leave the doubles when multiplied by 256 take no part; a candidate whose length
differs from the query's is none for it; rows that share a query's id are its own; equal rows
of other ids are candidates each; a row with a null id is no query and sorts behind others;
a score that leaves 64 bits counts as the nearest long; fewer than k candidates give fewer
rows; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelset.llm.landing import land
from labelset.session import scratch_path

BLOCK_BYTES = 32 << 20  # of query vectors in one broadcast
TILE_QUERIES, TILE_ROWS = 512, 2048  # pairs of one bound matrix in a task
PAIR_BYTES = 16 << 20  # of vectors gathered for a finer level at once
SPARSE = 32  # fewer than one pair in so many: go on pair by pair
SEEDS = 1024
TAME = 1e100  # norms up to this have floating bounds
PLAIN = 2.0 ** 25  # norms up to this give products that are exact in a double
LONG = 2**63 - 1


def vectors_of(column: pa.Array | pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer matrix, by vector length, of the rows of an array column that take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), -1,
                     column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls read as NaN
    ends = np.cumsum(np.maximum(sizes, 0))
    out = []
    for d in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        x = flat[(ends[rows] - d)[:, None] + np.arange(d)].reshape(len(rows), d)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(256.0 * x)
        ok = np.isfinite(x).all(axis=1)
        out.append((rows[ok], x[ok]))
    return out


def levels(d: int) -> list[np.ndarray]:
    """Segment starts of each level: 1, 4, 16, ... segments of at least 4 components."""
    out, n = [], 1
    while n == 1 or n * 4 <= d:
        out.append((np.arange(n) * d) // n)
        n *= 4
    return out if d else []


def statistics(x: np.ndarray) -> list[np.ndarray]:
    """For each level the vectors (sqrt(len) * mean, sqrt(len) * deviation) whose inner products bound the scores."""
    d, out = x.shape[1], []
    for starts in levels(d):
        size = np.diff(np.r_[starts, d]).astype(float)
        mean = np.add.reduceat(x, starts, axis=1) / size
        var = np.add.reduceat((x - np.repeat(mean, size.astype(int), axis=1)) ** 2, starts, axis=1)
        out.append(np.concatenate([mean * np.sqrt(size), np.sqrt(var)], axis=1))
    return out


def big(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer products of the rows of q and c, pair by pair, for vectors too long for exact doubles; held to 64 bits."""
    exact = (sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q.tolist(), c.tolist()))
    return np.array([max(-LONG - 1, min(LONG, s)) for s in exact], dtype=np.int64)


@dataclass
class Block:
    """Queries of one length: numbers within the whole block, ids, integer vectors, norms, statistics, thresholds."""

    no: np.ndarray
    ids: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    stats: list[np.ndarray]
    least: np.ndarray  # a score that at least k candidates of the query reach; -inf: none known

    def slack(self, q: np.ndarray | slice, norm: np.ndarray) -> np.ndarray:
        """Bound of the rounding of a bound or a floating product of these queries with vectors of such norms."""
        return self.norm[q] * norm * ((self.x.shape[1] + 8) * 2.0 ** -48) + 1e-300


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(axis=1))


def query_blocks(ids: np.ndarray, column: pa.Array) -> list[Block]:
    """Queries by length; those whose norm is too great for floating bounds apart."""
    out = []
    for rows, x in vectors_of(column):
        norm = norms(x)
        for some in (norm <= TAME, ~(norm <= TAME)):
            if some.any():
                out.append(Block(rows[some], ids[rows[some]], x[some], norm[some], statistics(x[some]), np.full(some.sum(), -np.inf)))
    return out


def distinct(ids: np.ndarray, null: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without copies of one vector beyond its k + 1 smallest ids: no others can be among a query's k best."""
    met: dict[bytes, int] = {}
    keep = np.zeros(len(ids), dtype=bool)
    for r in np.lexsort((ids, null)).tolist():
        key = x[r].tobytes()
        met[key] = met.get(key, 0) + 1
        keep[r] = met[key] <= k + 1
    return keep


class Best:
    """The k best candidates of every query of a block met so far, and the threshold that follows."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.found = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64))  # query, id, null id, score
        self.least = block.least.copy()

    def add(self, q: np.ndarray, ids: np.ndarray, null: np.ndarray, scores: np.ndarray) -> None:
        """Pairs in any order, scores as 64-bit integers; among equal scores the smaller id is better, a null id worst."""
        q, ids, null, scores = (np.concatenate(x) for x in zip(self.found, (q, ids, null, scores)))
        order = np.lexsort((ids, null, ~scores, q))
        q, ids, null, scores = q[order], ids[order], null[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep, full = rank < self.k, rank == self.k - 1
        self.found = (q[keep], ids[keep], null[keep], scores[keep])
        self.least[q[full]] = np.maximum(self.least[q[full]], scores[full].astype(float))

    def search(self, ids: np.ndarray, null: np.ndarray, c: np.ndarray) -> None:
        """Meet candidates of the block's length."""
        some = distinct(ids, null, c, self.k)
        ids, null, c = ids[some], null[some], c[some]
        norm = norms(c)
        tame = norm <= TAME if self.block.norm[0] <= TAME else np.zeros(len(c), dtype=bool)
        for r in np.flatnonzero(~tame):  # no floating bounds: exact products with every query
            q = np.flatnonzero(self._others(slice(None), ids[r:r + 1], null[r:r + 1])[:, 0])
            self.add(q, np.repeat(ids[r], len(q)), np.repeat(null[r], len(q)), big(self.block.x[q], np.repeat(c[r:r + 1], len(q), axis=0)))
        ids, null, c, norm = ids[tame], null[tame], c[tame], norm[tame]
        for at in range(0, len(c), TILE_ROWS):
            to = at + TILE_ROWS
            self._tile(ids[at:to], null[at:to], c[at:to], norm[at:to], statistics(c[at:to]))

    def _others(self, some: slice, ids: np.ndarray, null: np.ndarray) -> np.ndarray:
        return (self.block.ids[some, None] != ids[None, :]) | null[None, :]

    def _tile(self, ids: np.ndarray, null: np.ndarray, c: np.ndarray, norm: np.ndarray, stats: list[np.ndarray]) -> None:
        """Bounds from coarse to fine, then products: for the whole tile while many pairs are left, else pair by pair."""
        b = self.block
        for q0 in range(0, len(b.no), TILE_QUERIES):
            some = slice(q0, min(q0 + TILE_QUERIES, len(b.no)))
            left, least = self._others(some, ids, null), self.least[some, None]
            slack = b.slack(some, norm[:, None]).T
            level = 0
            while level < len(stats) and left.sum() * SPARSE > left.size:
                left &= b.stats[level][some] @ stats[level].T + slack >= least
                level += 1
            plain = (b.norm[some] <= PLAIN).all() and (norm <= PLAIN).all()
            if plain and left.sum() * SPARSE > left.size:
                scores = np.where(left, b.x[some] @ c.T, -np.inf)
                if scores.shape[1] > self.k:  # only a row's k best and what equals them
                    least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k, None])
                qi, ci = np.nonzero((scores >= least) & left)
                self.add(qi + q0, ids[ci], null[ci], scores[qi, ci].astype(np.int64))
                continue
            qi, ci = np.nonzero(left)
            step = max(1, PAIR_BYTES // (16 * max(1, c.shape[1])))
            for at in range(0, len(qi), step):
                self._pairs(qi[at:at + step] + q0, ci[at:at + step], level, ids, null, c, norm, stats)

    def _pairs(self, q: np.ndarray, i: np.ndarray, level: int, ids: np.ndarray, null: np.ndarray, c: np.ndarray,
               norm: np.ndarray, stats: list[np.ndarray]) -> None:
        b = self.block
        for mine, theirs in zip(b.stats[level:], stats[level:]):
            left = np.einsum("ij,ij->i", mine[q], theirs[i]) + b.slack(q, norm[i]) >= self.least[q]
            q, i = q[left], i[left]
        plain = (b.norm[q] <= PLAIN) & (norm[i] <= PLAIN)
        p, j = q[~plain], i[~plain]
        if len(p):
            self.add(p, ids[j], null[j], big(b.x[p], c[j]))
        p, j = q[plain], i[plain]
        if len(p):
            scores = np.einsum("ij,ij->i", b.x[p], c[j])
            keep = scores >= self.least[p]
            self.add(p[keep], ids[j[keep]], null[j[keep]], scores[keep].astype(np.int64))


def _ids(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as 64-bit integers (0 for null) and which are null."""
    null = column.is_null().to_numpy(**({} if isinstance(column, pa.ChunkedArray) else {"zero_copy_only": False}))
    return column.cast(pa.int64()).fill_null(0).to_numpy().astype(np.int64), null


def _seeds(spark: SparkSession, sent: Broadcast, counts: list[int], k: int) -> list[np.ndarray]:
    """For each part of the query block the k-th best score of its queries among its first ``SEEDS`` queries."""
    work = [(p, at) for p, n in enumerate(counts) for at in range(0, n, TILE_ROWS)]

    def first_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = sent.value[part]
                least = np.full(min(TILE_ROWS, len(b.no) - at), -np.inf)
                rows, few = slice(at, at + TILE_ROWS), slice(0, SEEDS)
                if max(b.norm[rows].max(), b.norm[few].max()) <= PLAIN and len(b.no) > k:
                    scores = b.x[rows] @ b.x[few].T
                    scores[b.ids[rows, None] == b.ids[None, few]] = -np.inf
                    if scores.shape[1] >= k:
                        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                yield pa.RecordBatch.from_pydict({"part": [part] * len(least), "at": np.arange(at, at + len(least)), "least": least})

    out = [np.full(n, -np.inf) for n in counts]
    found = (spark.createDataFrame(work, "part bigint, at bigint").repartition(len(work))
             .mapInArrow(first_scores, "part bigint, at bigint, least double").toArrow())
    for part, at, least in zip(*(found.column(c).to_numpy() for c in ("part", "at", "least"))):
        out[part][at] = least
    return out


def _scan(rows: DataFrame, sent: Broadcast, least: Broadcast, k: int) -> DataFrame:
    """The k best candidates of each task for each query of the block."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(replace(b, least=t), k) for b, t in zip(sent.value, least.value)]
        for batch in batches:
            ids, null = _ids(batch.column(0))
            for at, c in vectors_of(batch.column(1)):
                for mine in best:
                    if mine.block.x.shape[1] == c.shape[1]:
                        mine.search(ids[at], null[at], c)
        for mine in best:
            q, found, none, score = mine.found
            yield pa.RecordBatch.from_arrays([pa.array(mine.block.no[q]), pa.array(mine.block.ids[q]), pa.array(found, mask=none), pa.array(score)],
                                             names=["q", "query_id", "found", "score"])

    return rows.mapInArrow(meet, "q bigint, query_id bigint, found bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``query_id, rank, id_col, score``: the k candidates of highest score for each row for which ``is_query`` holds.

    Ids are integers; ``vec_col`` is an array of numbers.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = land(vectors.where(is_query & F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
                 .select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
                 .withColumn("no", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(24 + 8 * F.size("v").cast("long"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    shape = f"query_id bigint, rank int, `{id_col}` bigint, score bigint"
    out = scratch_path(spark, f"top-k-{uuid.uuid4().hex}")
    for number in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == number).orderBy("no").toArrow()
        block = query_blocks(_ids(part.column("id"))[0], part.column("v"))
        if not block:
            continue
        sent = spark.sparkContext.broadcast(block)
        least = spark.sparkContext.broadcast(_seeds(spark, sent, [len(b.no) for b in block], k))
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("found"))
        ranked = _scan(rows, sent, least, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", F.col("found").alias(id_col), "score").write.mode("append").parquet(out)
        for held in (sent, least):
            held.unpersist()
        del block, part
    return spark.read.schema(shape).parquet(out) if blocks else spark.createDataFrame([], shape)
