"""Near-duplicate join on word shingles: MinHash bands of one depth, then exact verification.

Texts are sets of 5-word shingles (a text of 1 to 4 words is one shingle of all its words);
two texts are linked if the Jaccard similarity of their sets is at least 0.8.

1. Texts of equal shingle set (count and 128 hash bits) are one class entry with a multiplicity.
2. Every entry gets TREES keys of MinHash values, all of one depth: the greatest of at most MAX_DEPTH values at
   which the chance that two texts at the threshold share a key reaches the target recall. This
   stands in for a forest: there are no sorted tries and no depth per entry.
3. Entries that meet are joined to coarse groups through their key's smallest entry, so
   a key of n entries costs n rows and not n * n.
4. Exact verification runs inside coarse groups. A group is dealt by hash to blocks of about
   BLOCK entries, each pair of blocks is one task that multiplies the incidence matrices of
   its shared shingles; it returns link counts and a spanning forest of the links, never the
   pairs. A group of n entries is read n / BLOCK times; work inside it is quadratic, as exact
   link counts need.
5. Components of the verified links are the classes.

Defined results: null texts and texts without words are classes of their own without links;
equal texts are linked; rows that share an id count as one document; an empty table gives an
empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelset.llm.components import components
from labelset.llm.textcore import U, Words, mix, text_chunks
from labelset.session import cut_lineage

SHINGLE = 5
THRESHOLD = (4, 5)  # as a fraction, so that the comparison is exact
TREES, MAX_DEPTH, TARGET_RECALL = 20, 8, 0.995
BLOCK = 256
#: Member tables of at most this many rows (about 50 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 300_000


def prefix_depth(similarity: float, trees: int = TREES, max_depth: int = MAX_DEPTH, target: float = TARGET_RECALL) -> int:
    """Longest prefix at which two texts of this similarity meet in some tree with the target chance."""
    depth = max_depth
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < target:
        depth -= 1
    return depth


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, bounds): the sorted distinct shingles of row r are hashes[bounds[r]:bounds[r + 1]]."""
    w = Words(texts)
    count = np.diff(w.first)
    ok = w.whole(size)
    gram, doc = w.grams(size)[ok], w.doc[ok]
    for k in range(1, size):
        rows = np.flatnonzero(count == k)
        if len(rows):
            gram = np.concatenate([gram, w.grams(k)[w.first[rows]]])
            doc = np.concatenate([doc, rows])
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    return gram, np.searchsorted(doc, np.arange(len(texts) + 1))


def _reduce(ufunc, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``ufunc`` over each row's values; 0 for rows without values."""
    out = np.zeros(len(bounds) - 1, dtype=values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out


def _prints(gram: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (_reduce(np.add, mix(gram), bounds).view(np.int64), _reduce(np.bitwise_xor, mix(gram + U(0x5851F42D4C957F2D)), bounds).view(np.int64))


def signatures(docs: DataFrame, depth: int, doc_id: str = "doc_id", text: str = "text", trees: int = TREES) -> DataFrame:
    """``doc_id``, ``n`` (distinct shingles), ``f1``, ``f2`` (set fingerprints), ``keys`` (per tree, hash of the prefix)."""
    rng = np.random.default_rng(7)
    mul = rng.integers(1, 2**63, trees * depth, dtype=np.uint64) * U(2) + U(1)
    add = rng.integers(0, 2**63, trees * depth, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                gram, bounds = shingle_sets(part.column("text"))
                f1, f2 = _prints(gram, bounds)
                keys = np.zeros((part.num_rows, trees), dtype=np.uint64)
                for j in range(trees * depth):
                    low = _reduce(np.minimum, (gram * mul[j] + add[j]) >> U(32), bounds)
                    keys[:, j // depth] = mix(keys[:, j // depth] * U(0x9E3779B97F4A7C15) + low)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(f1), pa.array(f2),
                     pa.ListArray.from_arrays(np.arange(0, keys.size + 1, trees, dtype=np.int32), keys.view(np.int64).ravel())],
                    names=["doc_id", "n", "f1", "f2", "keys"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n long, f1 long, f2 long, keys array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """Member rows with their text replaced by the shingle set; rows whose set is not the entry's go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                gram, bounds = shingle_sets(part.column("text"))
                f1, f2 = _prints(gram, bounds)
                same = (f1 == part.column("f1").to_numpy()) & (f2 == part.column("f2").to_numpy())
                sets = pa.array([gram[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("comp", "rep", "copies", "blocks")), sets],
                                                 names=["comp", "rep", "copies", "blocks", "shingles"])
                yield out.filter(pa.array(same))

    return rows.select("comp", "rep", "copies", "blocks", "f1", "f2", "text").mapInArrow(
        run, "comp long, rep long, copies long, blocks long, shingles binary")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``."""
    size = np.array([len(s) for s in sets])
    _, col, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = seen[col] > 1
    row, col = np.repeat(np.arange(len(sets)), size)[keep], col[keep]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)))
    at = 0
    while at < len(col):  # columns in slices of 4096
        to = int(np.searchsorted(col, col[at] + 4096))
        m = np.zeros((len(sets), 4096), dtype=np.float32)
        m[row[at:to], col[at:to] - col[at]] = 1
        out += m[left] @ m[right].T
        at = to
    return out.astype(np.int64)


def _verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Link counts (a, a, count) and spanning edges (a, b, 0) of one pair of blocks of a group."""
    pdf = pdf.drop_duplicates(["rep", "side"])
    sets = [np.frombuffer(b, dtype=np.uint64) for b in pdf["shingles"]]
    rep, copies, side = (pdf[c].to_numpy() for c in ("rep", "copies", "side"))
    alone = key[1] == key[2]
    left, right = (np.arange(len(rep)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": [], "c": []}).astype("int64")
    both = _overlaps(sets, left, right)
    size = np.array([len(s) for s in sets])
    num, den = THRESHOLD
    link = (den + num) * both >= num * (size[left][:, None] + size[right][None, :])
    if alone:
        np.fill_diagonal(link, False)
    count = np.zeros(len(rep), dtype=np.int64)
    count[left] = link @ copies[right]
    if not alone:
        count[right] = link.T @ copies[left]
    root = np.arange(len(rep))
    while True:  # smallest place that each row reaches through links
        new = root.copy()
        new[left] = np.minimum(new[left], np.where(link, root[right][None, :], len(rep)).min(axis=1))
        new[right] = np.minimum(new[right], np.where(link, new[left][:, None], len(rep)).min(axis=0))
        if (new == root).all():
            break
        root = new
    own, tied = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(rep)))
    return pd.DataFrame({"a": np.r_[rep[own], rep[tied]], "b": np.r_[rep[own], rep[root[tied]]], "c": np.r_[count[own], np.zeros(len(tied), np.int64)]})


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``class_id`` (smallest id of its class) and ``n_links`` (other documents linked to it)."""
    num, den = THRESHOLD
    sig = cut_lineage(signatures(docs, prefix_depth(num / den), doc_id, text))
    reps = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(
        F.min(F.struct("doc_id", "keys")).alias("x"), F.count_distinct("doc_id").alias("copies")).select(
        F.col("x.doc_id").alias("rep"), "n", "f1", "f2", "copies", F.col("x.keys").alias("keys"))
    reps = cut_lineage(reps)
    met = reps.select("rep", F.posexplode("keys").alias("tree", "key"))
    node = met.groupBy("tree", "key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").drop("last")
    edges = met.join(node, ["tree", "key"]).where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    coarse = cut_lineage(components(edges))
    size = coarse.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = coarse.join(size, "comp").withColumnRenamed("node", "rep").join(reps.select("rep", "f1", "f2", "copies"), "rep")
    members = cut_lineage(members)
    few = members.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text")).join(F.broadcast(members) if few else members, "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    dealt = _sets(texts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                         F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "copies", "shingles")
    found = cut_lineage(dealt.groupBy("comp", "i", "j").applyInPandas(_verify, "a long, b long, c long"))
    classes = components(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy("a").agg(F.sum("c").alias("links"))
    entry = reps.join(classes, F.col("rep") == F.col("node"), "left").join(counts, F.col("rep") == F.col("a"), "left").select(
        "n", "f1", "f2", F.coalesce("comp", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sig.select("doc_id", "n", "f1", "f2").join(entry, ["n", "f1", "f2"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
