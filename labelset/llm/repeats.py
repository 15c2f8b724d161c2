"""Repeated passages by window minimisers against indexed reference blocks.

A word goes if a window of SPAN consecutive words covers it whose word sequence starts earlier
too (smaller document id, or same document and earlier start); windows are judged on the input.

Method. This stands in for a greedy relative Lempel-Ziv parse: no longest factors are formed, as the
result needs only which windows occur earlier. The anchor of a window is the smallest of its ANCHOR-word
hashes (leftmost on ties), so equal windows have equal anchors at equal places, and a block holds
the windows that its anchor stands for. The index keeps, per anchor hash that occurs again, the
block of its first place. At every anchor of a document the windows that agree with the indexed
block are known to be repeats. Windows whose anchor is indexed but whose block disagrees are
grouped exactly with all other such windows, which is complete, since every further place of such
a window disagrees with the same block.

Anchors are counted with a map-side combine and joined by hash, no occurrence list is ever
gathered. A bit table of fixed size over the indexed anchors keeps the anchors that occur once
out of the second shuffle; a full table only lets more of them through. Windows are compared
by anchor hash and window hash, 128 bits together.

Defined results: null text has no words; rows that share an id count as one document (equal
rows lose nothing to each other); rows with a null id come first and stay whole; texts of fewer
than SPAN words stay whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelset.llm.landing import land, small
from labelset.llm.textcore import U, Words, text_chunks

SPAN, ANCHOR = 20, 6
#: Bits of the anchor filter: 16 MiB, whatever the corpus.
FILTER_BITS = 1 << 27
#: Span tables of at most this many documents (about 100 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 150_000
BLOCK_COLUMNS = "h long, doc long, p int, s int, windows array<long>"


def anchors(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, anchor word, first window, number of windows) of every anchor, in text order."""
    w = Words(texts)
    n, width = len(w), SPAN - ANCHOR + 1
    ok = np.flatnonzero(w.whole(SPAN))
    if not len(ok):
        return w, *(np.zeros(0, dtype=np.int64),) * 3
    g = w.grams(ANCHOR)
    best, size = np.arange(n), 1
    while size < width:  # leftmost smallest of 1, 2, 4, ... and finally ``width`` grams
        step = min(size, width - size)
        right = best[step:]
        left = best[:len(right)]
        best = np.where(g[right] < g[left], right, left)
        size += step
    own = best[ok]
    new = np.ones(len(ok), dtype=bool)
    new[1:] = (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return w, own[at], ok[at], np.diff(np.r_[at, len(ok)])


def _places(docs: DataFrame) -> DataFrame:
    """Every anchor occurrence: ``h``, ``doc``, ``p``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                w, p, _, _ = anchors(part.column("text"))
                row = w.doc[p]
                yield pa.RecordBatch.from_arrays([pa.array(w.grams(ANCHOR)[p].view(np.int64)), part.column("doc").take(pa.array(row)), pa.array((p - w.first[row]).astype(np.int32))],
                                                 names=["h", "doc", "p"])

    return docs.mapInArrow(run, "h long, doc long, p int")


def bit_table(positions: DataFrame) -> np.ndarray:
    """Bytes of the table with the bits in column ``x`` set: FILTER_BITS / 8 bytes, built by bucket on the executors."""
    x = F.col("x") + 1  # bitmap buckets count from 1
    rows = positions.groupBy(F.bitmap_bucket_number(x).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _blocks(docs: DataFrame, table) -> DataFrame:
    """Blocks (BLOCK_COLUMNS) of the anchors that pass the bit table (a broadcast of its bytes).

    The two bits of an anchor are the halves of its hash modulo the table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for part in text_chunks(batch):
                w, p, s, count = anchors(part.column("text"))
                h = w.grams(ANCHOR)[p]
                pass_ = np.ones(len(p), dtype=bool)
                for x in (h % U(FILTER_BITS), (h >> U(32)) % U(FILTER_BITS)):
                    pass_ &= (bits[x >> U(3)] >> (x & U(7)).astype(np.uint8) & 1).astype(bool)
                p, s, count, h = p[pass_], s[pass_], count[pass_], h[pass_]
                row = w.doc[p]
                ends = np.cumsum(count)
                take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(s - (ends - count), count)
                windows = pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), w.grams(SPAN)[take].view(np.int64))
                first = w.first[row]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("doc").take(pa.array(row)), pa.array((p - first).astype(np.int32)),
                                                  pa.array((s - first).astype(np.int32)), windows], names=["h", "doc", "p", "s", "windows"])

    return docs.mapInArrow(run, BLOCK_COLUMNS)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Parse of ``docs`` (doc, text): ``doc`` and ``starts`` (word numbers of repeated windows), in several rows a document."""
    spark = docs.sparkSession
    index = land(_places(docs).groupBy("h").agg(F.min(F.struct("doc", "p")).alias("first"), F.count("*").alias("n"))
                 .where("n > 1").select("h", "first"))
    halves = F.array(F.col("h").bitwiseAND(FILTER_BITS - 1), F.shiftright("h", 32).bitwiseAND(FILTER_BITS - 1))
    table = spark.sparkContext.broadcast(bit_table(index.select(F.explode(halves).alias("x"))))
    # the index is small against the anchors; both sides of the parse meet it by anchor hash
    near = _blocks(docs, table).join(index, "h")
    here = F.struct("doc", "p")
    block = near.where(here.eqNullSafe(F.col("first"))).select("h", F.col("p").alias("rp"), F.col("s").alias("rs"), F.col("windows").alias("ref"))
    block = block.dropDuplicates(["h"])
    other = near.where(~here.eqNullSafe(F.col("first"))).drop("first")
    both = other.join(block, "h")
    shift = F.col("rp") - F.col("rs") - F.col("p") + F.col("s")
    both = both.withColumn("shift", shift).select("h", "doc", "s", "windows", F.transform("windows", lambda x, j: F.coalesce(x == F.get("ref", j + F.col("shift")), F.lit(False))).alias("same"))
    parsed = land(both.select(
        "h", "doc", F.filter(F.transform("same", lambda ok, j: F.when(ok, F.col("s") + j)), lambda x: x.isNotNull()).alias("starts"),
        F.filter(F.transform("windows", lambda x, j: F.when(~F.get("same", j), F.struct((F.col("s") + j).alias("at"), x.alias("window")))), lambda x: x.isNotNull()).alias("rest")))
    rest = parsed.select("h", "doc", F.explode("rest").alias("r")).select("h", "doc", "r.at", "r.window")
    first = rest.groupBy("h", "window").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = rest.join(first, ["h", "window"]).where(~F.struct("doc", "at").eqNullSafe(F.col("first"))).select("doc", F.array("at").alias("starts"))
    return parsed.where(F.size("starts") > 0).select("doc", "starts").unionByName(late)


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with repeated words ``doc``, ``begins`` and ``ends``: its spans of repeated words, in word numbers."""
    found = repeated_windows(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")))
    # a document's own windows: at most as many as its words
    at = found.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("at"))
    first = F.filter("at", lambda x, i: F.coalesce(x - F.get("at", i - 1) > SPAN, F.lit(True)))
    last = F.filter("at", lambda x, i: F.coalesce(F.get("at", i + 1) - x > SPAN, F.lit(True)))
    return at.select("doc", first.alias("begins"), F.transform(last, lambda x: x + SPAN).alias("ends"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``n_removed`` and ``text`` (kept words joined by one space)."""
    cut = small(land(spans(docs, doc_id, text)), BROADCAST_ROWS)
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).join(cut, "doc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                n, gone, kept = [], [], []
                cols = (part.column(c).to_pylist() for c in ("begins", "ends"))
                for data, begins, ends in zip(part.column("text").cast(pa.binary()).to_pylist(), *cols, strict=True):
                    words = data.split()
                    n.append(len(words))
                    if begins:
                        keep, at = [], 0
                        for a, b in zip(begins, ends, strict=True):
                            keep += words[at:a]
                            at = b
                        words = keep + words[at:]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                                 names=["doc_id", "n_words", "n_removed", "text"])

    return d.select("doc", "text", "begins", "ends").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")
