"""Sequence packing by minimum bin slack.

Documents become token ids followed by an end id; those over the capacity are cut into pieces
of the capacity, the last piece may be shorter. The packer works on the histogram of piece
lengths, which has at most ``capacity`` rows however large the corpus is: for each bin the
longest length left is taken, a bitset subset-sum program over the available lengths finds the
fullest combination with it, and that combination is removed as many times as it is available.
Pieces then find their place from their rank within their length. Ranks come from salted
groups of bounded size, so no length holds one task up.

Defined results: null text packs as an empty document (the end id alone); repeated rows are
packed each; an empty table gives an empty table; texts of any length are read whole; input
columns other than the id and the text are not carried.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelset.llm.textcore import text_chunks
from labelset.session import cut_lineage

CAPACITY, END_ID = 4096, 1
#: Rows that one (length, salt) group holds on average at most.
GROUP_ROWS = 20_000
#: Word pieces kept per Python worker with their ids, twice: the ones met last and the ones met before them.
CACHE_PIECES = 400_000
#: Text bytes that are split and looked up together.
CHUNK_BYTES = 8 << 20
#: Pieces that the tokenizer gets in one call, and in one text of that call.
CALL_PIECES, TEXT_PIECES = 16_384, 256
#: Words whose pieces are known without the tokenizer: printable ASCII and Latin letters that
#: stay one letter in lower case. The pieces follow the vocabulary file's own splitter.
PLAIN = r"^[!-~À-ÖØ-öø-įı-ɏ]+$"
PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZÀ-ÖØ-öø-įı-ɏ]+|[0-9]|[^a-zA-ZÀ-ÖØ-öø-įı-ɏ0-9]+)"
#: Ends the vocabulary's last token of each piece.
LAST = "</w>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, _Encoder] = {}


def _plain(words: pa.Array) -> pa.Array:
    return pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))


def _glued(ids: pa.Array, offsets: pa.Array) -> pa.Array:
    """One value for each stretch of ``ids`` (large binary) between two ``offsets``."""
    _, ends, data = ids.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[ids.offset:ids.offset + len(ids) + 1]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets.to_numpy()]), data])


class _Encoder:
    """The worker's tokenizer for a vocabulary file, with the ids of the pieces met last."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.last[[i for token, i in vocab.items() if token.endswith(LAST)]] = True
        self.met: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of pieces of plain words, many encoded as one text; a piece ends where a last token stands."""
        for at in range(0, len(pieces), CALL_PIECES):
            some = pieces[at:at + CALL_PIECES]
            ids = np.concatenate(self._ids([" ".join(some[k:k + TEXT_PIECES]) for k in range(0, len(some), TEXT_PIECES)]))
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(some) and ends[-1] == 4 * len(ids):
                data = ids.tobytes()
                yield from (data[a:b] for a, b in zip([0, *ends], ends, strict=False))
            else:  # a vocabulary that does not mark last tokens
                yield from (x.tobytes() for x in self._ids(some))

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.met.get, pieces))
        late = [k for k, ids in enumerate(found) if ids is None]
        names = [pieces[k] for k in late]
        new = dict(zip(names, map(self.before.get, names), strict=True))
        unknown = [x for x, ids in new.items() if ids is None]
        plain = _plain(pa.array(unknown, pa.large_string())).to_pylist()
        whole = [x for x, p in zip(unknown, plain, strict=True) if not p]
        split = [x for x, p in zip(unknown, plain, strict=True) if p]
        for at in range(0, len(whole), CALL_PIECES):
            some = whole[at:at + CALL_PIECES]
            new.update(zip(some, (x.tobytes() for x in self._ids(some)), strict=True))
        new.update(zip(split, self._encode(split), strict=True))
        self.met.update(new)
        if len(self.met) > CACHE_PIECES:
            self.met, self.before = {}, dict(islice(self.met.items(), CACHE_PIECES))
        for k, ids in zip(late, new.values(), strict=True):
            found[k] = ids
        return found

    def ids_of(self, words: pa.Array) -> pa.Array:
        """Ids of each of the distinct words; the tokenizer gets pieces that were not met lately."""
        words = words.cast(pa.large_string())
        cut = pc.ascii_rtrim_whitespace(pc.replace_substring_regex(words, PIECE, r"\1 "))
        cut = pc.ascii_split_whitespace(pc.if_else(_plain(words), cut, words))
        parts = cut.values.dictionary_encode()
        ids = pa.array(self._look_up(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        return _glued(ids.take(parts.indices), cut.offsets)


def token_bytes(texts: pa.Array | list[bytes], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers.

    Words (runs without ASCII white space) are encoded once each: this vocabulary's splitter
    drops white space and none of its pieces spans it, so a text's ids are its words' ids in
    order. It also folds case, so A-Z go to lower case first, unless the text could hold the
    name of a special token.
    """
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    each = words.values.dictionary_encode()
    ids = _glued(_encoders[path].ids_of(each.dictionary).take(each.indices), words.offsets)
    for k in range(len(ids)):
        yield ids[k].as_py()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of each document: PIECES."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for part in text_chunks(batch, limit=CHUNK_BYTES):
                out: list[tuple] = []
                for key, data in zip(part.column("doc_id").to_pylist(), token_bytes(part.column("text"), tokenizer_path), strict=True):
                    data += end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[at:at + 4 * capacity]
                        out.append((key, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def fullest(available: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths, the longest one included, that fills most of the capacity."""
    first = max(available)
    room, reach, steps = capacity - first, 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(available, reverse=True):
        left = min(available[length] - (length == first), room // length)
        size = 1
        while left > 0 and not reach >> room & 1:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {first: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins as (number of equal bins, lengths in each), from the counts of the lengths."""
    left, out = {k: n for k, n in histogram.items() if n}, []
    while left:
        used = fullest(left, capacity)
        times = min(left[k] // n for k, n in used.items())
        out.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def _ranked(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``rows`` with ``rank``, 0 to n - 1 within each length."""
    spark = rows.sparkSession
    salts = spark.createDataFrame([(k, -(-n // GROUP_ROWS)) for k, n in histogram.items()], "length long, salts long")
    salted = rows.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts"))).drop("salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("rank", F.row_number().over(inside) - 1).join(base, ["length", "salt"]).withColumn(
        "rank", F.col("rank") + F.col("base")).drop("salt", "base")


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (PIECES) with ``sequence_id`` and ``offset``."""
    rows = cut_lineage(rows)
    # at most one row per length up to the capacity
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spans: dict[int, list[tuple]] = {k: [] for k in histogram}
    taken, bins = dict.fromkeys(histogram, 0), 0
    for times, used in plan_bins(histogram, capacity):
        for at, (length, n) in zip(accumulate((k * n for k, n in used.items()), initial=0), used.items(), strict=False):
            spans[length].append((taken[length], n, bins, at))
            taken[length] += n * times
        bins += times
    table = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in spans.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                start, n, first, at = table[int(k)]
                i = np.searchsorted(start, rank[own], side="right") - 1
                inner = rank[own] - start[i]
                seq[own], off[own] = first[i] + inner // n[i], at[i] + inner % n[i] * k
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return _ranked(rows, histogram).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        run, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and their offset in it."""
    return place(pieces(docs, tokenizer_path, capacity, end_id, doc_id, text), capacity)
