"""Array helpers on Arrow text columns: word bounds, word hashes, rolling n-gram hashes.

Everything here works on one bounded chunk of a record batch inside a task. A word is a
maximal run of bytes other than 0x20 and 0x09-0x0D. Word hashes are 64-bit polynomial
hashes with a finaliser; n-gram hashes are rolling polynomials over word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.r_[U(1), np.full(size - 1, U(b), dtype=np.uint64)],
                                             dtype=np.uint64) for b in (self.base, self.inv))
        return self.up[:n], self.down[:n]


_CHARS, _GRAMS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(29))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def text_chunks(batch: pa.RecordBatch, text_col: str = "text",
                limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most ``limit`` text bytes (or one row); null text reads as empty."""
    if batch.num_rows == 0:
        return
    i = batch.schema.get_field_index(text_col)
    batch = batch.set_column(i, text_col, pc.fill_null(batch.column(i).cast(pa.string()), ""))
    ends = np.cumsum(pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of the texts of one chunk.

    ``start``/``end``: byte bounds in ``data``; ``doc``: row of each word; ``first``: index of
    each row's first word, with the word count at its end; ``hash``: 64-bit word hashes.
    """

    def __init__(self, texts: pa.Array):
        off, raw = np.zeros(1, dtype=np.int64), None
        if len(texts):
            off = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
            raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        self.data, self.off, n = data, off, len(data)
        space = _SPACE[data]
        edge = np.ones(n + 1, dtype=bool)
        edge[1:n] = space[:-1]
        inner = off[off < n]
        edge[inner] = True
        self.start = np.flatnonzero(~space & edge[:n])
        edge[:n] = False
        edge[n] = True
        edge[:n] |= space
        edge[inner] = True
        self.end = np.flatnonzero(~space & edge[1:]) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        up, down = _CHARS.get(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (meaningless where they leave the row; see ``whole``)."""
        n = len(self)
        up, down = _GRAMS.get(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * up[:n], out=total[1:])
        to = np.minimum(np.arange(n) + k, n)
        return mix((total[to] - total[:n]) * down[:n] + U(k))

    def whole(self, k: int) -> np.ndarray:
        """True where k words from this one on lie in one row."""
        ok = np.zeros(len(self), dtype=bool)
        if len(self) >= k:
            ok[:len(self) - k + 1] = self.doc[:len(self) - k + 1] == self.doc[k - 1:]
        return ok

    def bytes_of(self, row: int) -> bytes:
        return self.data[self.off[row]:self.off[row + 1]].tobytes()
