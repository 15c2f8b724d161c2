"""Arrow kernels of the token self-join: hash counts, signatures of sets, and the pairs that can be similar.

A set's tokens are ordered from the rarest on (by a class of how often their hash bucket
occurs, then by hash: one order for all sets, exact counts are not needed). Two sets of sizes a <= b with
``need`` tokens in common share one within the first ``size - need + 1`` of each, so only
those meet; what meets is compared by parity sketches before any set moves: every token that is in
one of the two sets only flips at most one bit, so more differing bits than such tokens
exclude the pair. Nothing here loses a pair; hashes that collide only add some.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Hash buckets whose occurrences are counted, and frequency classes for each doubling of a count.
BUCKET_BITS, STEPS, CLASSES = 22, 3, 64
MASK = np.uint64((1 << BUCKET_BITS) - 1)
#: Hash bits that order and name a token beside its class.
NAME_BITS = 44
NAMES = np.uint64((1 << NAME_BITS) - 1)
#: A sketch has 2 to 4 bits a token, within these powers of two.
LEAST_BITS, MOST_BITS = 6, 14
#: Sets signed or dealt at once, and pairs compared at once.
SETS_AT_ONCE, PAIRS_AT_ONCE = 2048, 1 << 18

COUNTS = "bucket int, n long"
SIGNED = "n long, sz int, sketch binary, keys array<int>, pos array<int>"
DEALT = "deal int, " + SIGNED
MET = "a long, b long, at_most double"

_MIX, _MIX_PART = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and each list's length."""
    offsets = np.asarray(col.offsets)
    return np.asarray(col.values)[offsets[0]:offsets[-1]], np.diff(offsets)


def _list_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of these lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each hash bucket in the lists ``h`` of a task."""
    total, held, rows = np.zeros(1 << BUCKET_BITS, np.int64), [], 0
    for b in batches:
        held.append((_lists(b.column("h"))[0].view(np.uint64) & MASK).astype(np.int64))
        rows += len(held[-1])
        if rows > 1 << 20:
            total += np.bincount(np.concatenate(held), minlength=len(total))
            held, rows = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=len(total))
    met = np.flatnonzero(total)
    for i in range(0, len(met), 1 << 16):
        m = met[i:i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(total[m])], names=["bucket", "n"])


def sketch_level(sz: np.ndarray) -> np.ndarray:
    """Power of two of a set's sketch bits; a set of twice the size is at most one level above."""
    return np.clip(np.ceil(np.log2(2 * np.maximum(1, sz))).astype(np.int64), LEAST_BITS, MOST_BITS)


def _sketches(doc: np.ndarray, names: np.ndarray, level: np.ndarray) -> pa.Array:
    """Parities of the token names, as many bits as the level says."""
    first = np.concatenate([[0], np.cumsum(1 << level)])
    bits = first[doc] + (names & ((np.uint64(1) << level[doc].astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    odd = (np.bincount(bits, minlength=first[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(level), [None, pa.py_buffer((first // 8).astype(np.int32)), pa.py_buffer(packed)])


def sign_sets(classes: Callable[[], np.ndarray], posting_rows: int) -> Callable:
    """``n, h`` (number and token hashes of a set) -> SIGNED: its size, sketch and rarest tokens.

    ``pos`` is a token's place in the order; ``keys`` its name. A token in more than ``posting_rows``
    sets has several keys: a set is small in one of them and only large (``-pos``) in the others, so each pair meets
    once. A bucket that occurs once meets nothing and is left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes()
        for batch in batches:
            for i in range(0, batch.num_rows, SETS_AT_ONCE):
                b = batch.slice(i, SETS_AT_ONCE)
                number = np.asarray(b.column("n"))
                hashes, sz = _lists(b.column("h"))
                hashes = hashes.view(np.uint64)
                doc = np.repeat(np.arange(len(sz)), sz)
                order = (doc.astype(np.uint64) << np.uint64(NAME_BITS + 6)) | (table[hashes & MASK].astype(np.uint64) << np.uint64(NAME_BITS))
                order |= hashes >> np.uint64(64 - NAME_BITS)
                order.sort()
                name, cls = order & NAMES, ((order >> np.uint64(NAME_BITS)) & np.uint64(CLASSES - 1)).astype(np.int64)
                sketch = _sketches(doc, name, sketch_level(sz))
                pos = _within(sz) + 1
                kept = np.flatnonzero((pos <= sz[doc] // 2 + 1) & (cls > 0))
                doc, name, pos = doc[kept], name[kept], pos[kept]
                parts = np.ceil(np.exp2(cls[kept] / STEPS) / posting_rows).astype(np.int64)
                home = (((number[doc].astype(np.uint64) * _MIX) >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)
                part = _within(parts)
                doc, name, pos, home = (np.repeat(x, parts) for x in (doc, name, pos, home))
                key = ((name * _MIX + part.astype(np.uint64) * _MIX_PART) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                pos = np.where(part == home, pos, -pos).astype(np.int32)
                counts = np.bincount(doc, minlength=len(sz))
                yield pa.RecordBatch.from_arrays(
                    [b.column("n"), pa.array(sz.astype(np.int32)), sketch, _list_array(key, counts), _list_array(pos, counts)],
                    names=["n", "sz", "sketch", "keys", "pos"])
    return run


def deal_entries(parts: int, rounds: int, turn: int, labels: list[int]) -> Callable:
    """SIGNED -> DEALT: of each set, a row for each part of this turn that one of its keys belongs to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = np.asarray(labels, np.int32)
        for batch in batches:
            for i in range(0, batch.num_rows, SETS_AT_ONCE):
                b = batch.slice(i, SETS_AT_ONCE)
                keys, counts = _lists(b.column("keys"))
                pos = _lists(b.column("pos"))[0]
                part = keys.view(np.uint32).astype(np.int64) % parts
                at = np.repeat(np.arange(len(counts)), counts) * parts + part
                mine = np.flatnonzero(part % rounds == turn)
                mine = mine[np.argsort(at[mine], kind="stable")]
                rows, counts = np.unique(at[mine], return_counts=True)
                doc = pa.array(rows // parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[rows % parts]), *(b.column(c).take(doc) for c in ("n", "sz", "sketch")),
                     _list_array(keys[mine], counts), _list_array(pos[mine], counts)],
                    names=["deal", "n", "sz", "sketch", "keys", "pos"])
    return run


def _words(sketches: pa.Array, rows: np.ndarray, level: int) -> np.ndarray:
    """Sketches of these rows, all of one level, a line for each 64 bits."""
    each = 1 << (level - LEAST_BITS)
    data = np.frombuffer(sketches.take(pa.array(rows)).buffers()[2], np.uint64, len(rows) * each)
    return np.ascontiguousarray(data.reshape(len(rows), each).T)


def meet_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DEALT rows of whole keys -> MET: pairs of sets that share a key in reach and whose sketches allow 0.6, and what they can score."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    number = np.concatenate([np.asarray(b.column("n")) for b in batches])
    sz = np.concatenate([np.asarray(b.column("sz")) for b in batches]).astype(np.int64)
    sketches = pa.concat_arrays([b.column("sketch") for b in batches])
    lists = [(*_lists(b.column("keys")), _lists(b.column("pos"))[0]) for b in batches]
    keys, counts, pos = (np.concatenate(x) for x in zip(*lists, strict=True))
    del batches, lists
    by_size = np.lexsort((number, sz))  # sets are named by their place in the order of sizes from here on
    rank = np.empty(len(sz), np.int64)
    rank[by_size] = np.arange(len(sz))
    number, sz = number[by_size], sz[by_size]
    entry = (keys.view(np.uint32).astype(np.uint64) << np.uint64(32)) | np.repeat(rank, counts).astype(np.uint64)
    order = np.argsort(entry)
    entry, pos = entry[order], pos[order]
    del keys, order, rank
    place = (entry & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    level = sketch_level(sz)
    for at in np.unique(level):
        first, mid, last = np.searchsorted(level, [at, at + 1, at + 2])
        words = _words(sketches, by_size[first:mid], at)
        if last > mid:  # half the bits of the next level are the parities at this one
            wide = _words(sketches, by_size[mid:last], at + 1)
            words = np.concatenate([words, wide[:len(words)] ^ wide[len(words):]], axis=1)
            del wide
        near = np.flatnonzero((place >= first) & (place < last))
        yield from _meet_level(entry[near], place[near].astype(np.int64), pos[near], sz, number, words, int(first), int(mid))


def _differing(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the sketches at ``a`` and ``b``."""
    out = np.zeros(len(a), np.int32)
    for w in words:
        out += np.bitwise_count(w[a] ^ w[b])
    return out


def most_score(small: np.ndarray, large: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Highest token score of sets of these sizes whose sketches differ in so many bits, by the score's own arithmetic."""
    shared = np.minimum(small, (small + large - differing) // 2)
    return shared / (small + large - shared) + np.where(shared == small, 0.1, 0.0)


def _meet_level(entry: np.ndarray, place: np.ndarray, pos: np.ndarray, sz: np.ndarray, number: np.ndarray,
                words: np.ndarray, first: int, mid: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose smaller set is of the level that ``words`` begin with, at place ``first``."""
    size = sz[place]
    asks = np.flatnonzero((place < mid) & (pos > 0) & (pos <= size + (-3 * size) // 4 + 1))
    # a set of at most 5/3 the size shares 3/8 of both sizes; up to twice the size holds the small one whole, its rarest token too
    most = np.where(pos[asks] == 1, 2 * size[asks], size[asks] * 5 // 3)
    bound = (entry[asks] & ~np.uint64(0xFFFFFFFF)) | np.searchsorted(sz, most, side="right").astype(np.uint64)
    ends = np.searchsorted(entry, bound)
    partners = np.maximum(0, ends - asks - 1)
    asks, partners = asks[partners > 0], partners[partners > 0]
    pos = np.abs(pos).astype(np.int32)
    size, place = size.astype(np.int32), (place - first).astype(np.int32)
    upto = np.cumsum(partners)
    i, done, found = 0, 0, np.empty(0, np.int64)
    while i < len(asks):
        # an entry with more partners than fit is continued
        stop = min(int(upto[-1]), done + PAIRS_AT_ONCE)
        j = int(np.searchsorted(upto, stop, side="left")) + 1
        begins = np.maximum(upto[i:j] - partners[i:j], done)
        taken = np.minimum(upto[i:j], stop) - begins
        a = np.repeat(asks[i:j], taken)
        b = np.repeat(asks[i:j] + 1 + begins - (upto[i:j] - partners[i:j]), taken) + _within(taken)
        done = stop
        i = j if upto[j - 1] == stop else j - 1
        sa, sb = size[a], size[b]
        need = np.where(sb * 3 > sa * 5, sa, (3 * (sa + sb) + 7) // 8)
        near = np.flatnonzero((pos[a] <= sa - need + 1) & (pos[b] <= sb - need + 1))
        unlike = (sa + sb)[near] - 2 * need[near]
        a, b = place[a[near]], place[b[near]]
        like = np.flatnonzero(_differing(words, a, b) <= unlike)
        found = np.concatenate([found, np.unique(a[like].astype(np.int64) * words.shape[1] + b[like])])
        if len(found) > 1 << 22:
            found = np.unique(found)
        if len(found) > 1 << 21 or i >= len(asks):
            # pairs that meet in several keys come once as far as they are held together
            found = np.unique(found)
            for k in range(0, len(found), 1 << 16):
                a, b = np.divmod(found[k:k + (1 << 16)], words.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[a + first]), pa.array(number[b + first]), pa.array(most_score(sz[a + first], sz[b + first], _differing(words, a, b)))],
                    names=["a", "b", "at_most"])
            found = np.empty(0, np.int64)
