"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens are the words of the text with A-Z in lower case and one end token a text. The model is
P(token | history) = P(class | history) * P(token | class). The first factor is a softmax over
CLASSES classes with hashed n-gram features (last word, last two words, classes of the last
three) and a skip feature (word before the last). The most frequent tokens are classes of their
own, the others fall in classes by their last two bytes. The second factor reads the same history:
a class is split ``depth`` times in WAYS by the bits of the tokens' hashes, each split is a softmax
with hashed (n-gram or skip feature, node) weights that starts from the exact counts of its parts,
and a leaf is shared by the smoothed counts of its tokens, with one place for unknown tokens. So the
model is a proper distribution over the training vocabulary and "unknown". Depth and buckets grow
with the exact numbers of distinct training tokens: a leaf for each token of the largest class, up
to the bounds below.

Training reads every training text in each of ``rounds`` + 1 synchronous rounds. A round sums, over
all texts and at weights that every task shares, the counts of the features that are observed (first
round: at the start the head expects its prior everywhere, so no softmax is needed) or that the model
expects (later rounds); their difference is the gradient, and each weight moves by the log of their
ratio with pseudo-counts. Sums do not depend on how the texts lie in files or partitions, but for
rounding (sums travel in 16 bits under each row's greatest value). One task a core sums its share,
touched rows only, and rows meet by block. Scoring runs in sparse numpy batches. Token counts are
exact counts over all training texts; the HEAD most frequent tokens (a bounded table) are broadcast,
the rest of the tokens meet their counts in a hash join of per-text counts.

Defined results: null text is empty (its end token alone); repeated rows are scored each; a null
id counts as held out; without training texts every factor is uniform; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelset.llm.landing import land
from labelset.llm.textcore import U, Words, mix, text_chunks

CLASSES, SINGLES, TEMPLATES = 64, 24, 4
#: Bounds of log2 of the buckets a template and of the splits of a class; log2 of the parts of a split and of the weight rows of all splits.
BUCKET_BITS, DEPTHS, WAY_BITS, INNER_BITS = (13, 15), (0, 3), 4, 17
WAYS, INNER = 1 << WAY_BITS, 3  # the splits read the first INNER templates
HEAD = 500_000
ALPHA = 0.1
BATCH, SLAB, OFTEN = 4096, 1 << 18, 24
#: Rate and pseudo-counts of the first and the later steps; bound of a weight.
FIRST, NEXT, LARGEST = (0.5, 5.0), (0.2, 50.0), 9.0
FLUSH = 200_000
VALUES = 4096  # weights in one block row
ODD, ODDER = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def suffix_class(w: Words) -> np.ndarray:
    """Class by the last two bytes of each word, from SINGLES on."""
    last = w.data[w.end - 1].astype(np.int64)
    before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    return SINGLES + (last * 257 + before * 31) % 8191 % (CLASSES - SINGLES)


def tokens(texts: pa.Array, singles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(hash, class, row) of the tokens in order and the words behind them; the end token has hash 0 and class 0.

    ``singles``: sorted word hashes with classes of their own, class k + 1 for the k-th.
    """
    w = Words(pc.ascii_lower(texts))
    cls = suffix_class(w)
    if len(singles):
        at = np.minimum(np.searchsorted(singles, w.hash), len(singles) - 1)
        cls = np.where(singles[at] == w.hash, at + 1, cls)
    ends = w.first[1:]
    return np.insert(w.hash, ends, U(0)), np.insert(cls, ends, 0), np.insert(w.doc, ends, np.arange(len(texts))), w


def features(h: np.ndarray, cls: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashed history features, TEMPLATES for each token."""
    def back(x: np.ndarray, k: int) -> np.ndarray:
        y = np.full(len(x), 7, dtype=np.uint64)
        y[k:][row[k:] == row[:-k]] = x[:-k][row[k:] == row[:-k]]
        return y

    c = cls.astype(np.uint64)
    one, two = back(h, 1), back(h, 2)
    shape = (back(c, 1) * U(97) + back(c, 2)) * U(97) + back(c, 3)
    keys = (mix(one), mix(one * U(0x9E3779B97F4A7C15) + two), mix(two + U(1)), mix(shape + U(2)))
    return np.stack([mix(k + U(i)) for i, k in enumerate(keys)])


def leaf_bits(h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf of each token within its class."""
    return (mix(h ^ ODD) >> U(40)).astype(np.int64) & (WAYS**depth - 1)


class Shape:
    """Sizes of the model from the distinct training tokens in all and in the largest class, the class prior and the exact counts of the leaves."""

    def __init__(self, n_distinct: int, largest: int):
        bits, depth = (int(np.ceil(np.log2(max(x, 1)))) for x in (n_distinct, largest))
        self.buckets = 1 << int(np.clip(bits, *BUCKET_BITS))
        self.depth = int(np.clip(-(-depth // WAY_BITS), *DEPTHS))

    def fit(self, prior: np.ndarray, leaves: np.ndarray) -> Shape:
        """``leaves``: token counts (CLASSES, WAYS ** depth)."""
        self.prior, self.offsets = prior, []  # of each split's parts, by (class, node)
        for level in range(self.depth):
            parts = leaves.reshape(CLASSES * WAYS**level, WAYS, -1).sum(axis=2) + 0.5
            self.offsets.append(np.log(parts / parts.sum(axis=1, keepdims=True)).astype(np.float32))
        return self

    @property
    def size(self) -> int:
        return TEMPLATES * self.buckets * CLASSES + CLASSES + (WAYS << INNER_BITS)

    def zeros(self, columns: bool = False) -> list[np.ndarray]:
        """Sums for the head (the bias last) and the inner rows; ``columns``: the latter lie as columns."""
        inner = (WAYS, 1 << INNER_BITS) if columns else (1 << INNER_BITS, WAYS)
        return [np.zeros(n, dtype=np.float32) for n in ((TEMPLATES * self.buckets + 1, CLASSES), inner)]

    def start(self) -> np.ndarray:
        flat = np.zeros(self.size, dtype=np.float32)
        a = TEMPLATES * self.buckets * CLASSES
        flat[a:a + CLASSES] = np.log(self.prior)
        return flat


def logits(base: np.ndarray, table: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = base + table.take(f[0], axis=0)
    for k in f[1:]:
        z += table.take(k, axis=0)
    return z


def softmax(z: np.ndarray) -> np.ndarray:
    """In place; weights are within LARGEST, so sums stay in the range of 32 bits."""
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], dtype=z.dtype))[:, None]
    return z


def log_share(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    """log10 of the softmax at column ``k`` of each row."""
    own = z[np.arange(len(k)), k]
    np.exp(z, out=z)
    return (own - np.log(z @ np.ones(z.shape[1], dtype=z.dtype))) / np.log(10)


def add_rows(total: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
    """``total[rows] += x`` with the rows that occur repeatedly summed."""
    order = np.argsort((rows & 0xFFFF).astype(np.uint16), kind="stable")  # 16 bits at a time: a radix sort
    order = order[np.argsort((rows >> 16).astype(np.uint16)[order], kind="stable")]
    sorted_ = rows[order]
    first = np.flatnonzero(np.diff(sorted_, prepend=-1))
    n = np.diff(first, append=len(rows))
    for a, m in zip(first[n > OFTEN], n[n > OFTEN], strict=True):
        total[sorted_[a]] += np.ones(m, dtype=x.dtype) @ x.take(order[a:a + m], axis=0)
    few = np.flatnonzero(n <= OFTEN)
    few = few[np.argsort(OFTEN - n[few].astype(np.uint16), kind="stable")]  # by falling number
    first, n = first[few], n[few]
    if len(few):
        part = x.take(order[first], axis=0)
        for j in range(1, int(n[0])):
            m = int(np.searchsorted(-n, -j, side="left"))  # those with more than j
            part[:m] += x.take(order[first[:m] + j], axis=0)
        total[sorted_[first]] += part


def add_columns(total: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
    """``total[:, k] += x[i]`` for each k of ``rows[:, i]``; ``total`` holds narrow rows as columns."""
    many = rows.ravel()
    for own, w in zip(total, np.ascontiguousarray(x.T, dtype=np.float64), strict=True):
        own += np.bincount(many, np.tile(w, len(rows)), total.shape[1])


class Model:
    """Weights: head (TEMPLATES * buckets rows of CLASSES, then the bias) and the rows of the splits (inner)."""

    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, a = shape, TEMPLATES * shape.buckets * CLASSES + CLASSES
        self.head, self.inner = flat[:a].reshape(-1, CLASSES), flat[a:].reshape(-1, WAYS)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        return (keys % U(self.shape.buckets)).astype(np.int64) + self.shape.buckets * np.arange(TEMPLATES)[:, None]

    def splits(self, keys: np.ndarray, cls: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per split (rows of the inner table, offsets of the parts, part of the token)."""
        for level, offset in enumerate(self.shape.offsets):
            rest = WAY_BITS * (self.shape.depth - level)
            node = cls << WAY_BITS * level | leaf >> rest
            f = ((keys[:INNER] ^ (node * 4 + level + 1).astype(np.uint64) * ODD) * ODDER >> U(64 - INNER_BITS)).view(np.int64)
            yield f, offset[node], leaf >> rest - WAY_BITS & WAYS - 1

    def scores(self, keys: np.ndarray, cls: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """log10 P(class and leaf | history) of the tokens."""
        f, out = self.rows(keys), np.empty(len(cls))
        for a in range(0, len(cls), BATCH):
            y = cls[a:a + BATCH]
            out[a:a + BATCH] = log_share(logits(self.head[-1], self.head, f[:, a:a + BATCH]), y)
            many = np.flatnonzero(y >= SINGLES) + a
            for rows, offset, way in self.splits(keys[:, many], cls[many], leaf[many]):
                out[many] += log_share(logits(offset, self.inner, rows), way)
        return out

    def observe(self, sums: list[np.ndarray], keys: np.ndarray, cls: np.ndarray, leaf: np.ndarray) -> None:
        """Adds the observed counts of the features to ``sums`` (head, inner by columns)."""
        head, inner = sums
        np.add.at(head.reshape(-1), (self.rows(keys) * CLASSES + cls).ravel(), np.float32(1))
        head[-1] += np.bincount(cls, minlength=CLASSES)
        many = np.flatnonzero(cls >= SINGLES)
        for rows, _, way in self.splits(keys[:, many], cls[many], leaf[many]):
            np.add.at(inner.reshape(-1), (way * inner.shape[1] + rows).ravel(), np.float32(1))

    def expect(self, sums: list[np.ndarray], keys: np.ndarray, cls: np.ndarray, leaf: np.ndarray) -> None:
        """Adds the counts that the model expects of the features to ``sums`` (head, inner by columns)."""
        head, inner = sums
        f = self.rows(keys)
        for a in range(0, len(cls), SLAB):
            part = f[:, a:a + SLAB]
            p = np.empty((part.shape[1], CLASSES), dtype=np.float32)
            for b in range(0, len(p), BATCH):
                p[b:b + BATCH] = softmax(logits(self.head[-1], self.head, part[:, b:b + BATCH]))
            for k in part:
                add_rows(head, k, p)
            head[-1] += np.ones(len(p), dtype=p.dtype) @ p
            many = np.flatnonzero(cls[a:a + SLAB] >= SINGLES) + a
            for rows, offset, _ in self.splits(keys[:, many], cls[many], leaf[many]):
                add_columns(inner, rows, softmax(logits(offset, self.inner, rows)))


def token_counts(texts: DataFrame) -> DataFrame:
    """``word`` (empty: the end token), ``h``, ``cls`` (by suffix) and ``c`` over all ``texts`` (text)."""
    schema = pa.schema([("word", pa.string()), ("h", pa.int64()), ("cls", pa.int32()), ("c", pa.int64())])

    def rows(count: Counter) -> pa.RecordBatch:
        words = pa.array(list(count), pa.binary()).cast(pa.string())
        h, cls, row, _ = tokens(words, np.zeros(0, dtype=np.uint64))
        first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([words, pa.array(h[first].view(np.int64)), pa.array(cls[first].astype(np.int32)), pa.array(list(count.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for part in text_chunks(batch):
                for data in part.column("text").cast(pa.binary()).to_pylist():
                    count.update(data.lower().split())
                count[b""] += part.num_rows
                if len(count) > FLUSH:
                    yield rows(count)
                    count = Counter()
        yield rows(count)

    return texts.mapInArrow(run, "word string, h long, cls int, c long").groupBy("word", "h", "cls").agg(F.sum("c").alias("c"))


PIECES = "block int, rows binary, top binary, x binary"


def pieces(tables: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of the tables that are not 0, in blocks of VALUES: each its greatest size and, in 16 bits, its shares of that."""
    block = 0
    for t in tables:
        top, step = np.maximum(t.max(axis=1), -t.min(axis=1)), VALUES // t.shape[1]
        for a in range(0, len(t), step):
            if len(at := np.flatnonzero(top[a:a + step])):
                size = top[a:a + step][at].astype("<f4")
                x = (t[a:a + step][at] / size[:, None]).astype("<f2")
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (at.astype("<u2"), size, x))], names=["block", "rows", "top", "x"])
            block += 1


def add_piece(tables: list[np.ndarray], block: int, rows: bytes, top: bytes, x: bytes) -> None:
    for t in tables:
        step = VALUES // t.shape[1]
        n = -(-len(t) // step)
        if block < n:
            at = np.frombuffer(rows, dtype="<u2").astype(np.int64) + block * step
            t[at] += np.frombuffer(x, dtype="<f2").astype(np.float32).reshape(-1, t.shape[1]) * np.frombuffer(top, dtype="<f4")[:, None]
            return
        block -= n


def summed(texts: DataFrame, singles: np.ndarray, form: Shape, flat: np.ndarray, sum_of: str) -> list[np.ndarray]:
    """Sums over all ``texts`` (text) of ``Model.observe`` or ``Model.expect`` (``sum_of``) at the weights ``flat``.

    One task a core sums its texts; the tasks' touched rows meet by block, so what is sent is bounded by cores times model.
    """
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast((flat, singles, form))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, single, form = shared.value
        model, sums = Model(form, flat), None
        for batch in batches:
            for part in text_chunks(batch):
                sums = sums or form.zeros(columns=True)
                h, cls, row, _ = tokens(part.column("text"), single)
                getattr(model, sum_of)(sums, features(h, cls, row), cls, leaf_bits(h, form.depth))
        if sums:
            yield from pieces([sums[0], np.ascontiguousarray(sums[1].T)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                n = len(r["x"]) // 2 // (len(r["rows"]) // 2)
                own = total.setdefault(r["block"], np.zeros((VALUES // n, n), dtype=np.float32))
                add_piece([own], 0, r["rows"], r["top"], r["x"])
        for k, t in total.items():
            for p in pieces([t]):
                yield p.set_column(0, "block", pa.array([k], pa.int32()))

    blocks = land(texts.coalesce(max(1, sc.defaultParallelism)).mapInArrow(run, PIECES).repartition(64, "block").mapInArrow(meet, PIECES))
    shared.destroy()  # the driver's copy too; the sums have landed
    out = form.zeros()
    for r in blocks.toLocalIterator():  # at most the model's size, bounded whatever the corpus; a few blocks at a time
        add_piece(out, r["block"], r["rows"], r["top"], r["x"])
    return out


def step(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray | None, floor: np.ndarray, rate_kappa: tuple[float, float]) -> None:
    """A scaled gradient step: each weight moves by the log of observed over expected, both with kappa pseudo-counts spread by ``floor``.

    ``expected`` None: what the floor expects of the observed rows. Rows go BATCH at a time, so no copy of the model is made.
    """
    rate, kappa = np.float32(rate_kappa[0]), np.float32(rate_kappa[1])
    for a in range(0, len(weights), BATCH):
        w, o = weights[a:a + BATCH], observed[a:a + BATCH]
        e = o.sum(axis=1, keepdims=True) * floor if expected is None else expected[a:a + BATCH]
        w += rate * np.log((o + kappa * floor) / (np.maximum(e, 0) + kappa * floor))
        np.clip(w, -LARGEST, LARGEST, out=w)


class Trainer:
    """Weights from the observed counts and then from the expected counts of each round."""

    def __init__(self, form: Shape):
        self.form, self.flat, self.rounds = form, form.start(), 0
        self.prior, self.even = form.prior.astype(np.float32), np.float32(1 / WAYS)

    def begin(self, observed: list[np.ndarray]) -> None:
        """First step of the head: at the start the model expects the prior in every context."""
        self.head, self.inner = observed
        model = Model(self.form, self.flat)
        step(model.head[:-1], self.head[:-1], None, self.prior, FIRST)

    def advance(self, expected: list[np.ndarray]) -> None:
        """Next step of the head, first or next step of the splits."""
        model = Model(self.form, self.flat)
        bias = model.head[-1] + np.float32(NEXT[0]) * np.log((self.head[-1] + 1) / (expected[0][-1] + 1))
        step(model.head, self.head, expected[0], self.prior, NEXT)
        model.head[-1] = np.maximum(bias, -4 * LARGEST)
        step(model.inner, self.inner, expected[1], self.even, NEXT if self.rounds else FIRST)
        self.rounds += 1


def train(texts: DataFrame, singles: np.ndarray, form: Shape, rounds: int) -> np.ndarray:
    """Weights (flat): a step from the counts observed in all ``texts`` (text), then ``rounds`` synchronous steps over all of them."""
    trainer = Trainer(form)
    trainer.begin(summed(texts, singles, form, trainer.flat, "observe"))
    for _ in range(rounds):
        trainer.advance(summed(texts, singles, form, trainer.flat, "expect"))
    return trainer.flat


def score(docs: DataFrame, held_out_of: int = 10, rounds: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % held_out_of == 0, F.lit(True))
    all_ = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    training = all_.where("NOT held_out").select("text")
    counts = land(token_counts(training))
    n_tokens, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the head: every token with a count from which on there are at most HEAD tokens, and the end token
    levels = counts.groupBy("c").agg(F.count("*").alias("k")).orderBy(F.desc("c")).limit(HEAD).collect()
    least, room = n_tokens + 1, HEAD
    for r in levels:
        room -= r["k"]
        if room < 0:
            break
        least = r["c"]
    head = counts.where((F.col("c") >= least) | (F.col("word") == "")).select("h", "c", "cls").toArrow()
    head_h, head_c, head_cls = (head.column(k).to_numpy().astype(t) for k, t in (("h", np.uint64), ("c", np.int64), ("cls", np.int64)))
    order = np.argsort(head_h)
    head_h, head_c, head_cls = head_h[order], head_c[order], head_cls[order]
    top = sorted((c, h) for h, c in zip(*(x[np.lexsort((head_h, head_c))[-SINGLES:]].tolist() for x in (head_h, head_c)), strict=True) if h)[-(SINGLES - 1):]
    singles = np.array(sorted(h for _, h in top), dtype=np.uint64)
    stats = {r["cls"]: [r["n"], r["v"]] for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n_cls, v_cls = (np.array([stats.get(k, (0, 0))[i] for k in range(CLASSES)], dtype=np.float64) for i in (0, 1))
    single_of = {int(h): k + 1 for k, h in enumerate(singles)}
    for h, own in single_of.items():
        k = int(np.searchsorted(head_h, U(h)))
        n_cls[head_cls[k]] -= head_c[k]
        v_cls[head_cls[k]] -= 1
        n_cls[own], v_cls[own], head_cls[k] = head_c[k], 1, own
    prior = (n_cls + 1) / (n_cls + 1).sum()
    form = Shape(n_distinct, int(v_cls[SINGLES:].max()))
    # (class, leaf) of every token but the singles, at most CLASSES * WAYS ** depth rows
    leaves, kinds = np.zeros((2, CLASSES, WAYS**form.depth))

    def by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(leaf_bits(h, form.depth)), b.column("c"), pa.array(np.isin(h, singles) | (h == 0))], names=["cls", "leaf", "c", "own"])

    for r in counts.select("h", "cls", "c").mapInArrow(by_leaf, "cls int, leaf long, c long, own boolean").where("NOT own").groupBy("cls", "leaf").agg(
            F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        leaves[r["cls"], r["leaf"]], kinds[r["cls"], r["leaf"]] = r["n"], r["v"]
    weights = train(training, singles, form.fit(prior, leaves), rounds)
    base_of = np.log10(n_tokens + ALPHA * (n_distinct + 1))
    # a class of one token has no unknown tokens; the leaves of the others keep one place for them each
    leaf_of = np.log10(leaves + ALPHA * (kinds + 1))
    shared = spark.sparkContext.broadcast((weights, singles, head_h, head_c, form, leaf_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, single, hh, hc, form, leaf_of = shared.value
        model = Model(form, flat)
        for batch in batches:
            for part in text_chunks(batch):
                h, cls, row, w = tokens(part.column("text"), single)
                leaf = leaf_bits(h, form.depth)
                at = np.minimum(np.searchsorted(hh, h), max(len(hh) - 1, 0))
                known = hh[at] == h if len(hh) else np.zeros(len(h), bool)
                c = np.where(known, hc[at] if len(hh) else 0, 0)
                lone = cls < SINGLES
                base = np.where(known, np.log10(c + ALPHA) - base_of, 0.0)
                inner = np.where(known & ~lone, np.log10(c + ALPHA) - leaf_of[cls, leaf], 0.0)
                own = model.scores(features(h, cls, row), cls, leaf) + inner
                total = lambda x: np.bincount(row, x, minlength=part.num_rows)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), part.column("held_out"), pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()),
                                                  pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(total(known).astype(np.int64)), pa.array(total(base)), pa.array(total(own))], schema=schema)
                # the other tokens go on to the join, once per text and token
                ends = np.zeros(len(h), bool)
                ends[w.first[1:] + np.arange(n)] = True
                rest = ~known[~ends]
                _, kind = np.unique(w.hash[rest], return_inverse=True)
                _, first, back = np.unique(w.doc[rest] * (len(kind) + 1) + kind, return_index=True, return_inverse=True)
                m = len(first)
                if m:
                    word = np.flatnonzero(rest)[first]
                    text_ = [w.data[a:b].tobytes() for a, b in zip(w.start[word], w.end[word], strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("rid").take(pa.array(w.doc[word])), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.array(text_, pa.binary()).cast(pa.string()),
                                                      pa.array(leaf_of[cls[~ends][word], leaf[~ends][word]]), pa.array(np.bincount(back, minlength=m).astype(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], schema=schema)

    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.string()), ("share", pa.float64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("own", pa.float64())])
    out = land(all_.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
        run, "rid long, doc_id long, held_out boolean, word string, share double, n long, known long, base double, own double"))
    met = out.where("word IS NOT NULL").select("rid", "word", "share", "n").join(counts.select("word", "c"), "word", "left")
    c = F.log10(F.coalesce("c", F.lit(0)) + ALPHA)
    tail = met.groupBy("rid").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("t_known"),
                                  F.sum(F.col("n") * (c - float(base_of))).alias("t_base"), F.sum(F.col("n") * (c - F.col("share"))).alias("t_own"))
    zero = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return out.where("word IS NULL").join(tail, "rid", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), zero("known", "t_known").cast("long").alias("n_known"),
        F.lit(int(n_tokens)).cast("long").alias("train_tokens"), zero("base", "t_base").alias("base_score"), zero("own", "t_own").alias("score"))
