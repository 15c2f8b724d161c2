"""The classifier's parts against their definitions, and its independence of the partitioning."""

import random

import numpy as np
import pyarrow as pa

from labelset.llm import quality_classifier as qc


def labelled(spark, n=160, parts=3):
    rng = random.Random(9)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(n):
        y = i % 2
        pool = (good if y else bad) + [f"w{j}" for j in range(30)]
        rows.append((i, None if i % 37 == 5 else " ".join(rng.choice(pool) for _ in range(rng.randint(1, 60)))))
        labels.append((i, y if rng.random() < 0.95 else 1 - y))
    rows += rows[:4]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int").repartition(parts), rows, dict(labels)


def test_same_scores_for_every_partitioning(shipped):
    got = []
    for parts in (1, 3, 7):
        docs, labels, _, _ = labelled(shipped, parts=parts)
        got.append(sorted(map(tuple, qc.classify(docs, labels).collect())))
    assert got[0] == got[1] == got[2] and len({r[2] for r in got[0]}) > 50


def test_feature_counts_by_definition(shipped):
    docs, labels, rows, y = labelled(shipped)
    joined = docs.join(labels, "doc_id").withColumnRenamed("quality", "y")
    got = {r["f"]: (r["n0"], r["n1"]) for r in qc.feature_counts(joined).collect()}
    want = {}
    for doc_id, text in rows:
        f, _ = qc.indicators(pa.array([text or ""]))
        for x in [*f.tolist(), qc.FEATURES]:
            n = want.setdefault(x, [0, 0])
            n[y[doc_id]] += 1
    assert got == {f: tuple(n) for f, n in want.items()}


def test_word_grams_are_indicators():
    def of(text):
        return set(qc.indicators(pa.array([text]))[0].tolist())

    assert of("one two three") != of("three two one")  # same words, shapes aside
    assert of("aa bb cc dd") >= of("bb cc dd") & of("aa bb cc") and len(of("aa bb cc dd") - of("aa bb cc")) >= 3


def test_descent_reaches_the_optimum():
    """Duality gap of the weighted hinge loss on small random sets."""
    rng = np.random.default_rng(1)
    for _ in range(5):
        n, d = 40, 12
        y = (rng.random(n) < 0.4).astype(int)
        y[:2] = 0, 1
        ratio = rng.normal(size=d)
        sets = [np.flatnonzero(rng.random(d) < 0.4) for _ in range(n)]
        w, b = qc.descend(sets, y, ratio, cost=0.5, epochs=4000)
        sign = np.where(y > 0, 1.0, -1.0)
        upper = 0.5 * n / (2 * np.where(y > 0, (y > 0).sum(), (y == 0).sum()))
        x = np.zeros((n, d + 1))
        for i, s in enumerate(sets):
            x[i, s] = ratio[s]
        x[:, d] = 1
        v = np.r_[w, b]
        primal = v @ v / 2 + (upper * np.maximum(0, 1 - sign * (x @ v))).sum()
        # any other weights are no better
        for _ in range(300):
            u = v + rng.normal(size=d + 1) * 10.0 ** -rng.integers(0, 5)
            assert u @ u / 2 + (upper * np.maximum(0, 1 - sign * (x @ u))).sum() >= primal - 1e-3
