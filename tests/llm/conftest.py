import random

import pytest


@pytest.fixture(scope="session")
def shipped(spark):
    from labelset.session import ship_package

    ship_package(spark)
    return spark


def corpus(seed: int = 4, n: int = 220) -> list[tuple]:
    """(doc_id, text) rows with nulls, empty and long texts, copies, near copies, repeated passages, lines and rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(150)] + ["été", "Ünder", "the", "of", "###", "a|b", "!!"]
    draw = lambda k: [rng.choice(vocab) for _ in range(k)]
    passages = [draw(rng.randint(18, 60)) for _ in range(8)]
    lines = [draw(rng.randint(1, 16)) for _ in range(25)]
    rows: list[tuple] = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.04:
            text = None
        elif kind < 0.08:
            text = rng.choice(["", " ", "\n\n", "one", "\t two  words \n"])
        elif kind < 0.3 and rows:
            words = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        else:
            parts = []
            for _ in range(rng.randint(1, 6)):
                what = rng.random()
                words = list(rng.choice(passages) if what < 0.25 else rng.choice(lines) if what < 0.6 else draw(rng.randint(1, 40)))
                if rng.random() < 0.3:
                    words[rng.randrange(len(words))] = "edited"
                parts.append(rng.choice([" ", " ", "  ", "\t"]).join(words))
            text = "\n".join(parts)
        rows.append((i * 3 % 1009 - 20, text))
    rows.append((2000, " ".join(draw(9000))))
    return [*rows, rows[5], rows[40]]


@pytest.fixture(scope="session")
def rows():
    return corpus()


EXTRA = ("_row", "_text", "_words", "_gone", "n_words", "host", "comp", "rank", "failures")


@pytest.fixture(scope="session")
def docs(shipped, rows):
    """The corpus with extra columns whose names clash with inner ones."""
    data = [(*r, *(None if k % 2 else k for k in range(len(EXTRA)))) for r in rows]
    return shipped.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in EXTRA)).repartition(4).cache()


@pytest.fixture(scope="session")
def no_docs(shipped):
    return shipped.createDataFrame([], "doc_id long, text string, n_chars long")
