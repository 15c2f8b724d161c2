"""Each operator against a brute-force version on a corpus with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelset.llm import (
    decontaminate, jaccard_join, language_model, line_dedup, packing, personal_data, quality_classifier,
    quality_rules, repeats, url_filter)
from labelset.llm.components import components
from labelset.llm.queries import vocabulary

BASE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return BASE.findall(text or "")


def by_id(rows):
    return {i: t for i, t in rows}


def test_repeats(docs, rows):
    seen, want = set(), {}
    for i, t in sorted(by_id(rows).items()):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            g = tuple(w[k:k + 20])
            if g in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(g)
        want[i] = (len(w), sum(gone), " ".join(x for x, c in zip(w, gone, strict=True) if not c))
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == want
    assert sum(v[1] for v in want.values()) > 1000


def test_repeats_in_runs_of_one_word(shipped):
    data = [(1, "a " * 70), (2, "b " * 25 + "a " * 30), (None, "a " * 40), (3, " ".join(f"w{k}" for k in range(30)) + " " + "a " * 19)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in repeats.remove_repeats(shipped.createDataFrame(data, "doc_id long, text string")).collect()}
    # a run repeats itself from its second word on; the row without an id comes first
    assert got == {None: (40, 0), 1: (70, 70), 2: (55, 54), 3: (49, 0)}


def test_quality_rules(docs, rows):
    got = quality_rules.ledger(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.text or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_lines, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(lines), len(lines) - len(set(lines)), len(hit))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert bool(r.failures & 1) == (len(w) < 50)


def test_quality_windows_keep_all_hash_bits(shipped):
    """Windows whose hashes differ in their low bits alone are not repeats."""
    d = shipped.createDataFrame([([(16, 3), (16, 9), (17, 1), (18, 2), (2**40, 0), (2**40, 8)],)], "win array<struct<h: long, at: long>>")
    assert d.select(quality_rules._repeated_positions(F.col("win")).alias("p")).first().p == [0, 3, 8, 9]


def test_policies_and_ablation(docs):
    led = quality_rules.ledger(docs)
    rows = led.select("failures").collect()
    mask = quality_rules.policy_mask("web-1")
    assert quality_rules.apply_policy(led, "web-1").count() == sum(not r.failures & mask for r in rows)
    for a in quality_rules.ablation(led, "web-1").collect():
        bit = quality_rules.BITS[a.rule]
        assert a.n_failed == sum(bool(r.failures & bit) for r in rows)
        assert a.n_only == sum(r.failures & mask == bit for r in rows)
        assert a.n_kept_without == sum(not r.failures & mask & ~bit for r in rows)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))


def test_line_dedup(docs, rows):
    want = {}
    # a removed line still removes later lines: lines are judged on the input
    everything = [(i, no, words(x)) for i, t in sorted(by_id(rows).items()) for no, x in enumerate((t or "").split("\n")) if words(x)]
    gone = defaultdict(set)
    for k, (i, no, w) in enumerate(everything):
        if any(u == w or (min(len(u), len(w)) >= line_dedup.MIN_WORDS and one_edit(u, w)) for _, _, u in everything[:k] if abs(len(u) - len(w)) < 2):
            gone[i].add(no)
    for i, t in by_id(rows).items():
        want[i] = t if not gone[i] else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[i])
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines_removed"]
    got = got.collect()
    assert len(got) == len(rows) and sum(map(len, gone.values())) > 50
    assert {r.doc_id: r.text for r in got} == want
    assert {r.doc_id: r.n_lines_removed for r in got} == {i: len(gone[i]) for i in want}


def test_line_dedup_word_order(shipped):
    """Lines with the same word pairs in another number or order are told apart before the earliest holder is chosen."""
    tail = "total of the first region today"
    data = [(1, f"| 5 | 5 | {tail}"), (2, f"| 7 | 7 | {tail}"), (3, f"| 7 | 7 | {tail} again"), (4, f"| 7 | 7 {tail}"),
            (11, "a b c a d e a f g h"), (12, "a d e a b c a f g h"), (13, "a d e a b c a f g h i")]
    want = {i: any(one_edit(words(u), words(t)) for j, u in data if j < i) for i, t in data}
    got = line_dedup.dedup_lines(shipped.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_lines_removed == 1 for r in got} == want
    assert [i for i in want if want[i]] == [3, 4, 13]


def shingles(t):
    w = words(t)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_join(docs, rows):
    sets = {i: shingles(t) for i, t in rows}
    ids, links, root = sorted(sets), Counter(), {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                links.update((i, j))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = jaccard_join.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (find(i), links[i]) for i in ids}
    assert len(links) > 20


def test_jaccard_blocks(shipped, monkeypatch):
    """A group of near copies larger than a block gives the same links as one block."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(60)]
    data = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        data.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in data]
    want = [sum(9 * len(a & b) >= 4 * (len(a) + len(b)) for b in sets) - 1 for a in sets]
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    got = {r.doc_id: r.n_links for r in jaccard_join.near_duplicates(shipped.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(90)] == want


def test_prefix_depth():
    assert jaccard_join.prefix_depth(0.8) == 6
    assert jaccard_join.prefix_depth(0.8, target=0.9999) < 6


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontaminate(shipped):
    rng = random.Random(2)
    draw = lambda k: "".join(rng.choice("abcde ") for _ in range(k))
    items = [(k, draw(rng.randint(10, 90))) for k in range(12)] + [(20, None), (21, ""), (22, "?!"), (23, "Same Item, twice over."), (24, "same item twice over")]
    docs = [(0, None), (1, ""), (2, "SAME item twice... over")]
    for i in range(3, 60):
        t = draw(rng.randint(0, 60))
        if rng.random() < 0.6:
            x = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, 7)):
                p = rng.randrange(len(x))
                x[p:p + 1] = rng.choice([[], ["z"], [x[p], "q"]])
            t += " " + "".join(x).upper() + draw(20)
        docs.append((i, t))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_items(
        shipped.createDataFrame(docs, "doc_id long, text string"), shipped.createDataFrame(items, "item_id long, text string"), block_bytes=400).collect()}
    want = {}
    for i, t in docs:
        for k, x in items:
            form = decontaminate.normal(x or "")
            if form and (d := brute_distance(form, decontaminate.normal(t or ""))) <= len(form) // decontaminate.EDIT_EVERY:
                want[i, k] = d
    assert got == want and {(2, 23), (2, 24)} <= set(got) and any(got.values())


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            cut = np.array(ids[at:at + 4096], dtype="<u4")
            want.append((i, k, at, len(cut), zlib.crc32(cut.tobytes())))
    got = packing.pack(docs, vocabulary()).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in got) // 4096) + 1


def test_token_bytes_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    texts = ["a\u0301 \u0301b  c\u00a0d\u2028e", "<|endoftext|> x<|startoftext|>y", "don't we'll 12.5 İSTANBUL ΣΑΣ", "\x1c\x85 tab\tnew\nline\x0b\x0c", "x" * 3000, "", "日本語 テキスト 한국어 e\u0301"]
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in packing.token_bytes([t.encode() for t in texts], vocabulary())]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


ODD = [*"abcdeFGHI'''''sstrvmld0123.,;|<>-#ÉßñéÿıİǅŁȺʼń \x1c\x85\t\n\x0bΣ日本한́𝔸ſK", "'s", "'re", "'ll", "<|endoftext|>", "<|", "</w>", " ", " ", "  "]


@pytest.mark.parametrize("kept, marked", [(400_000, True), (40, True), (400_000, False)])
def test_token_bytes_of_odd_texts(monkeypatch, kept, marked):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    monkeypatch.setattr(packing, "CACHE_PIECES", kept)
    monkeypatch.setattr(packing, "_encoders", {vocabulary(): packing._Encoder(vocabulary())})
    packing._encoders[vocabulary()].last &= marked
    got = [b for at in range(0, len(texts), 150) for b in packing.token_bytes([t.encode() for t in texts[at:at + 150]], vocabulary())]
    tok = Tokenizer.from_file(vocabulary())
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_tokenizer_gets_few_texts(monkeypatch):
    """Many pieces go into one text, and pieces met lately are not encoded again once the cache was full."""
    import tokenizers

    texts, real = [], tokenizers.Tokenizer.from_file(vocabulary())

    class Counted:
        def __getattr__(self, name):
            def call(batch, **kw):
                texts.append(len(batch))
                return getattr(real, name)(batch, **kw)
            return call if name.startswith("encode_batch") else getattr(real, name)

    class Tokenizer:
        from_file = staticmethod(lambda path: Counted())

    monkeypatch.setattr(tokenizers, "Tokenizer", Tokenizer)
    for name in ("CACHE_WORDS", "CACHE_PIECES"):
        monkeypatch.setattr(packing, name, 3000, raising=False)
    letters = lambda k: "".join(chr(97 + k // 26 ** i % 26) for i in range(4))
    early, late = (" ".join(letters(k) for k in r).encode() for r in (range(5000), range(9000, 11000)))
    # a name of its own keeps other tests' caches out
    path = f"{vocabulary()}#counted"
    list(packing.token_bytes([early], path))
    assert sum(texts) <= 5000 // 100
    first = list(packing.token_bytes([late], path))
    del texts[:]
    assert list(packing.token_bytes([late], path)) == first and not sum(texts)


@pytest.mark.parametrize("seed", range(5))
def test_fullest_bin(seed):
    rng = random.Random(seed)
    have = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(6)}
    used = packing.fullest(have, 60)
    items = [k for k, n in have.items() for _ in range(n)]
    items.remove(max(have))
    sums = {max(have)}
    for x in items:
        sums |= {s + x for s in sums if s + x <= 60}
    assert sum(k * n for k, n in used.items()) == max(sums)
    assert all(n <= have[k] for k, n in used.items())


def test_personal_data_base():
    plain = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        check = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0 if d else False
        return {0: True, 1: kind == 1 and all(int(x) <= 255 for x in s.split(".")), 2: 12 <= len(d) <= 19 and check, 3: 9 <= len(d) <= 15}[kind]

    rng = random.Random(3)
    parts = ["a", "b.", "@", "1", "23", "456", ".", "+", "-", " ", "_", "(", ")", "é", "10.0.0.1", "x@y.z", "4111 1111 1111 1111", "+49 30 12345678", "%"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = sorted((m.start(), k, m.end()) for k, p in plain.items() for m in re.finditer(p, t) if good(k, m[0]))
        assert personal_data.base_spans(t) == want
    assert personal_data.base_spans("a" * 200_000 + "@" * 1000 + "1" * 200_000) == []


def test_personal_data(shipped, docs, rows):
    data = [(1, "call +1 (555) 123-4567 today\nor 123-4567 later"), (2, "no 123-4567 here"), (3, None), (4, "é x@y.org and 4111111111111111, 77 4111111111111111")]
    data += [(k, f"reach +1 (555) 123-{k}") for k in range(1000, 1040)]
    got = {r.doc_id: r for r in personal_data.find_personal_data(shipped.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1].base == "phone:5:22" and got[1].spans == "phone:5:22,phone:32:40"
    assert (got[2].base, got[2].spans, got[3].spans) == ("", "", "")
    assert (got[4].base, got[4].spans) == ("email:2:9,card:14:30", "email:2:9,card:14:30,card:35:51")
    assert personal_data.find_personal_data(docs).count() == len(rows)


@pytest.mark.parametrize("n", [1, 40, 4000])
def test_personal_data_in_a_large_corpus(shipped, n):
    """A repeat of a base item stays a span however many tokens of its shape, alone or among numbers, are none."""
    one, cards = "call +4930123456 then 4930123456", "4111111111111111, 77 4111111111111111 88"
    data = [(1, one), (2, cards), (3, one + " 4930123456" * 60)]
    data += [(10 + k, f"no {5000000000 + k} here, {k % 90 + 10} {6000000000000000 + 2 * k} 88 {5200000000 + k}") for k in range(n)]
    got = {r.doc_id: r.spans for r in personal_data.find_personal_data(shipped.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got[1] == "phone:5:16,phone:22:32" and got[2] == "card:0:16,card:21:37"
    assert got[3].count("phone") == 62


def test_personal_data_spaced(shipped):
    """Repeats of spaced items, in part or with a trunk prefix, become one span each."""
    phone, card = "+49 30 1234 5678", "4111 1111 1111 1111"
    cases = [(f"{phone}, then 49 30 1234 5678.", "49 30 1234 5678"), (f"{phone}, then 030 1234 5678 and 5678", "030 1234 5678"),
             (f"{card}; 77 {card}", card), (f"{card}; 77 {card} 12", card), ("+1 (017) 555-7713 or (017) 555-7713", "(017) 555-7713"),
             ("+1 (017) 555-7713 or 917.555.7713 x", "555.7713"), (f"{phone}, then 0049-30-12345678", "0049-30-12345678"),
             (f"{phone}, then 30 1234\n5678 and 34 5678", None), ("ip 10.10.200.30 and 10 10 200 30, 200.30", "10 10 200 30"), (f"{card}; 78 {card[5:]}", card[5:])]
    got = {r.doc_id: (r.base, r.spans) for r in personal_data.find_personal_data(shipped.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    for k, (t, item) in enumerate(cases):
        base, spans = got[k]
        kind, a, b = base.split(":")
        at = t.rindex(item) if item else 0
        assert spans == (base if item is None else f"{base},{kind}:{at}:{at + len(item)}"), t


def test_language_model(docs, rows):
    got = language_model.score(docs).collect()
    assert len(got) == len(rows)
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tok = [(i, [*words((t or "").translate(low)), ""]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(x for i, t in tok if not held(i) for x in t)
    n, v = sum(count.values()), len(count)
    want = {i: (held(i), len(t), sum(x in count for x in t), n) for i, t in tok}
    assert {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got} == want
    for r in got:
        base = sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in dict(tok)[r.doc_id])
        assert abs(base - r.base_score) < 1e-6 * max(1, abs(base))
        assert r.score <= 0


def test_language_model_uses_history(shipped):
    rng = random.Random(5)
    cycle = ["red", "green", "blue", "black", "white"]
    data = []
    for i in range(120):
        k = rng.randrange(5)
        data.append((i, " ".join(cycle[(k + j) % 5] for j in range(60))))
    got = [r for r in language_model.score(shipped.createDataFrame(data, "doc_id long, text string").coalesce(2)).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_language_model_history_within_a_class(shipped):
    """The history tells words of one suffix class apart, and the model stays a distribution."""
    data = [(i, " ".join(f"w{(i * 7 + j) % 90:02d}ab" for j in range(150))) for i in range(500)]
    docs = shipped.createDataFrame(data, "doc_id long, text string").coalesce(1)
    got = [r for r in language_model.score(docs).collect() if r.held_out]
    assert got and sum(r.score for r in got) > 0.4 * sum(r.base_score for r in got)
    rng = np.random.default_rng(1)
    form = language_model.Shape(1 << 10, 16).fit(np.full(language_model.CLASSES, 1 / language_model.CLASSES), rng.integers(0, 9, (language_model.CLASSES, 16)))
    flat = form.start()
    flat += rng.normal(size=len(flat)).astype(np.float32)
    n = language_model.CLASSES * 16
    cls, leaf = np.divmod(np.arange(n), 16)
    p = 10 ** language_model.Model(form, flat).scores(np.full((4, n), 5, dtype=np.uint64), cls, leaf)
    lone = cls < language_model.SINGLES
    assert form.depth == 1 and abs(p[~lone].sum() + p[lone].sum() / 16 - 1) < 1e-4
    assert language_model.Shape(1 << 20, 1 << 13).buckets > form.buckets and language_model.Shape(1 << 20, 1 << 11).depth == 3


def test_language_model_ignores_partitions(docs):
    """Rounds sum over all texts, so the layout of the input moves no score by more than rounding."""
    one, many = ({r.doc_id: r.score for r in language_model.score(docs.repartition(n)).collect()} for n in (1, 16))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) <= 0.002 * abs(one[k]) for k in one)


def test_language_model_sums(shipped):
    """Row sums against a plain loop, exact rows back from the pieces, expected counts of each context adding up to its tokens."""
    rng = np.random.default_rng(2)
    rows, x = rng.zipf(1.3, 500) % 70_000, rng.normal(size=(500, 16)).astype(np.float32)
    want = np.zeros((70_000, 16), np.float32)
    np.add.at(want, rows, x)
    got, cols = np.zeros_like(want), np.zeros((16, 70_000), np.float32)
    language_model.add_rows(got, rows, x)
    language_model.add_columns(cols, rows[None], x)
    assert np.allclose(got, want, atol=1e-4) and np.allclose(cols.T, want, atol=1e-4)
    back = np.zeros_like(want)
    for p in language_model.pieces([got]):
        language_model.add_piece([back], *(p.column(k)[0].as_py() for k in range(4)))
    assert np.allclose(back, got, atol=2e-3 * np.abs(got).max())
    form = language_model.Shape(1 << 10, 16).fit(np.full(language_model.CLASSES, 1 / language_model.CLASSES), rng.integers(0, 9, (language_model.CLASSES, 16)))
    keys, cls, leaf = rng.integers(0, 99, (4, 3000)).astype(np.uint64), rng.integers(0, language_model.CLASSES, 3000), rng.integers(0, 16, 3000)
    flat = form.start() + rng.normal(size=form.size).astype(np.float32)
    model, seen, expected = language_model.Model(form, flat), form.zeros(columns=True), form.zeros(columns=True)
    model.observe(seen, keys, cls, leaf)
    model.expect(expected, keys, cls, leaf)
    assert np.allclose(seen[0].sum(axis=1), expected[0].sum(axis=1), atol=1e-2) and np.allclose(seen[1].sum(axis=0), expected[1].sum(axis=0), atol=1e-2)


def test_language_model_step_copies_no_model():
    rng = np.random.default_rng(5)
    weights, observed, expected = (rng.random((1 << 16, 64), dtype=np.float32) for _ in range(3))
    floor = np.full(64, 1 / 64, dtype=np.float32)
    want = np.clip(weights + np.float32(0.2) * np.log((observed + np.float32(50) * floor) / (expected + np.float32(50) * floor)), -9, 9)
    tracemalloc.start()
    language_model.step(weights, observed, expected, floor, (0.2, 50.0))
    peak = tracemalloc.get_traced_memory()[1]
    form = language_model.Shape(1 << 14, 16).fit(floor, np.ones((language_model.CLASSES, 16)))
    trainer, sums = language_model.Trainer(form), form.zeros()
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    trainer.begin(sums)
    first = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert np.array_equal(weights, want) and peak < weights.nbytes and first < sums[0].nbytes


def test_language_model_tail_tokens(docs, rows, monkeypatch):
    """Tokens outside the broadcast head get the same scores through the join."""
    full = {r.doc_id: (r.n_known, r.base_score) for r in language_model.score(docs).collect()}
    monkeypatch.setattr(language_model, "HEAD", 10)
    few = {r.doc_id: (r.n_known, r.base_score) for r in language_model.score(docs).collect()}
    assert {k: v[0] for k, v in full.items()} == {k: v[0] for k, v in few.items()}
    assert all(abs(full[k][1] - few[k][1]) < 1e-6 * abs(full[k][1]) for k in full)


def test_quality_classifier(shipped):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(300)]
    data, labels = [(-1, None), (-2, "")], []
    for i in range(500):
        good = rng.random() < 0.7
        w = [rng.choice(vocab) for _ in range(rng.randint(30, 80))]
        data.append((i, " ".join(w if good else [x + "###" for x in w])))
        labels.append((i, int(good)))
    labels += [(7, 1), (9999, 0), (8, None)]
    got = quality_classifier.classify(shipped.createDataFrame(data, "doc_id long, text string"), shipped.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels[:500])
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.95


def test_classifier_without_labels(shipped, docs):
    none = shipped.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 3) for r in quality_classifier.classify(docs, none).collect()} == {0.5}


def test_url_filter(shipped):
    urls = [None, "", "no scheme", "http://A.Example.ORG/en/12?x#y", "https://example.org/es/3", "x://example.org/fr", "http://org/", "http://b.com/de/1", "http://b.com/fr/1",
            "https://www.bad.net/p/", "http://m.bad.net:80/p?q", "http://bad.net/P", "http://good.net/p", "a://b://c.org/x", "http://bad.net/p", "http://host.net"]
    listed = shipped.createDataFrame([("ftp://u@BAD.net/p//",), (None,), ("nothing",)], "url string")
    pages = shipped.createDataFrame([(k, u, 1, 2) for k, u in enumerate(urls)], "page_id long, url string, _key int, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[4] == ("example.org", "/es/3", "example.org/es/", "block")
    assert got[5][2:] == ("org/", "allow") and got[6][2:] == ("org/", "allow")
    assert got[7][2:] == ("com/de/", "block") and got[8][2:] == ("com/fr/", "allow")
    assert got[9][3] == got[10][3] == got[14][3] == "block"
    assert got[11][3] == got[12][3] == got[15][3] == "allow"
    assert got[13][:2] == ("b:", "//c.org/x") or got[13][0] == "b:"


def test_bloom_has_no_false_negatives(shipped):
    keys = shipped.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    table, blocks = url_filter.bloom(keys)
    hit = F.aggregate(F.zip_with("words", url_filter._masks(F.col("key")), lambda w, m: w.bitwiseAND(m) != 0), F.lit(True), lambda a, x: a & x)
    probe = shipped.range(6000).select("id", F.concat(F.lit("k"), "id").alias("key")).withColumn("block", url_filter._block(F.col("key"), blocks))
    found = {r.id for r in probe.join(table, "block").where(hit).collect()}
    assert set(range(3000)) <= found and len(found) < 3300


def test_components(shipped):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(5, 5)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components(shipped.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.comp for r in got} == {x: find(x) for x in root} and len(got) == len(root)


def test_empty_tables(shipped, no_docs):
    bench = shipped.createDataFrame([], "item_id long, text string")
    labels = shipped.createDataFrame([], "doc_id long, quality int")
    pages = shipped.createDataFrame([], "page_id long, url string")
    for out in (repeats.remove_repeats(no_docs), quality_rules.ledger(no_docs), quality_classifier.classify(no_docs, labels),
                personal_data.find_personal_data(no_docs), packing.pack(no_docs, vocabulary()), language_model.score(no_docs),
                jaccard_join.near_duplicates(no_docs), decontaminate.find_items(no_docs, bench), url_filter.judge(pages, pages),
                line_dedup.dedup_lines(no_docs)):
        assert out.count() == 0


def test_digest_is_of_utf8(docs, rows):
    got = {r.doc_id: r.h for r in repeats.remove_repeats(docs).select("doc_id", F.sha2("text", 256).alias("h")).collect()}
    short = [i for i, t in rows if t and 0 < len(words(t)) < 20]
    assert short and all(got[i] == hashlib.sha256(" ".join(words(by_id(rows)[i])).encode()).hexdigest() for i in short)
