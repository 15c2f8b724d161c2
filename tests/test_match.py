"""Canonicalisation stages against brute force and the documented edge cases."""

import difflib
import random
import time

from pyspark.sql import functions as F

from labelset.functions.text import STOPWORDS
from labelset.operators import match as MT


def toks(s):
    return {w for w in s.split() if w and w not in set(STOPWORDS)}


def score(a, b):
    inter = len(a & b)
    return inter / len(a | b) + (0.1 if (a <= b or b <= a) else 0.0)


def uni(spark, names):
    return spark.createDataFrame([(n,) for n in names], "norm string")


def test_rules_first_hit_prefix(spark):
    df = spark.createDataFrame([("tempo medio para resolucao total",), ("custo por aquisicao",),
                                ("o roi da campanha",), ("sem regra",)], "n string")
    got = {r.n: r.t for r in df.select("n", MT.match_rules(F.col("n")).alias("t")).collect()}
    assert got == {"tempo medio para resolucao total": "mttr", "custo por aquisicao": "cpa",
                   "o roi da campanha": "roi", "sem regra": None}


def test_token_threshold_and_ties(spark):
    u = uni(spark, ["lead time", "churn de clientes", "taxa de churn", "nps"])
    names = spark.createDataFrame([("lead time for changes",), ("churn de usuarios",)], "name string")
    got = {r.name: (r.canon, r.score) for r in MT.match_tokens(names, u).collect()}
    assert got["lead time for changes"][0] == "lead time"
    assert abs(got["lead time for changes"][1] - 0.6) < 1e-12
    assert got["churn de usuarios"] == ("churn de clientes", 1.1)


def test_token_pairs_equal_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(12)]
    left = {f"l{i}": set(rnd.sample(vocab, rnd.randrange(1, 6))) for i in range(60)}
    right = {f"r{i}": set(rnd.sample(vocab, rnd.randrange(1, 6))) for i in range(60)}
    L = spark.createDataFrame([(k, sorted(v)) for k, v in left.items()], "id string, tokens array<string>")
    R = spark.createDataFrame([(k, sorted(v)) for k, v in right.items()], "rid string, tokens array<string>")
    got = {(r.id, r.rid) for r in MT.token_similarity_pairs(L, R, "id", "rid").collect()}
    want = {(a, b) for a, ta in left.items() for b, tb in right.items() if score(ta, tb) >= 0.6}
    assert got == want
    # self join: only earlier partners
    S = spark.createDataFrame([(i, sorted(v)) for i, v in enumerate(left.values())], "id int, tokens array<string>")
    got_s = {(r.id, r.m) for r in MT.token_similarity_pairs(S, S, "id", "m", self_join=True).collect()}
    vals = list(left.values())
    want_s = {(i, j) for i in range(len(vals)) for j in range(i) if score(vals[i], vals[j]) >= 0.6}
    assert got_s == want_s


def test_string_ratio_equals_close_matches(spark):
    rnd = random.Random(5)
    u = ["blue anvil", "red rod", "hot plate", "cold gear", "new widget", "small ring", "abc", "abd"]
    names = ["blue anvils", "red rods", "hot plat", "cold gears", "xyz", "abx", "new widgetz"]
    names += ["".join(rnd.choice("abcdegilnoprtw ") for _ in range(rnd.randrange(3, 12))) for _ in range(40)]
    df = spark.createDataFrame([(n,) for n in set(names)], "name string")
    got = {r.name: r.canon for r in MT.match_strings(df, uni(spark, u)).collect()}
    want = {}
    for n in set(names):
        m = difflib.get_close_matches(n, u, n=1, cutoff=0.85)
        if m:
            want[n] = m[0]
    assert got == want


def test_canonicalize_precedence(spark):
    u = uni(spark, ["cpa", "roi", "lead time", "taxa de conversao", "blue anvil"])
    names = spark.createDataFrame([(n,) for n in ["custo por aquisicao", "roi", "lead time for changes",
                                                  "taxa de", "blue anvils", ""]], "name string")
    got = {r.name: (r.canon, r.stage) for r in MT.canonicalize(names, u).collect()}
    assert got["custo por aquisicao"] == ("cpa", "rules")
    assert got["roi"] == ("roi", "rules")
    assert got["lead time for changes"] == ("lead time", "tokens")
    assert got["taxa de"] == ("taxa de", "unchanged")      # only stopwords, not in U
    assert got["blue anvils"] == ("blue anvil", "strings")
    assert got[""] == ("", "unchanged")


def test_best_earlier_match_collapses_copies(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(10)]
    sets = [set(rnd.sample(vocab, rnd.randrange(1, 5))) for _ in range(25)]
    sets += [set(sets[3]) for _ in range(15)] + [set(sets[7]) for _ in range(5)]   # copy groups
    df = spark.createDataFrame([(i, sorted(v)) for i, v in enumerate(sets)], "id int, tokens array<string>")
    got = {r.id: (r.match_id, round(r.score, 9)) for r in MT.best_earlier_match(df, "id").collect()}
    want = {}
    for i, a in enumerate(sets):
        cands = [(score(a, b), j) for j, b in enumerate(sets[:i]) if score(a, b) >= 0.6]
        if cands:
            sc, j = max(cands, key=lambda x: (x[0], -x[1]))
            want[i] = (j, round(sc, 9))
    assert got == want


def test_token_pairs_of_small_vocabularies(spark):
    rnd = random.Random(13)
    vocab = [f"t{i}" for i in range(9)]
    left = {i: set(rnd.sample(vocab, rnd.randrange(1, 5))) for i in range(40)}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in left.items()], "id int, tokens array<string>")
    want = {(i, j) for i in left for j in left if j < i and score(left[i], left[j]) >= 0.6}
    got = {(r.id, r.m) for r in MT.token_similarity_pairs(df, df, "id", "m", self_join=True).collect()}
    assert got == want


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_levenshtein_stage_equals_brute_force(spark):
    rnd = random.Random(21)
    alpha = "abcde "
    u = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randrange(1, 24))) for _ in range(120)})
    names = set()
    for x in u[:60]:                       # near variants of universe entries
        y = list(x)
        for _ in range(rnd.randrange(0, 4)):
            op = rnd.randrange(3)
            pos = rnd.randrange(len(y) + 1)
            if op == 0:
                y.insert(pos, rnd.choice(alpha))
            elif op == 1 and y:
                y.pop(min(pos, len(y) - 1))
            elif y:
                y[min(pos, len(y) - 1)] = rnd.choice(alpha)
        names.add("".join(y))
    names |= {"".join(rnd.choice(alpha) for _ in range(rnd.randrange(1, 24))) for _ in range(60)}
    names.discard("")
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.canon for r in MT.match_strings(df, uni(spark, u), method="levenshtein").collect()}
    want = {}
    for n in names:
        best = None
        for x in u:
            m = max(len(n), len(x))
            sc = 1.0 - _lev(n, x) / m
            if sc >= 0.85 and (best is None or (sc, x) > best):
                best = (sc, x)
        if best:
            want[n] = best[1]
    assert got == want


def test_string_stage_is_complete_at_any_threshold(spark):
    import difflib

    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 12)))
    names = sorted({word() for _ in range(60)} | {"abcdxx", "abcde"})
    uni = sorted({word() for _ in range(60)} | {"abcdef"})
    n, u = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in uni], "norm string")
    for method in ("ratio", "levenshtein"):
        for t in (0.6, 0.85):
            def sim(a, b):
                if method == "ratio":
                    return difflib.SequenceMatcher(None, b, a, autojunk=True).ratio()
                return 1 - _lev(a, b) / max(len(a), len(b))

            want = {}
            for a in names:
                hits = [(sim(a, b), b) for b in uni if sim(a, b) >= t - 1e-12]
                if hits:
                    want[a] = max(hits)[1]
            got = {r.name: r.canon for r in MT.match_strings(n, u, method=method, threshold=t).collect()}
            assert got == want, (method, t)


def test_string_stage_complete_at_any_threshold(spark):
    """Short strings, repeated letters and low thresholds: no pair is lost without a length band."""
    rnd = random.Random(23)
    word = lambda: "".join(rnd.choice("aabcd e") for _ in range(rnd.randint(1, 9)))
    us = sorted({word() for _ in range(45)} | {"a", "aa", "abcabcabcabc"})
    ns = sorted({word() for _ in range(40)} | {u[:-1] for u in us[:8] if len(u) > 1} | {"zz"})
    names = spark.createDataFrame([(n,) for n in ns], "name string")

    def best(score, t):
        hits = {n: max(((score(u, n), u) for u in us if score(u, n) >= t), default=None) for n in ns}
        return {n: (h[1], round(h[0], 9)) for n, h in hits.items() if h}

    ratio = lambda u, n: difflib.SequenceMatcher(None, u, n).ratio()
    lev = lambda u, n: 1 - _lev(u, n) / max(len(u), len(n))
    for t in (0.5, 0.67, 0.95):
        for method, score in (("ratio", ratio), ("levenshtein", lev)):
            got = {r["name"]: (r.canon, round(r.score, 9)) for r in MT.match_strings(names, uni(spark, us), method=method, threshold=t).collect()}
            assert got == best(score, t), (method, t)


def test_hot_posting_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(MT, "POSTING_ROWS", 3)
    rnd = random.Random(29)
    sets = [{"hot", *rnd.sample([f"w{i}" for i in range(9)], rnd.randrange(1, 6))} for _ in range(60)]
    s = spark.createDataFrame([(i, sorted(v)) for i, v in enumerate(sets)], "id int, tokens array<string>")
    got = {(r.id, r.m) for r in MT.token_similarity_pairs(s, s, "id", "m", self_join=True).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i) if score(sets[i], sets[j]) >= 0.6}


def test_few_candidates_for_large_sets(spark):
    """Sets of one vocabulary that share many frequent tokens: extended prefixes leave few unverified pairs."""
    rnd = random.Random(31)
    weights = [1 / (i + 1) for i in range(3000)]
    sets = [set(rnd.choices(range(3000), weights, k=120)) for _ in range(150)]
    sets += [set(list(s)[: len(s) * 9 // 10]) for s in sets[:40]]
    s = spark.createDataFrame([(i, [f"t{x}" for x in sorted(v)]) for i, v in enumerate(sets)], "id int, tokens array<string>")
    cand = {(r.lid, r.rid) for r in MT.token_candidates(s, s, True).collect()}
    true = {(i, j) for i in range(len(sets)) for j in range(i) if score(sets[i], sets[j]) >= 0.6}
    assert true <= cand and len(cand) < 10 * len(true)


def test_token_rounds_bound_disk(spark, monkeypatch):
    """Many small rounds give the brute-force partners, and no step leaves its shuffle files behind."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, sorted(rng.sample(vocab, rng.randint(1, 9)))) for i in range(150)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:5])]
    rounds = []
    monkeypatch.setattr(MT, "ROUND_ROWS", 0)
    monkeypatch.setattr(MT, "LEAST_ROUND", 1000)
    count = MT.candidate_rounds
    monkeypatch.setattr(MT, "candidate_rounds", lambda *a: rounds.append(count(*a)) or rounds[-1])
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for f in disk.getAllFiles().mkString("\n").split("\n") if (n := f.rsplit("/", 1)[-1]).startswith("shuffle_")}
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    before = files()
    best = MT.best_earlier_match(df, "id")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    kinds = {f.split("_")[1] for f in left}
    assert len(kinds) <= 4 and rounds[0] > 2  # at most those of the small reads that size the rounds
    want = {}
    for i, a in rows:
        a = set(a)
        scored = [(-(len(a & set(b)) / len(a | set(b)) + (0.1 if a <= set(b) or set(b) <= a else 0)), j) for j, b in rows if j < i]
        s, j = min(scored, default=(0, 0))
        if -s >= 0.6 - 1e-9:
            want[i] = (j, round(-s, 9))
    assert {r.id: (r.match_id, round(r.score, 9)) for r in best.collect()} == want


def test_near_copies_are_not_all_verified(spark, monkeypatch):
    """The best partner in a cluster of near copies is found from few of its pairs."""
    rng = random.Random(17)
    words = [f"c{i}" for i in range(60)]
    sets = [set(rng.sample(words, rng.randrange(50, 60))) for _ in range(60)] + [{f"o{i}", f"p{i % 7}"} for i in range(20)]
    verified, verify = [], MT._verified_rounds
    monkeypatch.setattr(MT, "_verified_rounds", lambda pairs, *a: verified.append(pairs.count()) or verify(pairs, *a))
    df = spark.createDataFrame([(i, sorted(v)) for i, v in enumerate(sets)], "id int, tokens array<string>")
    got = {r.id: (r.match_id, round(r.score, 9)) for r in MT.best_earlier_match(df, "id").collect()}
    want = {}
    for i, a in enumerate(sets):
        s, j = max(((score(a, b), -j) for j, b in enumerate(sets[:i])), default=(0, 0))
        if s >= 0.6:
            want[i] = (-j, round(s, 9))
    assert got == want
    assert sum(verified) < 60 * 59 / 2 / 2


def test_self_join_over_many_parts(spark, monkeypatch):
    """Sets around the sketch sizes, contained ones and hot tokens, over many small parts: no pair is lost."""
    monkeypatch.setattr(MT, "PART_ENTRIES", 400)
    monkeypatch.setattr(MT, "POSTING_ROWS", 2)
    rng = random.Random(19)
    words = [f"w{i}" for i in range(900)]
    sets = [set(rng.sample(words, n)) for n in (1, 2, 3, 5, 16, 17, 32, 33, 64, 65, 100, 128, 129, 257, 400)]
    for s in list(sets):
        some = sorted(s)
        for share in (1.0, 0.8, 0.75, 0.6, 0.5):
            part = set(some[:max(1, int(len(some) * share))])
            sets += [part, part | set(rng.sample(words, max(1, len(some) // 6)))]
    df = spark.createDataFrame([(i, sorted(v)) for i, v in enumerate(sets)], "id int, tokens array<string>")
    got = {(r.id, r.m): round(r.score, 9) for r in MT.token_similarity_pairs(df, df, "id", "m", self_join=True).collect()}
    assert got == {(i, j): round(s, 9) for i in range(len(sets)) for j in range(i) if (s := score(sets[i], sets[j])) >= 0.6}
    cand = {(r.lid, r.rid) for r in MT.token_candidates(df, df, True).collect()}
    assert set(got) <= cand and len(cand) < 2 * len(got)
