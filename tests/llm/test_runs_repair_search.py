"""Periodic runs, conversation repair and exact search against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelset.llm import conversation_repair as cr
from labelset.llm import exact_search as es
from labelset.llm import periodic_runs as pr
from labelset.llm.queries import LLM_QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# -- periodic runs ------------------------------------------------------------------------------

def lyndon_by_definition(s):
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def runs_by_definition(s, least=6, times=4):
    out = []
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j > i:
                a, b = i, j + p
                if b - a >= max(least, times * p) and not any(p % d == 0 and s[a:b - d] == s[a + d:b] for d in range(1, p)):
                    out.append((a, b - a, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(1500):
        s = np.unique([rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 14))], return_inverse=True)[1].tolist()
        assert pr.lyndon_lengths(s) == lyndon_by_definition(s)
    assert pr.lyndon_lengths([]) == []


def test_runs_of_stretches():
    rng = random.Random(2)
    for _ in range(1200):
        parts, bounds = [], [0]
        for _ in range(rng.randint(1, 3)):
            s = []
            while len(s) < rng.randint(6, 60):
                s += [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(1, 6))] * rng.randint(1, 7)
            parts.append(s)
            bounds.append(bounds[-1] + len(s))
        want = sorted((a + lo, a + n + lo, p) for lo, s in zip(bounds, parts) for a, n, p in runs_by_definition(s))
        assert pr.runs_of(np.array(sum(parts, [])), np.array(bounds)) == want


def test_fibonacci_and_thue_morse_words():
    """Words whose prefix sums fool polynomial fingerprints modulo 2**64, and words full of squares."""
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(1 << 13)]
    for s in (b, thue, thue * 5):
        want = [(x, x + n, p) for x, n, p in runs_by_definition(s)] if len(s) < 9000 else [(0, len(s), 1 << 13)]
        got = pr.runs_of(np.array(s), np.array([0, len(s)]))
        assert got == want if len(s) < 9000 else want[0] in got


def periodic_by_definition(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def op11_rows(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, LLM_QUERIES["op11_periodic_runs"].build(spark, folder).collect()), key=str)


def test_periodic_runs_query(shipped, rows, tmp_path):
    rng = random.Random(3)
    extra = []
    for i in range(60):
        unit = [rng.choice(["tick", "tock", "été", "a|b", "x"]) for _ in range(rng.randint(1, 5))]
        extra.append((5000 + i, " ".join(rng.choice(["alpha", "beta"]) for _ in range(rng.randint(0, 5))) + "\n " + "  ".join(unit * rng.randint(2, 9))))
    data = [(a, t, a) for a, t in [*[r for r in rows if len(r[1] or "") < 20000], *extra, (None, "u v " * 9), (None, None)]]
    docs = shipped.createDataFrame(data, "doc_id long, text string, runs long").repartition(5)
    got = op11_rows(shipped, docs, str(tmp_path))
    assert got == sorted((periodic_by_definition(a, t) for a, t, _ in data), key=str)
    assert sum(r[1] > 0 for r in got) > 30


def test_periodic_runs_empty_and_huge(shipped, no_docs, tmp_path):
    assert op11_rows(shipped, no_docs, str(tmp_path / "none")) == []
    unit = " ".join(f"w{i}" for i in range(1000))
    tail = " ".join(f"z{i}" for i in range(150_000))
    docs = shipped.createDataFrame([(1, tail + " " + " ".join([unit] * 30))], "doc_id long, text string")  # 1.2 MB
    out = pr.find_runs(docs).first()
    assert [tuple(r) for r in out["runs"]] == [(150_000, 30_000, 1000)]
    assert out["collapsed"] == tail + " " + unit
    with pytest.raises(ValueError):
        pr.find_runs(docs, min_exponent=2)


# -- conversation repair ------------------------------------------------------------------------

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
FAULT = (cr.NONE, cr.BLANK, cr.DUPLICATE, cr.TRUNCATED)


def cheapest_by_search(initials, faults, inserts=2):
    """(cost, audit) over all edit scripts with up to so many inserts at each place."""
    best = None
    n = len(initials)

    def grow(i, cost, audit, roles, room):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == n:
            if GRAMMAR.match(roles):
                best = min(best or (cost, audit), (cost, audit))
        else:
            grow(i + 1, cost + 2, audit + "D", roles, inserts)
            if faults[i] not in (cr.BLANK, cr.DUPLICATE):
                more = 5 if faults[i] == cr.TRUNCATED else 0
                grow(i + 1, cost + more, audit + "K", roles + (initials[i] or "-"), inserts)
                for r in "ua":
                    grow(i + 1, cost + more + 1, audit + "R", roles + r, inserts)
        if room:
            for r in "ua":
                grow(i, cost + 5, audit + "I", roles + r, room - 1)

    grow(0, 0, "", "", inserts)
    return best


def test_cheapest_script_with_inserts_allowed():
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product((cr.NONE, cr.BLANK, cr.TRUNCATED), repeat=n):
                cost, path = cr.chain([cr.segment_weights(list(initials), list(faults))]) if n else (0, [])
                assert (cost, "".join(p[1] for p in path)) == cheapest_by_search(initials, faults)


def test_segments_chain_like_one():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 7)
        initials = [rng.choice(["s", "u", "a", "x", "", "U"]) for _ in range(n)]
        faults = [rng.choice(FAULT) for _ in range(n)]
        cuts = sorted(rng.sample(range(1, n), rng.randint(0, n - 1))) if n > 1 else []
        parts = [cr.segment_weights(initials[a:b], faults[a:b]) for a, b in zip([0, *cuts], [*cuts, n])]
        cost, path = cr.chain(parts)
        assert (cost, "".join(p[1] for p in path)) == cheapest_by_search(initials, faults, 1)


def cheapest_by_suffixes(initials, faults):
    """Suffix programme over (cost, audit) pairs; for long conversations, without inserts."""
    best = {s: (0, "") for s in cr.WHOLE}
    for initial, fault in zip(reversed(initials), reversed(faults)):
        best = {s: min((c + best[to][0], e + best[to][1]) for c, e, _, to in cr.row_edits(s, initial, fault) if to in best)
                for s in range(4) if any(to in best for *_, to in cr.row_edits(s, initial, fault))}
    return best[cr.EMPTY]


def damaged_by_definition(rows):
    sp = lambda v: " " if v is None else str(v)
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", sp(text)) if k == 2 else sp(text)
        out += [(c, t, "user" if k == 4 else sp(role), text)] * (2 if k == 3 else 1)
    return out


def reports_by_definition(rows):
    out, damaged = [], damaged_by_definition(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in mine:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append(cr.BLANK if not last else cr.DUPLICATE if (role, text) in seen else cr.TRUNCATED if last[0] not in ".!?" else cr.NONE)
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit = cheapest_by_search(initials, faults, 1) if len(mine) <= 5 else cheapest_by_suffixes(initials, faults)
        kept, state = [], cr.EMPTY
        for edit, (_, _, role, text) in zip(audit, mine):
            if edit == "D":
                continue
            if edit == "R":
                role = "assistant" if state == cr.USER else "user"
            state = cr.NEXT[state][role[0]]
            kept.append(f"{role}:{text}")
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (cr.BLANK, cr.DUPLICATE, cr.TRUNCATED)),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(kept))))
    return sorted(out, key=str)


def op12_rows(spark, frame, folder):
    frame.write.parquet(f"{folder}/conversations.parquet")
    out = LLM_QUERIES["op12_conversation_repair"].build(spark, folder)
    return sorted(map(tuple, out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def test_conversation_repair_query(shipped, tmp_path):
    rng = random.Random(7)
    texts = ["Hello there.", "So?", "no end", " ", "", None, "été!", "a\nb. ", "Yes. \t"]
    rows = []
    for conv in [*range(150), None]:
        for t in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]),
                         rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}{rng.choice('.!?x')}"))
    rows += rows[:3]
    long = [(900, t, rng.choice(["user", "assistant"]), f"{rng.randrange(1500)}{rng.choice('..!x')}") for t in range(1700)]  # several segments
    data = [(*r, 1, "x") for r in rows + long]
    frame = shipped.createDataFrame(data, "conv_id long, turn long, role string, text string, pos int, seg string").repartition(3)
    assert op12_rows(shipped, frame, str(tmp_path)) == reports_by_definition(rows + long)


def test_conversation_repair_empty_and_dropped(shipped, tmp_path):
    shape = "conv_id long, turn long, role string, text string"
    assert op12_rows(shipped, shipped.createDataFrame([], shape), str(tmp_path / "none")) == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = op12_rows(shipped, shipped.createDataFrame([(1, gone, "user", "x" * 2_000_000)], shape), str(tmp_path / "one"))
    assert got == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]


# -- exact search -------------------------------------------------------------------------------

def search_by_definition(rows, k=5):
    whole = {}
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[n] = (i, [int(np.floor(256.0 * float(x))) for x in v])
    out = []
    for i, v in whole.values():
        if i is None or i % 50:
            continue
        met = [(-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j is None, j or 0)
               for j, w in whole.values() if j != i and len(w) == len(v)]
        out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(sorted(met)[:k])]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(4)


def test_exact_search(shipped):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 40))
    rows = [(i, (centres[i % 6] * rng.choice([0, 1, 1, 3]) + rng.normal(size=40) * 0.1).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)]  # one common vector, queries among it
    rows += [(2000 + i, rng.integers(-2, 3, size=3).astype(float).tolist()) for i in range(220)]  # many ties, another length
    rows += [(5000, None), (5001, []), (5050, []), (5002, [None] + [1.0] * 39), (5003, [float("nan")] * 40), (5100, [float("inf")] * 40),
             (None, rows[0][1]), (0, rows[3][1]), rows[50], (6000, [0.0] * 40), (6050, [1e12] * 40), (6051, [-1e12] * 40),
             (6052, [1e200] * 40), (6053, [1.7e308] * 40)]
    want = search_by_definition([r for r in rows if r[0] != 6053])  # 256 times its components is no double
    query = F.col("vec_id") % 50 == 0
    for size in (1 << 25, 4000):  # one block, and many
        got = es.top_k(vectors(shipped, rows), query, block_bytes=size)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_exact_search_small(shipped):
    query = F.col("vec_id") % 50 == 0
    assert es.top_k(vectors(shipped, []), query).count() == 0
    assert es.top_k(vectors(shipped, [(0, [1.0]), (1, None)]), query).count() == 0
    assert [tuple(r) for r in es.top_k(vectors(shipped, [(0, [1.0]), (1, [-0.001])]), query).collect()] == [(0, 1, 1, -256)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    x = np.floor(256 * (np.repeat(rng.normal(size=(60, 16)), 4, axis=1) + 0.05 * rng.normal(size=(60, 64))))
    scores, last = x @ x.T, None
    for s in es.statistics(x):
        bound = s @ s.T
        assert (bound >= scores - 1e-6 * np.abs(scores).max()).all()
        assert last is None or (bound <= last + 1e-6 * last.max()).all()  # finer levels are tighter
        last = bound
    assert (last < np.sort(scores, axis=1)[:, -5:-4]).mean() > 0.5


# -- lines of long documents --------------------------------------------------------------------

def test_line_work_is_linear_in_a_documents_lines(shipped):
    """A document of 120,000 lines, each a word edit or a copy of another, in seconds; results by construction."""
    import time

    from labelset.llm.line_dedup import dedup_lines

    base = [f"alpha beta gamma delta epsilon zeta eta line{i}x tail{i}" for i in range(40_000)]
    text = "\n".join([*base, *base, *(b.replace("alpha", "omega") for b in base)])
    docs = shipped.createDataFrame([(1, text), (2, "short\n\nalpha beta"), (3, "\n".join(base[:2]))], "doc_id long, text string").repartition(3)
    t = time.time()
    got = {r["doc_id"]: (r["n_lines_removed"], r["text"]) for r in dedup_lines(docs).collect()}
    assert time.time() - t < 150
    assert got == {1: (80_000, "\n".join(base)), 2: (0, "short\n\nalpha beta"), 3: (2, "")}
