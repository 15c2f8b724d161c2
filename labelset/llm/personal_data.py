"""Personal data: base patterns plus a skip-chain conditional random field.

Base spans (email, ip, card, phone) come from patterns and checks. The field then labels the
document's tokens that hold a digit or an at sign. Its potentials are

- per token: log-odds of each label among the corpus tokens of the same shape against all tokens;
- between neighbours: log-odds of label pairs of adjacent such tokens in the corpus;
- skip links: equal tokens (letters folded, outer punctuation dropped), or tokens whose digits
  are equal and at least MIN_DIGITS long, share a potential that favours one label. Tokens are
  linked to the first base token of each kind on their chain, or without one each to its next
  occurrence, so that n occurrences make n - 1 links a kind however distant;
- so do the tokens of a run of digit groups (joined across spaces, dots, hyphens and round
  brackets) whose digits end a base card or phone and are at least MIN_DIGITS long, or equal all
  digits of a base address, linked to that base item. Zeros before the first group's matched
  digits (trunk prefix) count as part of it.

All counts are taken over every document, with the base spans as labels; both log-odds are
clipped to CLIP, and LINK is what outweighs a token's shape and both its neighbours at BELIEF, so
a link to a base token holds whatever the corpus holds besides, and the counts decide between
kinds. Loopy sum-product messages run within each document until they settle (at most ROUNDS
times); tokens inside base spans are clamped to their kind. A token
outside of them becomes a span of its kind if that label's belief is at least BELIEF and the
kind has a base span on the token's own skip chain, so texts without a repeated item gain
nothing. A run becomes one span, as long as it is matched, if all its tokens do.

Defined results: null text is empty; repeated rows are treated alike; texts have no length
limit, patterns run in linear time; an empty table gives an empty table; other columns are not
read. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelset.llm.textcore import text_chunks

KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed values); emails are read outwards from each at sign.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
OUTER = "\"'`.,;:!?()[]{}<>*#$%&|"
LABELS = len(KINDS) + 1  # 0: none
SHAPES = 1 << 12
MIN_DIGITS, BELIEF, ROUNDS, SETTLED = 7, 0.8, 200, 1e-4
CLIP = 2.0  # bound of the log-odds from the corpus
#: Log potential of equal labels over a skip link: two labels differ by 2 * CLIP at most in the token's shape and in each of two neighbours.
LINK = 6 * CLIP + float(np.log(BELIEF / (1 - BELIEF) * (LABELS - 1)))
SKIP = re.compile(r"[0-9@]")
GROUP = re.compile(r"[0-9]+")
JOINT = re.compile(r"[\x20().-]+")
LONGEST = 19  # digits of a base card or phone at most


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain: a match can only start in the run before its at sign."""
    out, end, at = [], 0, t.find("@")
    while at >= 0:
        i = at
        while i > end and t[i - 1] in LOCAL:
            i -= 1
        m = DOMAIN.match(t, at + 1) if i < at else None
        if m:
            end = m.end()
            out.append((i, end))
        at = t.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, sorted."""
    if not SKIP.search(t):
        return []
    out = [(a, 0, b) for a, b in emails(t)]
    for m in IP.finditer(t):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or "0") <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(t):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> int:
    """Bucket of a token's shape: runs of digits with their length, of letters, and marks as they are."""
    runs = re.sub(r"[0-9]{1,20}", lambda m: f"d{len(m[0])}", re.sub(r"[^\W\d_]+", "a", token))
    return int.from_bytes(hashlib.blake2b(runs[:64].encode(), digest_size=4).digest(), "little") % SHAPES


def candidates(t: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, shape, base label, next to the candidate before) of the tokens with a digit or an at sign."""
    out, at, number, last = [], 0, -1, -9
    for m in TOKEN.finditer(t):
        number += 1
        word = m[0]
        if not SKIP.search(word):
            continue
        core = word.strip(OUTER)
        if not core:
            continue
        a = m.start() + len(word) - len(word.lstrip(OUTER))
        b = a + len(core)
        while at < len(spans) and spans[at][2] <= a:
            at += 1
        label = next((k + 1 for s, k, e in spans[at:at + 4] if s < b and e > a), 0)
        out.append((a, b, shape(core), label, number == last + 1))
        last = number
    return out


def runs(t: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, dict[int, int]]]:
    """(start, end, {kind number: start of its first base span}) of the longest runs of digit groups outside the base spans that repeat a base item."""
    ends: dict[str, dict[int, int]] = {}  # digits that repeat an item, at most LONGEST of them
    for a, k, b in spans:
        d = _digits(t[a:b]) if k else ""
        if len(d) >= MIN_DIGITS:
            for i in range(1 if k == 1 else len(d) - MIN_DIGITS + 1):
                ends.setdefault(d[i:], {}).setdefault(k, a)
    if not ends:
        return []
    found, groups, at, last = [], [], 0, 0  # groups: (start, digits) of the groups joined to the one at hand
    for m in GROUP.finditer(t):
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        if any(s < m.end() for s, _, _ in spans[at:at + 1]):
            groups = []
            continue
        if groups and not JOINT.fullmatch(t, last, m.start()):
            groups = []
        groups.append((m.start(), m[0]))
        last, d = m.end(), ""
        best = None
        for a, g in reversed(groups):
            if len(d) + len(g.lstrip("0")) > LONGEST:
                break
            zeros = len(g) - len(g.lstrip("0"))
            # all digits of the group first, then without zeros before others
            for z in range(max(0, len(g) + len(d) - LONGEST), min(zeros, len(g) - 1) + 1):
                if kinds := ends.get(g[z:] + d):
                    best = (a, kinds)
                    break
            d = g + d
            if len(d) > LONGEST:
                break
        if best:
            a, kinds = best
            open_ = a and t[a - 1] == "(" and t.find(")", a, last) > 0 or a and t[a - 1] == "+"
            found.append((a - 1 if open_ else a, last, kinds))
    out: list[tuple[int, int, dict[int, int]]] = []
    for r in found:  # ends ascend; of runs that meet the longer one stays
        while out and out[-1][1] > r[0] and out[-1][1] - out[-1][0] < r[1] - r[0]:
            out.pop()
        if not out or out[-1][1] <= r[0]:
            out.append(r)
    return out


def corpus_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts (shape, label) and (label, next label) over all documents; bounded tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for part in text_chunks(batch):
                for t in part.column("text").to_pylist():
                    if not SKIP.search(t):
                        continue
                    before = 0
                    for _, _, form, label, near in candidates(t, base_spans(t)):
                        count[form, label] += 1
                        if near:
                            count[SHAPES + before, label] += 1
                        before = label
        keys = list(count)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([count[k] for k in keys], pa.int64())], names=["row", "label", "n"])

    got = docs.mapInArrow(run, "row int, label int, n long").groupBy("row", "label").agg(F.sum("n").alias("n"))
    table = np.zeros((SHAPES + LABELS, LABELS))
    for r in got.collect():  # (SHAPES + LABELS) * LABELS rows at most
        table[r["row"], r["label"]] = r["n"]
    return table[:SHAPES], table[SHAPES:]


class Field:
    """Potentials of the field from the corpus counts."""

    def __init__(self, shapes: np.ndarray, pairs: np.ndarray):
        share = (shapes.sum(axis=0) + 1) / (shapes.sum() + LABELS)
        self.unary = np.clip(np.log((shapes + 2 * share) / (shapes.sum(axis=1, keepdims=True) + 2) / share), -CLIP, CLIP)
        joint = (pairs + 0.5) / (pairs.sum() + 0.5 * LABELS**2)
        self.chain = np.clip(np.log(joint / joint.sum(axis=1, keepdims=True) / joint.sum(axis=0, keepdims=True)), -CLIP, CLIP)
        self.skip = np.eye(LABELS) * LINK

    def beliefs(self, tokens: list[tuple], edges: list[tuple[int, int, bool]]) -> np.ndarray:
        """Label beliefs of the tokens; edges (i, j, is a skip link), by loopy messages over all edges at once."""
        node = self.unary[[x[2] for x in tokens]]
        for i, x in enumerate(tokens):
            if x[3]:
                node[i] = -np.inf  # whatever number of links meets here
                node[i, x[3]] = 0.0
        src = np.array([e[k] for e in edges for k in (0, 1)])
        dst = np.array([e[k] for e in edges for k in (1, 0)])
        pot = np.array([m for _, _, s in edges for m in ((self.skip, self.skip) if s else (self.chain, self.chain.T))])
        back = np.arange(len(src)) ^ 1
        msg = np.zeros((len(src), LABELS))
        for _ in range(ROUNDS):
            total = node.copy()
            np.add.at(total, dst, msg)
            out = total[src] - msg[back]
            z = out[:, :, None] + pot
            top = z.max(axis=1, keepdims=True)
            new = (top + np.log(np.exp(z - top).sum(axis=1, keepdims=True)))[:, 0]
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - msg).max(initial=0)
            msg = 0.5 * msg + 0.5 * new
            if moved < SETTLED:
                break
        total = node
        np.add.at(total, dst, msg)
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)

    def added(self, t: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans (start, kind number, end) that the field adds to the base spans."""
        if not spans:
            return []
        tokens = candidates(t, spans)
        if all(x[3] for x in tokens):
            return []
        last: dict[str, int] = {}
        kinds: dict[str, dict[int, int]] = {}  # first token of each base label along each chain
        keys_of: dict[int, list[str]] = {}
        edges = []
        for i, (a, b, _, label, near) in enumerate(tokens):
            if near:
                edges.append((i - 1, i, False))
            core = t[a:b].casefold()
            digits = _digits(core)
            keys_of[i] = [*({core, digits} if len(digits) >= MIN_DIGITS else {core} if len(core) >= MIN_DIGITS else ())]
            for key in keys_of[i] if label else ():
                kinds.setdefault(key, {}).setdefault(label, i)
        for i, keys in keys_of.items():
            for key in keys:
                if key in kinds:
                    edges += [(j, i, True) for j in kinds[key].values()] if not tokens[i][3] else []
                elif key in last:
                    edges.append((last[key], i, True))
                last[key] = i
        starts = [x[0] for x in tokens]
        found = []
        for a, b, items in runs(t, spans):
            inside = [i for i in range(max(bisect_right(starts, a) - 1, 0), bisect_left(starts, b)) if tokens[i][1] > a]
            if inside and not any(tokens[i][3] for i in inside):
                found.append((a, b, set(items), inside))
                for start in items.values():
                    j = next(j for j in range(max(bisect_right(starts, start) - 1, 0), len(tokens)) if tokens[j][1] > start)
                    edges += [(j, i, True) for i in inside]
        open_ = {i: {x for k in keys for x in kinds.get(k, ())} for i, keys in keys_of.items() if not tokens[i][3]}
        if not found and not any(open_.values()):
            return []
        p = self.beliefs(tokens, edges)
        best = p[:, 1:].argmax(axis=1)
        sure = p[np.arange(len(p)), best + 1] >= BELIEF
        new = [(tokens[i][0], int(best[i]), tokens[i][1]) for i in sorted(open_) if best[i] + 1 in open_[i] and sure[i]]
        new += [(a, int(best[inside[0]]), b) for a, b, items, inside in found
                if best[inside[0]] in items and all(sure[i] and best[i] == best[inside[0]] for i in inside)]
        out: list[tuple[int, int, int]] = []
        for a, k, b in sorted(new):  # a token and a run that meet are one span
            if out and out[-1][1] == k and a < out[-1][2]:
                out[-1] = (out[-1][0], k, max(b, out[-1][2]))
            else:
                out.append((a, k, b))
        return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id``, ``base`` (its base spans, joined) and ``spans`` (all of them, joined), with base counts per kind."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Field(*corpus_counts(d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                rows = []
                for t in part.column("text").to_pylist():
                    base = base_spans(t)
                    kinds = [k for _, k, _ in base]
                    rows.append((*(kinds.count(k) for k in range(len(KINDS))), joined(base), joined(sorted(base + shared.value.added(t, base)))))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:-2]), *(pa.array(c, pa.string()) for c in cols[-2:])],
                                                 names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return d.mapInArrow(run, f"doc_id long, {counts}, base string, spans string")
