"""Near-duplicate line removal through a deletion-neighbourhood join (DataFrame functions only).

A line (text between ``\\n``) with a word is removed if an earlier line (smaller document id,
or same document and smaller line number) is within the edit bound; lines are judged on the
input. The bound is 0 edits (equal words) for lines of fewer than ``min_words`` words and one
inserted, deleted or replaced word for the others. Lines without a word always stay.

Method. Equal lines (128 hash bits) are reduced to their earliest place first. A line of n words
then emits its deletion variants as hashed keys: (n, i, line without word i) for each i, which
two lines share if they differ by replacing word i, and (n - 1, line without word i), which
meets the whole-line key (n - 1, line) of a line with one word less. Variants of equal key are
reduced to their earliest line with a map-side combine, so no group is ever gathered and no
pairs within a group are made; each line then meets only the earliest holder of each of its
keys. That is enough as the keys are true to order: lines of equal key have equal words left (up
to a chance meeting of 64 bits), so all holders are within the bound or none is. The edit
distance to the holder is verified on the words themselves.

Only lines that can have a partner emit variants: by the pigeonhole principle lines one edit
apart agree in their first or in their last half, so a line stays out of the variant join if
each of its half keys occurs once. This drops no pair.

Defined results: null text has no lines; a document whose lines all go keeps its row, with
empty text; rows that share an id count as one document (a line number removed in one is
removed in all, and equal rows lose nothing to each other); rows with a null id come before
all others and keep their lines; an empty table gives an empty table; other columns are
carried, none is needed but the id and the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelset.llm.landing import land, small

MIN_WORDS = 8
#: Key tables of at most this many rows are broadcast; larger ones are shuffled. Half keys have 8 bytes a row, line
#: keys 40; a document's wanted places 16 bytes each, so those tables are held to as many places.
BROADCAST_KEYS = 400_000
SWAP, WHOLE, DROP = 0, 1, 2


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line with a word: ``_doc``, ``_no`` (line number from 0), ``_line`` (its words joined by one space), ``_h1``, ``_h2``."""
    each = docs.select(F.col(doc_id).alias("_doc"), F.posexplode(F.split(F.col(text), "\n")).alias("_no", "_raw"))
    return each.where(F.col("_raw").rlike(r"[^\x20\x09-\x0D]")).select("_doc", "_no", one_spaced("_raw").alias("_line"))


def with_lines(text: str, use) -> Column:
    """``use(lines)`` with the text split once, whatever lambdas read the lines."""
    return F.get(F.transform(F.array(F.split(text, "\n")), use), F.lit(0))


def without(lines: Column, gone: Column) -> Column:
    """``lines`` but those at the sorted places ``gone``: the slices between them, in linear time."""
    def between(places: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda j: F.slice(
            lines, F.get(places, j - 1) + 2, F.get(places, j) - F.get(places, j - 1) - 1)))

    ends = F.concat(F.array(F.lit(-1)), F.filter(gone, lambda g: g < F.size(lines)), F.array(F.size(lines)))
    return F.get(F.transform(F.array(ends), between), F.lit(0))


def one_spaced(raw: str) -> Column:
    return F.btrim(F.regexp_replace(raw, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def n_words(line: Column) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _halves(n: Column, line: Column) -> Column:
    """Half keys of a line: struct(key, left, size) for its length classes.

    Class c holds lines of 2c to 2c + 2 words and compares their first c and their last c words;
    lines of an even number n of words are in n / 2 and n / 2 - 1, others in (n - 1) / 2. Lines
    one edit apart have a class in common and agree in one of its two halves.
    """
    def pair(c: Column) -> list[Column]:
        return [F.struct(F.xxhash64(c, F.lit(side), F.call_function("substring_index", line, F.lit(" "), part)).alias("key"),
                         F.lit(side == 0).alias("left"), c.alias("size")) for side, part in ((0, c), (1, -c))]

    c = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 0, F.array(*pair(c), *pair(c - 1))).otherwise(F.array(*pair(c)))


def _variant_keys(n: Column, h: Column) -> Column:
    """Hashed deletion variants of a line with the word hashes ``h``, and its whole-line key.

    A word list is hashed as the exclusive-or of its (place, word) hashes, all of them different,
    so equal keys mean equal word lists up to chance of 64 bits. Same length: all but word i at
    their places. One word less: the words after i move down by one place, so neighbouring
    variants i - 1 and i differ in the hash of place i - 1 alone, and a running exclusive-or (by
    doubled distances, n log n steps) gives them all.
    """
    xor = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    place = F.transform(h, lambda x, i: F.xxhash64(i, x))
    first = xor(F.transform(h, lambda x, i: F.when(i > 0, F.xxhash64(i - 1, x)).otherwise(F.lit(0).cast("long"))))
    step = F.transform(h, lambda x, i: F.when(i == 0, first).otherwise(F.xxhash64(i - 1, F.get(h, i - 1)).bitwiseXOR(F.xxhash64(i - 1, x))))
    rounds = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(n)).cast("int"))), lambda k: F.pow(F.lit(2), k - 1).cast("int"))
    less = F.aggregate(rounds, step, lambda a, d: F.transform(a, lambda x, i: x.bitwiseXOR(F.coalesce(F.get(a, i - d), F.lit(0).cast("long")))))
    return F.struct(place.alias("place"), xor(place).alias("places"), less.alias("less"), n.alias("n"))


def _keys(v: str) -> Column:
    n = F.col(f"{v}.n")
    # a shared first half leaves the edit to the places after it, a shared last half to those before it
    may = lambda i: (i >= F.col("_from")) | (i < F.col("_to"))
    swap = F.transform(F.col(f"{v}.place"), lambda p, i: F.when(may(i), F.xxhash64(n, i, p.bitwiseXOR(F.col(f"{v}.places")))))
    drop = F.transform(F.col(f"{v}.less"), lambda x, i: F.when(may(i), F.xxhash64(n - 1, F.lit(-1), x)))
    kinds = lambda keys, kind: F.transform(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())), lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind")))
    whole = F.array(F.xxhash64(n, F.lit(-1), F.col(f"{v}.places")))
    return F.concat(kinds(swap, SWAP), kinds(whole, WHOLE), kinds(drop, DROP))


def near_lines(docs: DataFrame, index: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Places ``_at`` of the distinct lines within one word edit of an earlier distinct line."""
    half = index.select("_h1", "_h2", "_at", "_n", F.explode("_halves").alias("_half")).select("_h1", "_h2", "_at", "_n", "_half.*")
    shared = half.groupBy("key").agg(F.min("_h1").alias("_a"), F.max("_h1").alias("_b")).where("_a <> _b").select("key")
    some = half.join(small(land(shared), BROADCAST_KEYS), "key").groupBy("_h1", "_h2").agg(
        F.min("_at").alias("_at"), F.first("_n").alias("_n"),
        F.coalesce(F.min(F.when(F.col("left"), F.col("size"))), F.first("_n")).alias("_from"),
        F.coalesce(F.max(F.when(~F.col("left"), F.col("_n") - F.col("size"))), F.lit(0)).alias("_to"))
    # a document's own lines: at most as many as its text has
    wanted = some.groupBy("_at._doc").agg(F.collect_list(F.struct(F.col("_at._no").alias("_no"), "_from", "_to")).alias("_want"))
    at = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(small(land(wanted), BROADCAST_KEYS, F.size("_want")), "_doc")
    wanted = with_lines("_text", lambda lines: F.transform("_want", lambda w: F.struct(w.alias("_w"), F.get(lines, w["_no"]).alias("_raw"))))
    # rows that share an id differ in their lines: a place beyond a row's last line is another row's
    at = at.select("_doc", F.explode(wanted).alias("_x")).where("_x._raw is not null")
    some = land(at.select(F.struct("_doc", "_x._w._no").alias("_at"), "_x._w._from", "_x._w._to", one_spaced("_x._raw").alias("_line"))
                .groupBy("_at").agg(*[F.first(c).alias(c) for c in ("_from", "_to", "_line")]).withColumn("_n", n_words(F.col("_line"))))
    keyed = some.withColumn("_wh", F.transform(F.split("_line", " "), lambda w: F.xxhash64(w)))
    keyed = keyed.withColumn("_v", _variant_keys(F.col("_n"), F.col("_wh"))).select(
        "_at", F.explode(_keys("_v")).alias("_k")).select("_at", "_k.key", "_k.kind")
    # a variant meets lines that hold it by replacing the same word, or as a whole against one with a word more
    at = lambda c: F.min(F.when(c, F.col("_at")))
    holder = keyed.groupBy("key").agg(at(F.col("kind") != DROP).alias("_held"), at(F.col("kind") == DROP).alias("_longer"),
                                      F.count("*").alias("_c")).where("_c > 1").drop("_c")
    early = F.when(F.col("kind") == WHOLE, F.col("_longer")).otherwise(F.col("_held"))
    pairs = keyed.join(holder, "key").select("_at", early.alias("_early")).where(F.col("_early") < F.col("_at")).distinct()
    words = some.select("_at", "_line")
    both = pairs.join(words, "_at").join(words.select(F.col("_at").alias("_early"), F.col("_line").alias("_eline")), "_early")
    return both.where(within_one_edit(F.split("_eline", " "), F.split("_line", " "))).select("_at").distinct()


def within_one_edit(a: Column, b: Column) -> Column:
    """True if the word lists differ by at most one inserted, deleted or replaced word."""
    n, m = F.size(a), F.size(b)
    long_, short = F.greatest(n, m), F.least(n, m)
    head = F.coalesce(F.array_min(F.filter(F.transform(a, lambda w, i: F.when(w.eqNullSafe(F.get(b, i)), None).otherwise(i)), lambda i: i.isNotNull())), n)
    rest = lambda x, size: F.slice(x, head + 2, F.greatest(size - head - 1, F.lit(0)))  # noqa: E731 - after one skipped word
    whole = lambda x, size: F.slice(x, head + 1, F.greatest(size - head, F.lit(0)))
    return (long_ - short <= 1) & F.when(n == m, rest(a, n) == rest(b, m)).when(n > m, rest(a, n) == whole(b, m)).otherwise(
        whole(a, n) == rest(b, m))


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Places (``_doc``, ``_no``) of the removed lines."""
    halves = F.when(F.col("_n") >= min_words, _halves(F.col("_n"), F.col("_line")))
    index = land(lines_of(docs, doc_id, text).withColumn("_n", n_words(F.col("_line"))).select(
        F.struct("_doc", "_no").alias("_at"), F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(17), "_line").alias("_h2"), "_n", halves.alias("_halves")))
    place = index.select("_h1", "_h2", "_at")
    first = place.groupBy("_h1", "_h2").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    again = first.where(F.col("_first") != F.col("_last")).select("_h1", "_h2", "_first")
    copies = place.join(small(land(again), BROADCAST_KEYS), ["_h1", "_h2"]).where(F.col("_at") != F.col("_first")).select("_at")
    near = near_lines(docs, index, doc_id, text)
    return copies.unionByName(near).select("_at._doc", "_at._no")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut from the text and ``n_lines_removed`` added."""
    # a document's own line numbers: at most as many as its text has lines
    gone = removed_lines(docs, min_words, doc_id, text).groupBy(F.col("_doc").alias("_gone_doc")).agg(
        F.array_sort(F.collect_set("_no")).alias("_gone"))
    d = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    d = d.join(gone, F.col("_id") == F.col("_gone_doc"), "left")
    keep = with_lines("_text", lambda lines: without(lines, F.col("_gone")))
    new = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(keep, "\n"))
    kept = [(new if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns if c != "n_lines_removed"]
    return d.select(*kept, F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_lines_removed"))
