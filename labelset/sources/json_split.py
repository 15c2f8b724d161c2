"""Splittable reader of large results documents.

``read_json_lenient`` takes a file as one row, hence one task. A results document is a list of
records, either bare or first under ``results``, so it can be read by byte ranges:

1. Spark's text source, with ``}`` as the line end, deals the file's blocks to tasks. A block does
   not know whether it starts inside a string or how deep. Each piece's quotes and
   bracket changes are therefore counted for both cases, summed within its block, and the
   blocks' sums (a few numbers each) are chained per file: a two-level prefix sum that
   settles the string state and depth of every piece without a pass over the whole file.
2. A piece that ends outside strings at the list's depth ends a record. Pieces are grouped by
   record, whichever blocks they lie in, and each group is parsed alone as a short list.
3. A document holds only if all its groups and its end do; else all of it is taken without
   trailing commas, and if that fails too it has no records. This is the rule of the
   whole-document reader, and the rows are the same: ``(_source_file, pos, record)``.

``split_members`` does the same for an object whose values are lists (the gold document): its pieces
end at ``]`` and its groups are members of the object.

No task holds more than a block, a record, or what follows the list of an object. Objects that do
not start with ``results`` are left to the whole-document reader.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelset.functions import replies as RP
from labelset.functions.text import repair_trailing_commas
from labelset.session import cut_lineage, scratch_path

BARE, UNDER, OTHER = 1, 2, 0  # shape of a document; for the first two the depth of the list
MEMBERS = 1  # depth of an object's members
_HEAD = {BARE: r"^\s*\[", UNDER: r'^\s*\{\s*"results"\s*:\s*\['}
_MEMBERS_HEAD = r"^\s*\{"
GROUPS_PER_PART = 1 << 16


def _pieces(spark: SparkSession, paths: Sequence[str], end: str = "}") -> DataFrame:
    """Landed ``file, block, ord, text, bytes, size``: text up to the next ``end`` (not with it), in file order by (block, ord)."""
    df = spark.read.option("lineSep", end).text(list(paths))
    path = scratch_path(spark, f"pieces-{uuid.uuid4().hex}")
    df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
              F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "\\x{FFFD}", "").alias("text"),
              F.octet_length("value").alias("bytes"), F.col("_metadata.file_size").alias("size")).write.parquet(path)
    return spark.read.parquet(path)


def _chained(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the file before: within the block, plus the blocks before.

    Only one row a block meets in one place.
    """
    inside = Window.partitionBy("file", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("file", "block").agg(F.sum(value).alias("_sum"))
    starts = sums.select("file", "block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(starts, ["file", "block"]).select(*rows.columns, (F.col("_local") + F.col("_start")).alias(name))


def _brackets(parts: Column, odd: int) -> Column:
    """The brackets in every second part of a text that was split at its quotes."""
    return F.regexp_replace(F.array_join(F.filter(parts, lambda x, i: i % 2 == odd), ""), r"[^\[\]{}]", "")


def _change(brackets: Column) -> Column:
    return 2 * F.length(F.regexp_replace(brackets, r"[\]}]", "")) - F.length(brackets)


def _located(pieces: DataFrame, end: str = "}") -> DataFrame:
    """``file, block, ord, brace, inside_after, brackets, depth, after`` of each piece: whether an ``end`` follows it, whether
    that is in a string, its brackets outside strings with the ``end``, and the depth before and after them."""
    p = pieces.select("file", "block", "ord", "bytes", "size", F.split(F.regexp_replace("text", r"\\.", ""), '"').alias("_parts"))
    p = p.select("file", "block", "ord", "bytes", "size", (F.size("_parts") - 1).alias("quotes"),
                 _brackets(F.col("_parts"), 0).alias("_out"), _brackets(F.col("_parts"), 1).alias("_in"))
    # the last piece of a file has its end if the bytes say so
    last = p.groupBy("file").agg(F.max(F.struct("block", "ord")).alias("_last"), (F.sum(F.col("bytes") + 1) - F.max("size")).alias("_over"))
    p = p.join(last, "file").withColumn("brace", (F.struct("block", "ord") != F.col("_last")) | (F.col("_over") == 0))
    p = cut_lineage(p.select("file", "block", "ord", "quotes", "_out", "_in", "brace"))
    p = _chained(p, F.col("quotes"), "_q")
    inside, after = F.col("_q") % 2 == 1, (F.col("_q") + F.col("quotes")) % 2 == 1
    brackets = F.concat(F.when(inside, F.col("_in")).otherwise(F.col("_out")), F.when(F.col("brace") & ~after, end).otherwise(""))
    p = cut_lineage(p.select("file", "block", "ord", "brace", after.alias("inside_after"), brackets.alias("brackets")))
    p = _chained(p, _change(F.col("brackets")), "depth")
    return p.withColumn("after", F.col("depth") + _change(F.col("brackets")))


def _closes(brackets: Column, depth: Column, shape: Column) -> Column:
    """Whether a closing bracket takes the depth below that of the list."""
    def step(s, b):
        d = s["d"] + F.when(b.isin("[", "{"), 1).otherwise(-1)
        return F.struct(d.alias("d"), (s["hit"] | (b.isin("]", "}") & (d == shape - 1))).alias("hit"))

    chars = F.filter(F.split(brackets, ""), lambda b: b != "")
    return F.aggregate(chars, F.struct(depth.cast("long").alias("d"), F.lit(False).alias("hit")), step)["hit"]


def _list_of(text: Column, shape: Column, first: Column, tail: Column) -> Column:
    """Elements of a group's part of the list; NULL if it is not well formed.

    The first group starts with the document's head, others with a comma, a last one without elements with
    the closing bracket. The last group is parsed with all that follows the list.
    """
    inner = F.when(first, F.when(shape == BARE, F.regexp_replace(text, _HEAD[BARE], "")).otherwise(F.regexp_replace(text, _HEAD[UNDER], "")))
    inner = inner.when(text.rlike(r"^\s*,\s*[^\s\],]"), F.regexp_replace(text, r"^\s*,", ""))
    inner = inner.when(tail & text.rlike(r"^\s*\]"), text)
    as_list = lambda t: F.from_json(t, "array<string>", RP.STRICT_JSON)
    object_list = F.try_element_at(F.from_json(F.concat(F.lit('{"results":['), inner), "map<string,string>", RP.STRICT_JSON), F.lit("results"))
    return (F.when(~tail, as_list(F.concat(F.lit("["), inner, F.lit("]"))))
            .when(shape == BARE, as_list(F.concat(F.lit("["), inner))).otherwise(as_list(object_list)))


def _groups(pieces: DataFrame, shapes: DataFrame, end: str = "}") -> DataFrame:
    """``file, shape, group, text, tail, ended``: the texts between the ends of elements, and what follows the last one."""
    p = _located(pieces, end).join(shapes.filter(F.col("shape") != OTHER), "file")
    p = cut_lineage(p.withColumn("closes", _closes(F.col("brackets"), F.col("depth"), F.col("shape"))))
    # the list ends in the first piece that closes it; what follows belongs to the last group
    close = p.filter("closes").groupBy("file").agg(F.min(F.struct("block", "ord")).alias("_close"))
    p = p.join(close, "file", "left")
    open_ = F.col("_close").isNull() | (F.struct("block", "ord") < F.col("_close"))
    ends = open_ & F.col("brace") & ~F.col("inside_after") & (F.col("after") == F.col("shape"))
    p = p.select("file", "block", "ord", "brace", "shape", ends.alias("ends"), (~open_).alias("tail"))
    p = _chained(cut_lineage(p), F.col("ends").cast("long"), "group")
    body = F.concat("text", F.when(F.col("brace"), end).otherwise(""))
    texts = p.join(pieces.select("file", "block", "ord", "text"), ["file", "block", "ord"])
    ordered = F.array_sort(F.collect_list(F.struct("block", "ord", body.alias("t"))))
    return texts.groupBy("file", "shape", "group").agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("text"), F.max("tail").alias("tail"), F.max("ends").alias("ended"))


def _placed(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """``file, items, _before`` of the groups of good documents (``docs``: ``file, _strict, ...``), ``_before`` the elements in front.

    Only the numbers of elements are sorted; the elements meet their place in a hash join.
    """
    at = [F.expr(f"group div {GROUPS_PER_PART}").alias("block"), F.col("group").alias("ord")]
    items = F.when(F.col("_strict"), F.col("strict")).otherwise(F.col("repaired"))
    good = groups.join(docs, "file").select("file", *at, items.alias("items"))
    before = _chained(good.select("file", "block", "ord", F.size("items").cast("long").alias("_n")), F.col("_n"), "_before")
    return good.join(before.select("file", "block", "ord", "_before").hint("shuffle_hash"), ["file", "block", "ord"])


def split_results(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(_source_file, pos, record)`` of the elements of the documents that can be read in parts, and the
    paths (``file``) of those that cannot."""
    pieces = _pieces(spark, paths)
    start = pieces.groupBy("file").agg(F.min_by("text", F.struct("block", "ord")).alias("_head"),
                                       (F.sum(F.col("bytes") + 1) < F.max("size")).alias("_marked"))
    # the text source drops a byte order mark, which the whole-document reader takes for broken
    shape = F.when(F.col("_marked"), OTHER).when(F.col("_head").rlike(_HEAD[BARE]), BARE).when(F.col("_head").rlike(_HEAD[UNDER]), UNDER).otherwise(OTHER)
    shapes = cut_lineage(start.select("file", shape.alias("shape")))
    groups = _groups(pieces, shapes)
    # after the last record of an unclosed list there is no further group, or one that nothing ends
    whole = F.col("tail") | F.col("ended")
    first = F.col("group") == 0
    groups = groups.select("file", "shape", "group", "tail", F.col("text").rlike(r'"results"\s*:').alias("_again"),
                           F.when(whole, _list_of(F.col("text"), F.col("shape"), first, F.col("tail"))).alias("strict"),
                           F.when(whole, _list_of(repair_trailing_commas(F.col("text")), F.col("shape"), first, F.col("tail"))).alias("repaired"))
    groups = cut_lineage(groups)
    again = (F.col("shape") == UNDER) & F.col("tail") & (F.col("group") > 0) & F.col("_again")  # a second list: not read in parts
    docs = groups.groupBy("file").agg(F.max("tail").alias("_tail"), F.max(again).alias("_twice"), F.bool_and(F.col("strict").isNotNull()).alias("_strict"),
                                      F.bool_and(F.col("repaired").isNotNull()).alias("_repaired"))
    # ``groups`` holds a closed document's tail, so an unclosed one is known by the lack of it
    placed = _placed(groups, docs.filter("_tail and not _twice and (_strict or _repaired)"))
    records = placed.select(F.col("file").alias("_source_file"), "_before", F.posexplode("items").alias("_at", "record"))
    records = records.select("_source_file", (F.col("_before") + F.col("_at")).alias("pos"), "record")
    left = shapes.filter(F.col("shape") == OTHER).select("file").unionByName(docs.filter("_twice").select("file"))
    return records, left


def _members_of(text: Column, first: Column, tail: Column) -> Column:
    """Entries of a group's part of the object; NULL if it is not well formed.

    The first group starts with the document's brace, others with a comma, a last one without members with the
    closing brace. The last group is parsed with all that follows the object.
    """
    inner = F.when(first, F.regexp_replace(text, _MEMBERS_HEAD, ""))
    inner = inner.when(text.rlike(r"^\s*,\s*[^\s\},]"), F.regexp_replace(text, r"^\s*,", ""))
    inner = inner.when(tail & text.rlike(r"^\s*\}"), text)
    return F.map_entries(F.from_json(F.concat(F.lit("{"), inner, F.when(tail, "").otherwise("}")), "map<string,string>", RP.STRICT_JSON))


def split_members(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(path, at, key, value)`` of the members of the objects in ``paths``, values as raw JSON, and the paths
    (``file``) of the documents that cannot be read in parts."""
    pieces = _pieces(spark, paths, "]")
    start = pieces.groupBy("file").agg(F.min_by("text", F.struct("block", "ord")).alias("_head"),
                                       (F.sum(F.col("bytes") + 1) < F.max("size")).alias("_marked"))
    shape = F.when(~F.col("_marked") & F.col("_head").rlike(_MEMBERS_HEAD), MEMBERS).otherwise(OTHER)
    shapes = cut_lineage(start.select("file", shape.alias("shape")))
    whole, first = F.col("tail") | F.col("ended"), F.col("group") == 0
    groups = cut_lineage(_groups(pieces, shapes, "]").select(
        "file", "group", "tail", F.when(whole, _members_of(F.col("text"), first, F.col("tail"))).alias("strict"),
        F.when(whole, _members_of(repair_trailing_commas(F.col("text")), first, F.col("tail"))).alias("repaired")))
    docs = groups.groupBy("file").agg(F.max("tail").alias("_tail"), F.bool_and(F.col("strict").isNotNull()).alias("_strict"),
                                      F.bool_and(F.col("repaired").isNotNull()).alias("_repaired"))
    placed = _placed(groups, docs.filter("_tail and (_strict or _repaired)"))
    members = placed.select(F.col("file").alias("path"), "_before", F.posexplode("items").alias("_at", "_e"))
    members = members.select("path", (F.col("_before") + F.col("_at")).alias("at"), "_e.key", "_e.value")
    return members, shapes.filter(F.col("shape") == OTHER).select("file")
