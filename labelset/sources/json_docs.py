"""Readers for JSON documents: lenient documents, result records, gold, universe, reports.

Whole documents are read with ``spark.read.text(wholetext=True)`` (one row per file,
files split across tasks); everything after that is column expressions. Top-level
structure is parsed with ``from_json`` into ``array<string>`` / ``map<string,string>``,
which keeps document order and duplicate keys; values keep their raw JSON text until a
typed parse is needed.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelset.functions import replies as RP
from labelset.functions.text import expand_universe, normalize_text_df, repair_trailing_commas, strip_ws
from labelset.session import scratch_path


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths that exist (a missing file is skipped, not an error)."""
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # noqa: BLE001 - no JVM handle: local paths only
        import glob
        import os

        return [p for p in paths if (glob.glob(p) if any(c in p for c in "*?[") else os.path.exists(p))]
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if any(ch in p for ch in "*?[{"):
            found = fs.globStatus(path)
            if found is not None and len(found) > 0:
                out.append(p)
        elif fs.exists(path):
            out.append(p)
    return out


def _json_ok(t: Column) -> Column:
    """True when the text is a whole JSON value Spark can parse."""
    return (F.try_parse_json(t).isNotNull()
            | F.from_json(t, "array<string>", RP.STRICT_JSON).isNotNull()
            | F.from_json(t, "map<string,string>", RP.STRICT_JSON).isNotNull())


def lenient_text(raw: Column) -> Column:
    """The text if it parses; else the text without trailing commas if that parses;
    else NULL. Undecodable bytes (U+FFFD after decoding) are dropped."""
    t = F.regexp_replace(raw, "\\x{FFFD}", "")
    rep = repair_trailing_commas(t)
    return F.when(_json_ok(t), t).when(_json_ok(rep), rep)


# --- S1 --------------------------------------------------------------------------------------
def read_json_lenient(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``(path, file_name, text)`` per existing file; ``text`` NULL when unparsable."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    paths = existing_paths(spark, paths)
    if not paths:
        return spark.createDataFrame([], "path string, file_name string, text string")
    df = spark.read.text(paths, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_name").alias("file_name"),
                     lenient_text(F.col("value")).alias("text"))


# --- S2 / S3 -------------------------------------------------------------------------------------
def record_texts(text: Column) -> Column:
    """Raw texts of the records of a results document: a bare array, or the list under
    ``results`` of an object; anything else -> empty."""
    t = strip_ws(text)
    as_list = F.when(t.startswith("["), F.from_json(t, "array<string>", RP.STRICT_JSON))
    obj = F.when(t.startswith("{"), F.from_json(t, "map<string,string>", RP.STRICT_JSON))
    res = F.try_element_at(obj, F.lit("results"))
    under = F.when(strip_ws(res).startswith("["), F.from_json(res, "array<string>", RP.STRICT_JSON))
    return F.coalesce(as_list, under, F.array().cast("array<string>"))


def _layout(spark: SparkSession, path: str) -> str:
    """``documents``, ``lines`` or ``parquet``, by the name of a file or of a folder's files."""
    def of(name: str) -> str | None:
        n = name.lower()
        return "parquet" if n.endswith(".parquet") else "lines" if n.endswith((".jsonl", ".ndjson")) else None

    if (own := of(path.rstrip("/"))) is not None or any(c in path for c in "*?[{"):
        return own or "documents"
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.getFileStatus(folder).isDirectory() else []
    except Exception:  # noqa: BLE001 - no JVM handle: local folders only
        import os

        names = os.listdir(path) if os.path.isdir(path) else []
    kinds = {of(n) for n in names} - {None}
    # a folder written by a Spark job holds one record a line
    return kinds.pop() if len(kinds) == 1 else "lines" if any(n == "_SUCCESS" or n.startswith("part-") for n in names) else "documents"


def read_results(spark: SparkSession, paths: Sequence[str] | str, layout: str | None = None,
                 split_bytes: int | None = None) -> DataFrame:
    """One row per record object: ``(_source_file, pos, record)`` with ``record`` the raw
    JSON text and ``_source_file`` the full path (the given one for folders of lines or
    Parquet, as ``write_results`` leaves them). Non-object elements are skipped. Missing
    files are skipped. ``layout`` (``documents``, ``lines``, ``parquet``) overrides the
    choice by name; several files are united by column name. Documents longer than
    ``split_bytes`` (by default the session's ``spark.sql.files.maxPartitionBytes``) are read in
    parts by many tasks, with the same rows (:mod:`labelset.sources.json_split`).
    """
    paths = existing_paths(spark, [paths] if isinstance(paths, str) else list(paths))
    kinds = {p: layout or _layout(spark, p) for p in paths}
    whole, large = _by_length(spark, [p for p in paths if kinds[p] == "documents"], split_bytes)
    out = _whole_records(spark, whole)
    if large:
        from labelset.sources.json_split import split_results

        parts, left = split_results(spark, large)
        # one path a document, bounded by the given ones
        rest = _whole_records(spark, [r["file"] for r in left.collect()])
        out = out.unionByName(parts).unionByName(rest)
    lines = [p for p in paths if kinds[p] == "lines"]
    if lines:
        out = out.unionByName(_line_records(spark, lines))
    for p in paths:
        if kinds[p] == "parquet":
            rows = spark.read.parquet(p).select(F.to_json(F.struct("*")).alias("record"))
            out = out.unionByName(rows.select(F.lit(p).alias("_source_file"), F.monotonically_increasing_id().alias("pos"), "record"))
    return out.filter(strip_ws(F.col("record")).startswith("{"))


def _line_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Records of files and folders of lines in one scan, however many there are and whatever fields they have.

    ``_source_file`` is the given path that holds the file; a wildcard's files keep their own paths.
    """
    def plain(c: Column) -> Column:
        return F.regexp_replace(c, "^file:/+", "/")

    given = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "given string").select(
        "given", F.regexp_replace(plain(F.col("given")), "/+$", "").alias("_at"))
    file = F.col("_metadata.file_path")
    rows = spark.read.text(list(dict.fromkeys(paths))).select(file.alias("_file"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("record"))
    # the source names files as URIs
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace("_file", r"\+", "%2B")), F.col("_file"))
    rows = rows.withColumn("_own", plain(decoded)).withColumn("_folder", F.regexp_replace("_own", "/[^/]*$", ""))
    by_folder = rows.join(F.broadcast(given), F.col("_folder") == F.col("_at"), "left")  # one row a given path
    by_file = given.select(F.col("given").alias("_given_file"), F.col("_at").alias("_at_file"))
    found = by_folder.join(F.broadcast(by_file), F.col("_own") == F.col("_at_file"), "left")
    return found.select(F.coalesce("_given_file", "given", "_file").alias("_source_file"), "pos", "record")


def _whole_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    docs = read_json_lenient(spark, paths)
    out = docs.select(F.col("path").alias("_source_file"),
                      F.posexplode(record_texts(F.col("text"))).alias("pos", "record"))
    return out.withColumn("pos", F.col("pos").cast("long"))


_PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")


def _by_length(spark: SparkSession, paths: Sequence[str], most: int | None) -> tuple[list[str], list[str]]:
    """Paths of documents to read whole, and files longer than ``most`` bytes that can be cut."""
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    except Exception:  # noqa: BLE001 - no JVM handle: lengths are not known
        return list(paths), []
    if most is None:
        most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    whole, large = [], []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        found = list(fs.globStatus(path) or [])
        files = [f for s in found for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
        long = [f.getPath().toString() for f in files if f.isFile() and f.getLen() > most and not f.getPath().getName().endswith(_PACKED)]
        if not long:
            whole.append(p)
            continue
        large += long
        whole += [q for q in (f.getPath().toString() for f in files if f.isFile() and not f.getPath().getName().startswith(("_", "."))) if q not in long]
    return whole, large


read_runs = read_results


def record_field(record: Column, key: str) -> Column:
    """Value of a top-level key of a record text as a variant (last duplicate wins)."""
    return RP.entry_last(F.from_json(record, "map<string,variant>", RP.STRICT_JSON), key)


def record_raw(record: Column, key: str) -> Column:
    """Raw JSON text of a top-level key of a record (document order kept)."""
    m = F.from_json(record, "map<string,string>", RP.STRICT_JSON)
    return F.try_element_at(F.filter(F.map_entries(m), lambda e: e["key"] == F.lit(key)),
                            F.lit(-1))["value"]


def results_table(records: DataFrame) -> DataFrame:
    """Typed view of result records (missing fields NULL)."""
    r = F.col("record")

    def s(k):
        v = record_field(r, k)
        return F.when(RP.kind(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def num(k, t):
        v = record_field(r, k)
        return F.when(RP.kind(v).isin("NUMBER", "STRING"), F.try_variant_get(v, "$", t))

    return records.select(
        "_source_file", "pos", "record",
        s("request_id").alias("request_id"), s("scenario_id").alias("scenario_id"),
        s("model").alias("model"), s("condition").alias("condition"),
        s("prompt_hash").alias("prompt_hash"),
        num("latency_s", "double").alias("latency_s"),
        num("prompt_tokens", "double").alias("prompt_tokens"),
        num("completion_tokens", "double").alias("completion_tokens"),
        num("total_tokens", "double").alias("total_tokens"),
        s("output").alias("output"),
        F.try_variant_get(record_field(r, "valid"), "$", "boolean").alias("valid"),
        s("error").alias("error"))


# --- S6 --------------------------------------------------------------------------------------
def _gold_list(value: Column) -> Column:
    """Names of a gold member ``[ {kpi|nome|metric|name}, ... ] | [str, ...]``; empty when it is no list; a
    non-string name gives ""."""
    def one(x):
        obj = RP.parse_object(x["raw"])
        v = RP.first_truthy([RP.get_ci(obj, k) for k in RP.NAME_KEYS])
        from_obj = F.when(RP.kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
        return F.coalesce(F.when(x["kind"] == "OBJECT", from_obj).when(x["kind"] == "STRING", x["raw"]), F.lit(""))

    elems = RP.json_array_elements(value)
    return F.transform(F.coalesce(elems, F.array().cast("array<struct<raw:string,kind:string>>")), one)


#: A gold document longer than this is read in parts: as one row it is held beside all its parsed entries.
GOLD_SPLIT_BYTES = 8 << 20


def _gold_members(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """``(path, at, key, value)`` of the members of the gold documents."""
    def whole(paths):
        docs = read_json_lenient(spark, paths)
        entries = F.map_entries(F.from_json(strip_ws(F.col("text")), "map<string,string>", RP.STRICT_JSON))
        return docs.select("path", F.posexplode(entries).alias("at", "_e")).select("path", F.col("at").cast("long").alias("at"), "_e.key", "_e.value")

    small, large = _by_length(spark, existing_paths(spark, [path]), split_bytes)
    out = whole(small)
    if large:
        from labelset.sources.json_split import split_members

        parts, left = split_members(spark, large)
        out = out.unionByName(parts)
        # one path a document, bounded by the given ones
        if rest := [r["file"] for r in left.collect()]:
            out = out.unionByName(whole(rest))
    return out


def read_gold(spark: SparkSession, path: str, universe: DataFrame, canon=None, split_bytes: int = GOLD_SPLIT_BYTES) -> DataFrame:
    """Long gold ``(sid_norm, sid_raw, item)``: names normalised and canonicalised, only
    items in the universe kept (a scenario without any vanishes). Documents longer than ``split_bytes`` are
    read in parts by many tasks, with the same rows."""
    from labelset.operators.match import canonicalize

    members = _gold_members(spark, path, split_bytes).select(F.col("key").alias("sid_raw"), "at", "value")
    rows = normalize_text_df(members, "sid_raw", "sid_norm").select("sid_raw", "sid_norm", "at", F.explode(_gold_list(F.col("value"))).alias("raw"))
    # the rows are read for the last lists, the names and the items: parse and land them once
    landed = scratch_path(spark, f"gold-{uuid.uuid4().hex}")
    normalize_text_df(rows, "raw", "name").select("sid_raw", "sid_norm", "at", "name").write.parquet(landed)
    rows = spark.read.parquet(landed)
    # of several keys with one normal form the last non-empty list holds
    last = rows.groupBy("sid_norm").agg(F.max("at").alias("at"))
    rows = rows.join(last, ["sid_norm", "at"])
    cmap = canon if canon is not None else canonicalize(rows.select("name"), universe, "name", "norm")
    items = rows.join(cmap.select("name", "canon"), "name").select(
        "sid_norm", "sid_raw", F.col("canon").alias("item"))
    items = items.join(universe.select(F.col("norm").alias("item")), "item", "left_semi")
    return items.distinct()


# --- S7 --------------------------------------------------------------------------------------
def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of names -> ``(norm, canon, tokens)``; not a list -> empty."""
    docs = read_json_lenient(spark, path)
    t = strip_ws(F.col("text"))
    raws = F.when(t.startswith("["), F.from_json(t, "array<string>", RP.STRICT_JSON))
    names = docs.select(F.explode(raws).alias("name")).filter(F.col("name").isNotNull()).distinct()
    return expand_universe(names, "name")


# --- S8 --------------------------------------------------------------------------------------
REPORT_SCHEMA = ("model_name string, macro_avg struct<precision double, recall double, "
                 "f1 double, mcc double>")


def read_reports(spark: SparkSession, files_by_run: Mapping[str, str],
                 labels: Mapping[str, str], default_label: str) -> DataFrame:
    """Macro table: ``run, model_raw, model_label, macro_*``, ``source_file`` per report.

    Reports are read with an explicit schema (``by_scenario`` is not needed here).
    """
    paths = existing_paths(spark, list(files_by_run.values()))
    if not paths:
        return spark.createDataFrame([], "run string, model_raw string, model_label string, "
                                         "macro_precision double, macro_recall double, macro_f1 double, "
                                         "macro_mcc double, source_file string")
    df = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(paths)
    run_of = F.create_map(*[x for run, f in files_by_run.items()
                            for x in (F.lit(f.rsplit("/", 1)[-1]), F.lit(run))])
    return _macro_rows(df, F.try_element_at(run_of, F.col("_metadata.file_name")), labels, default_label)


def read_report_folder(spark: SparkSession, folder: str, labels: Mapping[str, str],
                       default_label: str) -> DataFrame:
    """The macro table of :func:`read_reports` over all documents that ``write_report_documents`` left in a
    folder; the run is the document's source."""
    df = spark.read.schema(REPORT_SCHEMA + ", file string").option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    return _macro_rows(df, F.col("file"), labels, default_label)


SCENARIO_SCHEMA = ("struct<TP: bigint, FP: bigint, FN: bigint, TN: bigint, precision: double, recall: double, f1: double, "
                   "denom: double, mcc: double, npv: double, fdr: double, pred: array<string>, gold: array<string>, sid_norm: string>")


def read_report_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Every scenario of the documents that ``write_report_documents`` left in a folder, by lines (so a long
    document is read by many tasks): ``source, model, sid_raw`` and the fields of a report entry."""
    df = spark.read.schema("value string, source string, model_slug string, model string").text(folder)
    entry = F.from_json(F.concat(F.lit("{"), F.regexp_replace("value", "^,", ""), F.lit("}")), f"map<string, {SCENARIO_SCHEMA}>", RP.STRICT_JSON)
    lines = df.filter(F.col("value").rlike(r'^,?".*\}$')).select("source", "model", F.explode(entry).alias("sid_raw", "_e"))
    return lines.select("source", "model", "sid_raw", "_e.*")


def _macro_rows(df: DataFrame, run: Column, labels: Mapping[str, str], default_label: str) -> DataFrame:
    from labelset.operators.records import map_label

    df = df.select(run.alias("run"), F.col("_metadata.file_name").alias("source_file"),
                   F.coalesce(F.col("model_name"), F.lit("")).alias("model_raw"),
                   F.col("macro_avg.precision").alias("macro_precision"),
                   F.col("macro_avg.recall").alias("macro_recall"),
                   F.col("macro_avg.f1").alias("macro_f1"),
                   F.col("macro_avg.mcc").alias("macro_mcc"))
    df = map_label(df, "model_raw", labels, out="model_label", default=default_label)
    return df.select("run", "model_raw", "model_label", "macro_precision", "macro_recall",
                     "macro_f1", "macro_mcc", "source_file")
