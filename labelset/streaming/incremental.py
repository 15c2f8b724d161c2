"""Incremental scoring of result records that keep landing (X2).

Records arrive as JSON-lines files ``{"pos": ..., "record": "<record JSON text>"}``. Two
streaming queries share the work:

* **ingest** (``foreachBatch``): parses a batch's records, canonicalises the names that no earlier batch
  had (the map of distinct names met so far is kept as a table) and lands one row per seen
  key and one per predicted item of the batch (distinct within it, so a hot key leaves at
  most one row per universe item);
* **score** (keyed state in the state store): reads the landed rows, drops the items a key
  already has (streaming deduplication on key and item), tags the others with the gold
  table and keeps TP, FP and the first raw spelling per key in a streaming aggregation.
  In update mode a batch emits exactly the keys it touched, with their new counts; FN and TN
  follow from the gold and universe sizes.

A batch reads its own rows, the name map, the gold rows it joins and the state of its own keys;
no earlier batch's records, items or scores are read again. State lives in RocksDB (spills to disk, changelog in the checkpoint), so
it may exceed memory. Both queries restart from their checkpoints: a landed batch replaces its
own folder when it is replayed, the state store rolls back to the batch's version, and the
emitted rows of a batch replace that batch's partition. Order does not matter: the state holds sets,
and the first spelling is the one with the smallest position.

``current_scores`` is the latest row per key; ``compact_scores`` folds the emitted batches
into one snapshot and ``current_scores`` then reads that and the later batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelset.functions.text import normalize_text_df
from labelset.operators import metrics as M
from labelset.operators.match import ALIAS_RULES, canonicalize
from labelset.plans.scoring import GROUPS, KEYS, record_rows
from labelset.session import cut_lineage, land_table
from labelset.sources.json_docs import existing_paths

RECORD_SCHEMA = "pos long, record string"
LANDED_SCHEMA = "source string, model string, sid_norm string, sid_raw string, pos long, item string"
NAMES_SCHEMA = "name string, canon string, listed boolean"
SCORED_SCHEMA = ("source string, model string, sid_norm string, sid_raw string, tp long, fp long, fn long, "
                 "tn long, skipped boolean, batch_id long")
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _paths(base: str) -> dict[str, str]:
    b = base.rstrip("/")
    return {"landed": f"{b}/landed", "names": f"{b}/names", "out": f"{b}/out/per_key", "snapshot": f"{b}/out/snapshot",
            "ingest_checkpoint": f"{b}/_checkpoint/ingest", "score_checkpoint": f"{b}/_checkpoint/score"}


def _replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """The batch's own folder: a replayed batch replaces its rows."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


# --- ingest ----------------------------------------------------------------------------------
def land_batch(rows: DataFrame, batch_id: int, base: str, universe: DataFrame,
               rules=ALIAS_RULES, string_method: str = "ratio") -> None:
    """Seen keys (``item`` NULL, first raw spelling) and distinct predicted items of one batch of parsed records."""
    # they feed the keys and the names: parse them once
    rows = cut_lineage(rows)
    # records without a key stand under the empty one, which no gold has: their model stays known
    seen = rows.groupBy(*KEYS).agg(F.min_by("sid_raw", "pos").alias("sid_raw"), F.min("pos").alias("pos"))
    keyed = rows.filter(F.col("sid_norm") != "")
    names = normalize_text_df(keyed.select(*KEYS, F.explode("names").alias("raw_name")),
                              "raw_name", "name").select(*KEYS, "name").distinct()
    kept = _name_map(names.select("name"), batch_id, base, universe, rules, string_method)
    items = names.join(kept, "name").select(*KEYS, F.col("canon").alias("item")).distinct()
    out = (seen.withColumn("item", F.lit(None).cast("string"))
           .unionByName(items, allowMissingColumns=True))
    _replace_batch(out.select(*KEYS, "sid_raw", "pos", "item"), _paths(base)["landed"], batch_id)


def _name_map(names: DataFrame, batch_id: int, base: str, universe: DataFrame, rules, string_method: str) -> DataFrame:
    """``(name, canon)`` of the names whose canonical form is in the universe, those of this batch included."""
    spark, path = names.sparkSession, _paths(base)["names"]
    earlier = [f"{path}/batch_id={b}" for b in _batches(spark, path) if b < batch_id]  # a replayed batch starts from the same map
    known = spark.read.schema(NAMES_SCHEMA).parquet(*earlier) if earlier else spark.createDataFrame([], NAMES_SCHEMA)
    new = cut_lineage(names.distinct().join(known, "name", "left_anti"))
    if not new.isEmpty():
        cmap = canonicalize(new, universe, "name", "norm", rules=rules, string_method=string_method).select("name", "canon")
        inside = universe.select(F.col("norm").alias("canon"), F.lit(True).alias("listed")).distinct()
        _replace_batch(cmap.join(inside, "canon", "left").select("name", "canon", F.coalesce("listed", F.lit(False)).alias("listed")), path, batch_id)
        known = known.unionByName(spark.read.schema(NAMES_SCHEMA).parquet(f"{path}/batch_id={batch_id}"))
    return known.filter("listed").select("name", "canon")


def ingest_stream(spark: SparkSession, source_dir: str, base: str, universe: DataFrame,
                  source: str = "stream", rules=ALIAS_RULES, string_method: str = "ratio",
                  max_files_per_trigger: int = 1, available_now: bool = True) -> StreamingQuery:
    """Start landing the JSON-lines files of ``source_dir``."""
    stream = (spark.readStream.schema(RECORD_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger).json(source_dir))
    parsed = record_rows(stream.select(F.lit(source).alias("_source_file"), "pos", "record"))

    def each(batch: DataFrame, batch_id: int) -> None:
        land_batch(batch, batch_id, base, universe, rules, string_method)

    return _start(parsed.writeStream.foreachBatch(each), _paths(base)["ingest_checkpoint"], available_now)


# --- score -----------------------------------------------------------------------------------
def keyed_counts(landed: DataFrame, gold: DataFrame) -> DataFrame:
    """Running ``tp``, ``fp`` and first raw spelling per key of a stream of landed rows.

    ``gold``: distinct ``(sid_norm, item)``; every batch joins it. Two keyed states: the items each key has (deduplication), and the counts (aggregation).
    """
    pairs = gold.select("sid_norm", "item").withColumn("hit", F.lit(True))
    fresh = landed.filter(F.col("item").isNotNull()).dropDuplicates([*KEYS, "item"])
    tagged = fresh.join(pairs, ["sid_norm", "item"], "left").select(
        *KEYS, F.lit(None).cast("string").alias("sid_raw"), F.lit(None).cast("long").alias("pos"),
        F.coalesce("hit", F.lit(False)).alias("hit"))
    seen = landed.filter(F.col("item").isNull()).select(*KEYS, "sid_raw", "pos", F.lit(None).cast("boolean").alias("hit"))
    return tagged.unionByName(seen).groupBy(*KEYS).agg(
        F.min_by("sid_raw", "pos").alias("sid_raw"), F.count_if(F.col("hit")).alias("tp"),
        F.count_if(~F.col("hit")).alias("fp"))


def with_misses(counts: DataFrame, sizes: DataFrame, universe_size: int) -> DataFrame:
    """``fn`` and ``tn`` from the number of gold items of a key (``sizes``: ``sid_norm, _gold``); keys without any are ``skipped``."""
    rows = counts.join(sizes, "sid_norm", "left")
    fn = F.coalesce("_gold", F.lit(0)) - F.col("tp")
    rows = rows.withColumn("fn", fn).withColumn("skipped", F.col("_gold").isNull())
    return rows.withColumn("tn", F.greatest(F.lit(universe_size) - F.col("tp") - F.col("fp") - F.col("fn"), F.lit(0)).cast("long"))


def score_stream(spark: SparkSession, base: str, universe: DataFrame, gold: DataFrame,
                 max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Start scoring the landed rows; every batch emits the keys it touched."""
    p = _paths(base)
    stream = spark.readStream.schema(LANDED_SCHEMA)
    if max_files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", max_files_per_trigger)
    landed = stream.parquet(f"{p['landed']}/*")
    size = universe.agg(F.count_distinct("norm")).first()[0]
    # every batch reads the distinct gold and the sizes of its keys: make them once
    gold = M.in_universe(gold.select("sid_norm", "item"), universe, "item", "norm").filter(F.col("sid_norm") != "")
    gold = land_table(gold.distinct())
    sizes = land_table(gold.groupBy("sid_norm").agg(F.count_distinct("item").alias("_gold")))

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = with_misses(batch, sizes, size)
        _replace_batch(rows.select(*KEYS, "sid_raw", "tp", "fp", "fn", "tn", "skipped"), p["out"], batch_id)

    writer = keyed_counts(landed, gold).writeStream.outputMode("update").foreachBatch(each)
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():  # a query keeps the settings it starts with
        spark.conf.set(k, v)
    try:
        return _start(writer, p["score_checkpoint"], available_now)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = writer.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def evaluate_stream(spark: SparkSession, source_dir: str, base: str, universe: DataFrame,
                    gold: DataFrame, source: str = "stream", rules=ALIAS_RULES,
                    string_method: str = "ratio", max_files_per_trigger: int = 1,
                    max_landed_files: int | None = None) -> None:
    """Score everything that has landed in ``source_dir`` since the last call, and return.

    Files that land later are scored by the next call, which goes on from the checkpoints. For an
    endless run start :func:`ingest_stream` and :func:`score_stream` with ``available_now=False``.
    """
    # every batch reads gold and universe: compute them once
    universe, gold = cut_lineage(universe), cut_lineage(gold)
    ingest_stream(spark, source_dir, base, universe, source, rules, string_method, max_files_per_trigger).awaitTermination()
    if existing_paths(spark, [_paths(base)["landed"]]):
        score_stream(spark, base, universe, gold, max_landed_files).awaitTermination()


# --- results ---------------------------------------------------------------------------------
def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished batches in a folder."""
    if not existing_paths(spark, [path]):
        return []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(f.getPath().getName(), f.getPath()) for f in fs.listStatus(folder)]
    return sorted(int(n.split("=", 1)[1]) for n, q in found if n.startswith("batch_id=") and fs.exists(hadoop.Path(q, "_SUCCESS")))


def _emitted(spark: SparkSession, base: str) -> DataFrame:
    """Rows of the newest snapshot and of the batches behind it, with their batch."""
    p = _paths(base)
    snaps = _batches(spark, p["snapshot"])[-1:]
    later = [b for b in _batches(spark, p["out"]) if not snaps or b > snaps[0]]
    paths = [f"{p['snapshot']}/batch_id={b}" for b in snaps] + [f"{p['out']}/batch_id={b}" for b in later]
    if not paths:
        return spark.createDataFrame([], SCORED_SCHEMA)
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch_id=(\d+)/[^/]*$", 1).cast("long")
    return spark.read.schema(SCORED_SCHEMA.rsplit(",", 1)[0]).parquet(*paths).select("*", batch.alias("batch_id"))


def _latest(spark: SparkSession, base: str) -> DataFrame:
    rows = _emitted(spark, base)
    values = [c for c in rows.columns if c not in KEYS]
    last = rows.groupBy(*KEYS).agg(F.max_by(F.struct(*values), "batch_id").alias("_last"))
    return last.select(*KEYS, "_last.*")


def compact_scores(spark: SparkSession, base: str) -> int | None:
    """Fold the emitted batches into one snapshot, named after the last of them; that number."""
    p = _paths(base)
    done = _batches(spark, p["out"])
    if not done or done[-1:] == _batches(spark, p["snapshot"])[-1:]:
        return done[-1] if done else None
    _replace_batch(_latest(spark, base).drop("batch_id"), p["snapshot"], done[-1])
    return done[-1]


def current_scores(spark: SparkSession, base: str) -> DataFrame:
    """Metrics of every evaluated key after the last batch."""
    rows = _latest(spark, base).filter(~F.col("skipped")).drop("skipped", "batch_id")
    return M.set_metrics(rows.select(*KEYS, "sid_raw", *M.COUNT_COLS))


def current_macro(spark: SparkSession, base: str) -> DataFrame:
    """Macro averages of every (source, model) seen so far; 0.0 where no key is evaluated."""
    groups = _latest(spark, base).select(*GROUPS).distinct()
    return M.macro_average(current_scores(spark, base), list(GROUPS), groups)
