"""Session and lineage helpers.

The library never builds its own session inside a transform; callers pass one in.
``get_spark`` is a convenience for tests, the bench and scripts.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "labelset", cpus: int | str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local or cluster session with AQE on and the UI off.

    On a cluster ``master`` comes from spark-submit; ``cpus`` is only used when no
    master is configured (local runs).
    """
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("SPARK_MASTER") and cpus is not None:
        builder = builder.master(f"local[{cpus}]")
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if cpus is not None:  # local run: the executors live in the driver's heap
        conf["spark.driver.memory"] = "8g"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the setting is absent in local mode (tests) a fresh scratch folder is created;
    on a cluster a machine-local folder would be lost to the other machines, so that raises.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master if sc is not None else ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="labelset-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    The plan is persisted while the checkpoint is written: an eager reliable checkpoint of
    an unpersisted plan computes it twice (once to count, once to write the files). The
    persisted copy is dropped afterwards; the checkpoint files are the lineage cut.
    """
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


#: Shuffle files of a query go when it ends (else when the driver collects its garbage).
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made and run within leave no shuffle files."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def land_table(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back.

    Smaller than a checkpoint's row files, and the shuffle files of the write go at once, so several
    such steps take the disk of the largest of them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"land-{uuid.uuid4().hex}")
    with dropped_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, whatever folder the driver runs from.

    Local workers get its place on their path; on a cluster a zip of it is added once per
    application. Sessions without a local SparkContext are left to the cluster's setup.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    if sc.master.startswith("local[") or sc.master == "local":
        paths = [root, *filter(None, [sc.environment.get("PYTHONPATH")])]
        sc.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(os.pathsep.join(paths).split(os.pathsep)))
    elif sc.applicationId not in _shipped:
        zipped = os.path.join(tempfile.mkdtemp(prefix="labelset-pkg-"), "labelset.zip")
        with zipfile.ZipFile(zipped, "w") as z:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, root))
        sc.addPyFile(zipped)
        _shipped.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
