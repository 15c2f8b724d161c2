"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelset.session import scratch_path


def land(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read back: lineage ends there and lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, f"land-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(landed: DataFrame, most: int, size: Column | None = None) -> DataFrame:
    """A landed table, marked for broadcast if its rows (with ``size``, the sum of that over them) are at most ``most``; else it is shuffled."""
    n = landed.count() if size is None else landed.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(landed) if n <= most else landed
