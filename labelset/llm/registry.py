"""Queries of the corpus operators over the driver tables, each with its DuckDB SQL if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelset.plans.registry import Query

LLM_QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable:
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        LLM_QUERIES[name] = Query(name, fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
