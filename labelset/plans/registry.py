"""Registry of the queries run on the driver tables, each with its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None  # None: rows-only check (not expressible in SQL)


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Doubles are compared at 6 decimals in both engines."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def round_cols(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def sql_metrics(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn",
                rounded: bool = True) -> str:
    """The seven metric formulas as DuckDB SQL (zero denominators -> 0.0)."""
    d = {k: f"CAST({v} AS DOUBLE)" for k, v in (("tp", tp), ("fp", fp), ("fn", fn), ("tn", tn))}
    tp, fp, fn, tn = d["tp"], d["fp"], d["fn"], d["tn"]
    prec = f"(CASE WHEN {tp}+{fp} > 0 THEN {tp}/({tp}+{fp}) ELSE 0.0 END)"
    rec = f"(CASE WHEN {tp}+{fn} > 0 THEN {tp}/({tp}+{fn}) ELSE 0.0 END)"
    f1 = f"(CASE WHEN {prec}+{rec} > 0 THEN 2.0*{prec}*{rec}/({prec}+{rec}) ELSE 0.0 END)"
    den = f"(({tp}+{fp})*({tp}+{fn})*({tn}+{fp})*({tn}+{fn}))"
    mcc = f"(CASE WHEN {den} > 0 THEN ({tp}*{tn}-{fp}*{fn})/sqrt({den}) ELSE 0.0 END)"
    npv = f"(CASE WHEN {tn}+{fn} > 0 THEN {tn}/({tn}+{fn}) ELSE 0.0 END)"
    fdr = f"(CASE WHEN {tp}+{fp} > 0 THEN {fp}/({tp}+{fp}) ELSE 0.0 END)"
    exprs = {"precision": prec, "recall": rec, "f1": f1, "denom": den, "mcc": mcc,
             "npv": npv, "fdr": fdr}
    if rounded:
        return ", ".join(f"round({e}, 6) AS {k}" for k, e in exprs.items())
    return ", ".join(f"{e} AS {k}" for k, e in exprs.items())
