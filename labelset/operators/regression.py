"""Group-wise regression of one measure on another, plus an overall row.

One ``rollup`` pass computes every group and the total together (grouping sets), with
partial aggregation before the shuffle; no per-group collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERALL = "_overall_"


def is_finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def regression_summary(df: DataFrame, x: str, y: str, label: str,
                       overall: str = OVERALL) -> DataFrame:
    """``(label, n, corr, slope, intercept)`` of ``y`` on ``x`` per label and overall.

    * rows with a missing (NULL or NaN) ``x`` or ``y`` are dropped first;
    * ``n`` is the group size after that, before the finite filter;
    * the fit uses finite pairs only; fewer than two -> NULL corr, slope, intercept;
    * a constant ``x`` (or ``y`` for corr) -> NULL instead of a division by zero;
    * rows whose label is NULL count in the overall row only.
    """
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    present = df.filter(xc.isNotNull() & yc.isNotNull() & ~F.isnan(xc) & ~F.isnan(yc))
    fin = is_finite(xc) & is_finite(yc)
    xf, yf = F.when(fin, xc), F.when(fin, yc)
    g = (present.rollup(label)
         .agg(F.count(F.lit(1)).alias("n"), F.count(xf).alias("_nf"),
              F.covar_pop(xf, yf).alias("_cov"), F.stddev_pop(xf).alias("_sx"),
              F.stddev_pop(yf).alias("_sy"),
              F.regr_slope(yf, xf).alias("slope"), F.regr_intercept(yf, xf).alias("intercept"),
              F.grouping(label).alias("_gid")))
    g = g.filter((F.col("_gid") == 1) | F.col(label).isNotNull())
    enough = F.col("_nf") >= 2
    corr = F.when(enough, F.col("_cov") / F.nullif(F.col("_sx") * F.col("_sy"), F.lit(0.0)))
    return g.select(
        F.when(F.col("_gid") == 1, F.lit(overall)).otherwise(F.col(label).cast("string")).alias(label),
        F.col("n").cast("long").alias("n"),
        corr.alias("corr"),
        F.when(enough, F.col("slope")).alias("slope"),
        F.when(enough, F.col("intercept")).alias("intercept"))
