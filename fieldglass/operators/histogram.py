"""Distribution of one indicator: bins with deviation markers, and a kernel density."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.functions.scalar import sql_literal


def _extent(df: DataFrame, column: str):
    v = F.col(column).cast("double")
    return df.agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"),
                  F.stddev_samp(v).alias("std")).first()


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over the whole range: ``(bin, low, high, count, share, deviations)``.

    ``deviations`` is the bin's middle in sample standard deviations from the mean. Empty bins are left out.
    """
    at = _extent(df, column)
    if not at["n"]:
        raise ValueError(f"{column!r} has no values")
    low, width = at["low"], (at["high"] - at["low"]) / bins or 1.0
    v = F.col(column).cast("double")
    number = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    counted = df.where(v.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    middle = F.lit(low) + (F.col("bin") + 0.5) * width
    return counted.select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
        "count", (F.col("count") / at["n"]).alias("share"),
        F.try_divide(middle - at["mean"], F.nullif(F.lit(at["std"]).cast("double"), F.lit(0.0))).alias("deviations"),
    )


def density(df: DataFrame, column: str, grid: int = 32) -> DataFrame:
    """Gaussian kernel density on an even grid over the range: ``(point, x, density)``.

    Bandwidth by Scott's rule. Each grid point is one average in a single
    scan, so nothing is multiplied out.
    """
    at = _extent(df, column)
    if not at["n"] or not at["std"]:
        raise ValueError(f"{column!r} does not vary")
    width = at["std"] * at["n"] ** -0.2
    step = (at["high"] - at["low"]) / (grid - 1)
    points = [at["low"] + i * step for i in range(grid)]
    height = 1.0 / (width * sqrt(2 * pi))
    kernels = [f"avg(exp(pow((v - {sql_literal(x)}) / {sql_literal(width)}, 2) * -0.5D)) * {sql_literal(height)} AS d{i}"
               for i, x in enumerate(points)]
    row = df.select(F.col(column).cast("double").alias("v")).agg(*map(F.expr, kernels))
    cells = ", ".join(f"named_struct('point', {i}, 'x', {sql_literal(x)}, 'density', d{i})" for i, x in enumerate(points))
    return row.selectExpr(f"inline(array({cells}))")
