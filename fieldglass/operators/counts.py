"""Counts, shares and deviations of a table or of its groups, each by one aggregate that combines on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import vocabulary as V


def threshold_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows at high risk, critical and elevated rows, and rows short of water; a missing value passes no threshold.

    In a table without a water index no row is short of water. An empty table gives one row of zeros, with ``by`` none.
    """
    score = F.col("risk_score")
    dry = F.col("ndwi") < V.WATER_STRESS_BELOW if "ndwi" in scored.columns else F.lit(False)
    return scored.groupBy(*by).agg(
        F.count_if(score >= V.HIGH_RISK_FROM).alias("high"),
        F.count_if(score >= V.FINDING_CRITICAL_FROM).alias("critical"),
        F.count_if((score >= V.FINDING_ELEVATED_FROM) & (score < V.FINDING_CRITICAL_FROM)).alias("elevated"),
        F.count_if(dry).alias("stressed"))


def distinct_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), error: float | None = None) -> DataFrame:
    """Distinct values of each column, missing ones left out; ``error`` allows a sketch of that relative deviation.

    Exact counts first reduce each task's rows to its distinct values, so a value that fills the table costs one row a task.
    """
    def count(c: str) -> Column:
        return F.countDistinct(f"`{c}`") if error is None else F.approx_count_distinct(f"`{c}`", error)

    return df.groupBy(*by).agg(*[count(c).alias(c) for c in columns])


def deviations(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Population and sample deviation of a column; the sample's is missing for fewer than two values."""
    return df.groupBy(*by).agg(F.stddev_pop(column).alias("population"), F.stddev_samp(column).alias("sample"))


def share_of_rows(df: DataFrame, condition: Column, by: Sequence[str] = (), out: str = "share") -> DataFrame:
    """Percent of the rows that meet a condition; a row for which it is unknown counts as one that does not."""
    return df.groupBy(*by).agg((F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100).alias(out))


def short_of_water(ndwi: str = "ndwi") -> Column:
    return F.col(ndwi) < V.WATER_STRESS_BELOW
