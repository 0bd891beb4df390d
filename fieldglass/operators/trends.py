"""Time buckets and what is derived from a series of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.operators.schema import candidate_features, is_numeric, resolve_fields

UNITS = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}


def bucket_of(timestamp: Column, every: str) -> Column:
    """Start of the day, month, quarter or year; weeks run Monday to Sunday and are named by their Sunday."""
    unit = UNITS.get(every, "month")
    start = F.date_trunc(unit, timestamp)
    return start + F.expr("INTERVAL 6 DAYS") if unit == "week" else start


def parse_bound(text: str | None) -> Column | None:
    """A time bound as a literal UTC timestamp; None when absent or unreadable."""
    if not text:
        return None
    try:
        moment = pd.Timestamp(text, tz="UTC")
    except Exception:
        return None
    return None if pd.isna(moment) else F.timestamp_micros(F.lit(moment.value // 1000))


def in_region(df: DataFrame, region: str | None, fields: Mapping[str, str]) -> DataFrame:
    """Rows whose region equals the given one exactly; no restriction without a region or a region column."""
    if region and "region" in fields:
        return df.where(F.col(fields["region"]).cast("string") == region)
    return df


def in_time(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; a date alone means its midnight, unreadable bounds are ignored.

    On a table laid out by month the bounds reach its folders as well.
    """
    lower, upper = parse_bound(start), parse_bound(end)
    by_month = {"obs_year", "obs_month"} <= set(df.columns)
    month = F.col("obs_year") * 12 + F.col("obs_month") if by_month else None
    if lower is not None:
        df = df.where(F.col("_timestamp") >= lower)
        if by_month:
            df = df.where(month >= F.year(lower) * 12 + F.month(lower))
    if upper is not None:
        df = df.where(F.col("_timestamp") <= upper)
        if by_month:
            df = df.where(month <= F.year(upper) * 12 + F.month(upper))
    return df


def default_index(df: DataFrame) -> str | None:
    return "ndvi" if "ndvi" in df.columns else next(iter(candidate_features(df)), None)


def trend(df: DataFrame, index: str | None = None, every: str = "monthly", region: str | None = None,
          start: str | None = None, end: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(bucket, mean, min, max, count)`` of an indicator; buckets without a value do not appear.

    ``by`` gives one series per combination of further columns.
    """
    index = index or default_index(df)
    if not index or index not in df.columns:
        raise ValueError("no compatible numerical indicator is available for a trend")
    if not is_numeric(df, index):
        raise ValueError(f"{index!r} is not numeric")
    rows = in_time(in_region(df, region, resolve_fields(df.columns)), start, end)
    rows = rows.where(F.col("_timestamp").isNotNull())
    value = F.col(index).cast("double")
    # Aggregates skip missing values, so empty buckets are dropped afterwards: a filter on the (derived) value
    # would repeat its whole formula below the projection.
    return rows.groupBy(*by, bucket_of(F.col("_timestamp"), every).alias("bucket")).agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(value).alias("count"),
    ).where(F.col("count") > 0)


def first_and_last(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the first and of the last bucket of each series, in one aggregate."""
    return series.groupBy(*by).agg(F.min_by("mean", "bucket").alias("first_mean"), F.max_by("mean", "bucket").alias("last_mean"))


def change_percent(mean: str = "mean", bucket: str = "bucket") -> Column:
    """Aggregate: last mean over first mean in percent; NULL for fewer than two buckets or a first mean of zero."""
    first, last = F.min_by(mean, bucket), F.max_by(mean, bucket)
    return F.when((F.count(mean) >= 2) & (first != 0), (F.try_divide(last, first) - 1) * 100)


def trend_change(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Net change of each series: a grouped min_by/max_by, no window."""
    return series.groupBy(*by).agg(change_percent().alias("change_percent"))


def trend_cards(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean, least, greatest and spread of the bucket means, the rows behind them, and the net change."""
    mean = F.coalesce("mean", F.lit(0.0))
    return series.groupBy(*by).agg(
        F.coalesce(F.avg(mean), F.lit(0.0)).alias("mean"),
        F.coalesce(F.min(mean), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(mean), F.lit(0.0)).alias("max"),
        F.stddev_samp(mean).alias("std"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("observations"),
        change_percent().alias("change_percent"),
    )


def latest_buckets(series: DataFrame, n: int = V.CHART_BUCKETS) -> DataFrame:
    """The last ``n`` buckets, oldest first."""
    return series.orderBy(F.col("bucket").desc()).limit(n).orderBy("bucket")


def _per_series(by: Sequence[str]):
    """Window over one series. A series holds one row per bucket, so its length is bounded by the time span."""
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy("bucket")


def moving_average(series: DataFrame, periods: int = 7, by: Sequence[str] = ()) -> DataFrame:
    w = _per_series(by).rowsBetween(1 - periods, 0)
    return series.withColumn("moving_average", F.avg("mean").over(w))


def rolling_band(series: DataFrame, periods: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Moving average with a band of one rolling standard deviation on either side."""
    w = _per_series(by).rowsBetween(1 - periods, 0)
    banded = series.withColumns({"moving_average": F.avg("mean").over(w), "rolling_std": F.stddev_samp("mean").over(w)})
    return banded.withColumns({
        "band_low": F.col("moving_average") - F.col("rolling_std"),
        "band_high": F.col("moving_average") + F.col("rolling_std"),
    })


def trend_slope(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope, intercept and fit of the bucket means against the bucket number."""
    numbered = series.withColumn("_x", (F.row_number().over(_per_series(by)) - 1).cast("double"))
    spread_x, spread_y = F.regr_sxx("mean", "_x"), F.regr_syy("mean", "_x")
    joint = F.regr_sxy("mean", "_x")
    slope = F.try_divide(joint, F.nullif(spread_x, F.lit(0.0)))
    return numbered.groupBy(*by).agg(
        F.count("mean").alias("buckets"),
        slope.alias("slope"),
        (F.avg("mean") - slope * F.avg("_x")).alias("intercept"),
        F.try_divide(joint * joint, F.nullif(spread_x * spread_y, F.lit(0.0))).alias("r2"),
    )


def seasonality(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the bucket means in each month of the year, and its distance from the mean of all buckets."""
    monthly = series.groupBy(*by, F.month("bucket").alias("month")).agg(
        F.sum("mean").alias("_sum"), F.count("mean").alias("buckets"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))  # at most 12 rows each
    overall = F.sum("_sum").over(whole) / F.sum("buckets").over(whole)
    mean = F.col("_sum") / F.col("buckets")
    return monthly.select(*by, "month", "buckets", mean.alias("mean"), (mean - overall).alias("departure"))
