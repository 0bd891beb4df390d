"""Totals kept beside a store, so that trends and profiles are brought up to date and not made anew.

For each batch of a store (``ledger.load``) one table holds, for each file, day and group, the number of rows and of every value its
count, sum and extremes. All of these can be added up, and rows of a file that a later load replaced are left out by the ledger,
as they are from the rows themselves. After a load only its own batch is read; a trend then reads totals alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.operators.schema import resolve_fields
from fieldglass.operators.trends import bucket_of, in_region
from fieldglass.sources.ledger import FILE, live_batches, still_counting, written_numbers


class Refresh(NamedTuple):
    """Batches whose rows were read, and those whose totals were there."""

    read: list[int]
    kept: list[int]


def _folder(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/totals/{name}"


def _read(spark: SparkSession, store: str, name: str, batches: Sequence[int]) -> DataFrame:
    folder = _folder(store, name)
    first = spark.read.parquet(f"{folder}/batch={batches[0]}").schema  # all batches are written alike
    rows = spark.read.schema(first.add("batch", "long")).option("basePath", folder)
    return rows.parquet(*[f"{folder}/batch={b}" for b in batches])


def _parts(table: DataFrame, column: str) -> Mapping[str, T.DataType]:
    return {f.name: f.dataType for f in table.schema[column].dataType.fields}


def _column(rows: DataFrame, name: str, kind: T.DataType | str) -> Column:
    """A column that this batch may lack."""
    return (F.col(f"`{name}`") if name in rows.columns else F.lit(None)).cast(kind)


def refresh_totals(spark: SparkSession, store: str, keys: Sequence[str] = (), values: Sequence[str] = (), name: str = "daily") -> Refresh:
    """Make the totals of those batches of ``store`` that have none.

    ``keys`` group and ``values`` (numbers) are summed; both are fixed by the first call for a ``name``, later ones may leave them
    out. The rows need ``_timestamp`` (load them with ``prepare=fg.prepare``); rows without a time have totals without a day. A
    column that a batch lacks is missing in all its rows. There is at most one row of totals for each row stored, and far fewer
    where files hold many rows a day and group. A refresh that breaks off is done again: a batch counts once it is written.
    """
    live, folder = live_batches(spark, store), _folder(store, name)
    done = set(written_numbers(spark, folder, "batch="))
    kinds: Mapping[str, T.DataType] = {}
    if done:
        stored = _read(spark, store, name, sorted(done))
        kinds, kept_values = _parts(stored, "by"), list(_parts(stored, "of"))
        if (keys and list(keys) != list(kinds)) or (values and list(values) != kept_values):
            raise ValueError(f"totals {name!r} are kept by {list(kinds)} of {kept_values}")
        keys, values = list(kinds), kept_values
    if not keys or not values:
        raise ValueError("totals need the columns that group them and those that are summed")
    missing = [b for b in live if b not in done]
    for batch in missing:  # one a load
        rows = spark.read.option("mergeSchema", True).parquet(f"{store.rstrip('/')}/rows/batch={batch}")
        if "_timestamp" not in rows.columns:
            raise ValueError("totals need rows with their time: load them with prepare=fg.prepare")
        if not kinds:
            kinds = {k: rows.schema[k].dataType if k in rows.columns else T.StringType() for k in keys}
        narrow = rows.select(
            F.col(FILE).alias("file"), F.date_trunc("day", "_timestamp").alias("day"),
            *[_column(rows, k, kinds[k]).alias(f"k{i}") for i, k in enumerate(keys)],
            *[_column(rows, v, "double").alias(f"v{i}") for i, v in enumerate(values)])
        sums = narrow.groupBy("file", "day", *[f"k{i}" for i in range(len(keys))]).agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.struct(F.count(f"v{i}").alias("n"), F.sum(f"v{i}").alias("total"), F.min(f"v{i}").alias("low"), F.max(f"v{i}").alias("high"))
              .alias(f"t{i}") for i in range(len(values))])
        sums.select(
            F.col("file").alias(FILE), "day", "rows", F.struct(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]).alias("by"),
            F.struct(*[F.col(f"t{i}").alias(v) for i, v in enumerate(values)]).alias("of"),
        ).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    return Refresh(missing, [b for b in live if b in done])


def totals(spark: SparkSession, store: str, name: str = "daily") -> DataFrame:
    """``(source_file, batch, day, rows, by, of)`` for the files as they now are; ``refresh_totals`` must have seen every batch."""
    live = live_batches(spark, store)
    if not live:
        raise ValueError("the store holds no rows")
    behind = set(live) - set(written_numbers(spark, _folder(store, name), "batch="))
    if behind:
        raise ValueError(f"totals {name!r} lack the batches {sorted(behind)}: refresh them")
    return still_counting(_read(spark, store, name, live), store)


def _known(table: DataFrame, column: str, wanted: Sequence[str]) -> None:
    unknown = [w for w in wanted if w not in _parts(table, column)]
    if unknown:
        raise ValueError(f"no totals are kept of {unknown}")


def kept_trend(spark: SparkSession, store: str, index: str, every: str = "monthly", region: str | None = None, first_day: str | None = None,
               last_day: str | None = None, by: Sequence[str] = (), name: str = "daily") -> DataFrame:
    """``trends.trend`` from totals: ``(bucket, mean, min, max, count)``, for each combination of ``by``.

    ``first_day`` and ``last_day`` are whole days, both included.
    """
    table = totals(spark, store, name)
    _known(table, "of", [index])
    _known(table, "by", by)
    keyed = table.where("day IS NOT NULL").select("day", F.col(f"of.`{index}`").alias("_of"), "by.*")
    if first_day:
        keyed = keyed.where(F.col("day") >= F.lit(first_day).cast("date"))
    if last_day:
        keyed = keyed.where(F.col("day") < F.date_add(F.lit(last_day).cast("date"), 1))
    keyed = in_region(keyed, region, resolve_fields(list(_parts(table, "by"))))
    return keyed.groupBy(*by, bucket_of(F.col("day"), every).alias("bucket")).agg(
        F.try_divide(F.sum("_of.total"), F.sum("_of.n")).alias("mean"), F.min("_of.low").alias("min"), F.max("_of.high").alias("max"),
        F.sum("_of.n").alias("count")).where("count > 0")


def kept_profile(spark: SparkSession, store: str, region: str = "region", state: str = "state", name: str = "daily") -> DataFrame:
    """``regions.regional_profile`` from totals: the mean of every value kept by region and state, and the region's rows.

    Undated rows count. Scores over all rows (anomaly, risk) change with every load, so they can't be kept this way.
    """
    table = totals(spark, store, name)
    _known(table, "by", [region, state])
    values = list(_parts(table, "of"))
    grouped = table.groupBy(F.col(f"by.`{region}`").alias("region"), F.col(f"by.`{state}`").alias("state")).agg(
        F.sum("rows").alias("_rows"),
        *[F.try_divide(F.sum(f"of.`{v}`.total"), F.sum(f"of.`{v}`.n")).alias(v) for v in values])
    # one row a region and state from here on; rows without a state count for their region
    counted = grouped.where("region IS NOT NULL").withColumn("observations", F.sum("_rows").over(Window.partitionBy("region")))
    return counted.where("state IS NOT NULL").select("region", "state", *[f"`{v}`" for v in values], "observations")


def kept_counts(spark: SparkSession, store: str, by: Sequence[str], name: str = "daily") -> DataFrame:
    """Rows of each combination of ``by``, as ``rows``; a missing key is a group of its own."""
    table = totals(spark, store, name)
    _known(table, "by", by)
    return table.select("rows", "by.*").groupBy(*by).agg(F.sum("rows").alias("rows"))
