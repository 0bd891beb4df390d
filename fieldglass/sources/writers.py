"""Sinks: the materialised observation table and report exports. Nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass import vocabulary as V
from fieldglass.functions.scalar import json_safe, place_code
from fieldglass.operators.schema import resolve_fields
from fieldglass.runtime import settle
from fieldglass.sources.readers import fingerprint

#: export formats and how their files are compressed unless told otherwise; text of many rows repeats itself
EXPORT_FORMATS = {"csv": "gzip", "json": "gzip", "parquet": None}


#: the folder, beside a table's files and unseen by its readers, that holds what is known of the table
ABOUT = "_about"
ABOUT_SCHEMA = ("dataset string, fingerprint string, rows bigint, columns array<string>, fields map<string,string>, derived array<string>, "
                "non_missing map<string,bigint>, least map<string,double>, greatest map<string,double>, first timestamp, last timestamp")


def _measures(df: DataFrame) -> list:
    """Aggregates that one pass of a write gathers: rows, and of every column its values and, of numbers and times, its ends."""
    found = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        column = F.col(f"`{f.name}`")
        found.append(F.count(column).alias(f"n{i}"))
        if isinstance(f.dataType, (T.NumericType, T.TimestampType)):
            found += [F.min(column).cast("double").alias(f"low{i}"), F.max(column).cast("double").alias(f"high{i}")]
    return found


def _keep_about(df: DataFrame, path: str, seen: dict, source: str | None) -> None:
    spark, names = df.sparkSession, df.columns
    numbers = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.NumericType)]
    times = [i for i, f in enumerate(df.schema.fields) if f.name == "_timestamp" and isinstance(f.dataType, T.TimestampType)]
    ends = lambda kind: {names[i]: seen[f"{kind}{i}"] for i in numbers if seen[f"{kind}{i}"] is not None}
    first, last = (seen[f"{kind}{times[0]}"] if times else None for kind in ("low", "high"))
    row = (source.rstrip("/").rsplit("/", 1)[-1] if source else None, fingerprint(spark, source).first()["fingerprint"] if source else None,
           seen["rows"], names, dict(resolve_fields(names)), [i for i in V.INDEX_NAMES if i in names],
           {n: seen[f"n{i}"] for i, n in enumerate(names)}, ends("low"), ends("high"), first, last)
    plain = ABOUT_SCHEMA.replace("first timestamp, last timestamp", "first double, last double")
    about = spark.createDataFrame([row], plain).withColumns({c: F.timestamp_seconds(c) for c in ("first", "last")})
    about.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{ABOUT}")


def _by_place(df: DataFrame, spread: bool) -> tuple[DataFrame, str]:
    """Rows with their place on the curve, dealt to tasks in its order if asked; a place with many rows is split by row key."""
    fields = resolve_fields(df.columns)
    if not {"latitude", "longitude"} <= set(fields):
        raise ValueError("a layout by place needs coordinates")
    code = "_place"
    rows = df.withColumn(code, place_code(*[F.col(fields[f]).cast("double") for f in ("latitude", "longitude")]))
    return (rows.repartitionByRange(code, F.xxhash64("row_id")) if spread else rows), code


def materialise(df: DataFrame, path: str, view: str = "observations", by_month: bool = False, source: str | None = None,
                by_place: bool = False, group_bytes: int | None = None) -> DataFrame:
    """Write the prepared table as Parquet, register it as a view, and return it.

    ``by_month`` lays it out by year and month, so that time ranges prune folders. Rows without a ``row_id`` get one from
    their file and place in a first written copy: once written, it stays, whatever tasks are run again.

    ``by_place`` orders it along a curve over the map, within each month if both are asked for, so that files and row groups
    hold small areas and the statistics of both skip those that a box (``points.in_box``) does not touch; ``group_bytes`` bounds
    a row group. Rows without a position come first.

    The write itself counts rows, values and extremes; they are kept beside the table with the fingerprint of ``source``
    (the dataset it was read from), for ``metadata``.
    """
    out = df
    if "row_id" not in df.columns:
        place = F.concat_ws("-", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index"))
        out = settle(df, "unkeyed").select("*", place.alias("row_id"))
    seen = Observation("about")
    # range partitioning samples its input first: what is laid out by place is only counted on its way to the files
    watched = out if by_place else out.observe(seen, *_measures(out))
    if by_month:
        watched = watched.withColumns({"obs_year": F.year("_timestamp"), "obs_month": F.month("_timestamp")})
        # rebalancing gathers small months and splits large ones by size, at run time
        laid = df.sparkSession.sql("SELECT /*+ REBALANCE(obs_year, obs_month) */ * FROM {rows}", rows=watched)
    else:
        laid = watched
    if by_place:
        laid, code = _by_place(laid, spread=not by_month)
        laid = laid.sortWithinPartitions(*(["obs_year", "obs_month"] if by_month else []), code, "row_id").drop(code).observe(seen, *_measures(out))
    writer = laid.write.mode("overwrite")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    (writer.partitionBy("obs_year", "obs_month") if by_month else writer).parquet(path)
    _keep_about(out, path, seen.get, source)
    stored = df.sparkSession.read.schema(watched.schema).parquet(path)
    stored.createOrReplaceTempView(view)
    return stored


def stored_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row about a table that ``materialise`` wrote, as it was written; the table itself is not read."""
    return spark.read.schema(ABOUT_SCHEMA).json(f"{path.rstrip('/')}/{ABOUT}")


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: maps, arrays and structs become JSON text."""
    nested = (T.MapType, T.ArrayType, T.StructType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def export(df: DataFrame, path: str, fmt: str = "csv", compression: str | None = None) -> str:
    """Write a report as a folder of CSV (with header), JSON or Parquet files and return the path.

    Text is compressed with gzip, a file for each task; ``compression="none"`` leaves it plain.
    """
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"format must be one of {tuple(EXPORT_FORMATS)}")
    compression = compression or EXPORT_FORMATS[fmt]
    if fmt == "csv":
        writer = _flat(df).write.option("header", True).option("quoteAll", False)
    elif fmt == "json":
        writer = json_safe(df).write.option("ignoreNullFields", "false")
    else:
        writer = df.write
    if compression:
        writer = writer.option("compression", compression)
    writer.mode("overwrite").format(fmt).save(path)
    return path
