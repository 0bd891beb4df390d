"""Observation readers: CSV and Parquet tables, station climate feeds, source choice and fingerprints."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass import vocabulary as V
from fieldglass.functions.scalar import literal_table
from fieldglass.operators.schema import adapt_names, clean_name, day_of_year_timestamp
from fieldglass.runtime import settle, small_enough

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMATS = {"parquet": "parquet", "pq": "parquet", "csv": "csv"}


def format_of(path: str) -> str:
    """Format by suffix; a path that ends in neither a known suffix nor one at all must be given a format."""
    suffix = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"expected a CSV or Parquet dataset, got {path!r}")
    return FORMATS[suffix]


def list_files(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, deep: bool = False) -> DataFrame:
    """``(path, modified, bytes)`` of the files behind a path (and in its folders, if ``deep``); contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", deep)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"),
                                    F.col("length").alias("bytes"))


def choose_source(spark: SparkSession, folder: str) -> str | None:
    """First Parquet file or dataset folder of a folder by name, else the first CSV one, else None."""
    base = folder.rstrip("/").rsplit("/", 1)[-1]
    own = F.regexp_extract("path", f"^(.*?/{re.escape(base)}/[^/]+)", 1)
    for suffix in ("parquet", "csv"):
        found = list_files(spark, folder, deep=True).select(own.alias("path")).where(F.lower("path").endswith(f".{suffix}"))
        first = found.agg(F.min("path")).first()[0]
        if first:
            return first
    return None


def plain_path(path: F.Column) -> F.Column:
    """A path as listings spell it, from the URL-encoded one of ``_metadata.file_path``."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^([A-Za-z][A-Za-z0-9+.\-]*):///", "$1:/")


#: no file is split below this, and none shares a task with another, while headers are read
_WHOLE_FILES = str(1 << 40)


@contextmanager
def _one_file_a_task(spark: SparkSession) -> Iterator[bool]:
    """Scans planned and run inside give every file a task of its own; false if the session holds to other sizes."""
    wanted = {"spark.sql.files.maxPartitionBytes": _WHOLE_FILES, "spark.sql.files.openCostInBytes": _WHOLE_FILES,
              "spark.sql.execution.arrow.maxRecordsPerBatch": "64"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield spark.conf.get("spark.sql.files.openCostInBytes") == _WHOLE_FILES
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _first_lines(alone: bool):
    """The first line that is not blank of each file; a task that has a single file stops reading there."""

    def first_lines(batches):
        seen = set()
        for batch in batches:
            rows = [(path, line) for path, line in zip(*(c.to_pylist() for c in batch.columns)) if line.strip()]
            firsts = []
            for path, line in rows:
                if path not in seen:
                    seen.add(path)
                    firsts.append((path, line))
            if firsts:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*firsts)], names=["path", "line"])
                if alone:
                    return

    return first_lines


def header_lines(spark: SparkSession, path: str | Sequence[str], deep: bool = False) -> DataFrame:
    """``(path, line)``: the first line of every file behind a path, in one job with a task for each file, written."""
    with _one_file_a_task(spark) as alone:
        text = spark.read.option("recursiveFileLookup", deep).text(path)
        rows = text.where(F.col("_metadata.file_block_start") == 0).select(plain_path(F.col("_metadata.file_path")).alias("path"), "value")
        return settle(rows.mapInArrow(_first_lines(alone), "path string, line string"), "header-lines")


def header_groups(spark: SparkSession, path: str | Sequence[str], deep: bool = False) -> list[tuple[list[str], str | list[str]]]:
    """(column names, files) of the CSV files behind a path that have the same header.

    The driver gets the distinct header lines. Files of a single header are read by the path as it was given; only if there
    are several are their files listed, as readers take lists.
    """
    lines = header_lines(spark, path, deep)
    headers = [r["line"] for r in lines.groupBy("line").agg(F.min("path").alias("first")).orderBy("first").collect()]
    groups: dict[tuple, list[str]] = {}
    for line in headers:
        names = tuple(n.strip() for n in next(csv.reader([line.lstrip("\ufeff")])))
        groups.setdefault(names, []).append(line)
    if len(groups) == 1:
        return [(list(names), path) for names in groups]
    return [(list(names), [r["path"] for r in lines.where(F.col("line").isin(own)).orderBy("path").select("path").collect()])
            for names, own in groups.items()]


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """One row: a 20-character digest over path, change time and size of every file (order does not matter)."""
    files = list_files(spark, path)
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("bytes"),
        F.substring(
            F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "modified", "bytes")),
                               F.sum("bytes")), 256), 1, 20,
        ).alias("fingerprint"),
    )


def read_observations(spark: SparkSession, path: str | Sequence[str], fmt: str | None = None,
                      schema: T.StructType | str | None = None, sampling_ratio: float | None = None,
                      file_column: str | None = None, deep: bool = False) -> DataFrame:
    """CSV or Parquet observations with cleaned, de-duplicated column names.

    CSV names are taken from each file's own header line: files are read in
    groups of equal headers and put together by name. Give ``schema`` (by
    position, for files of one header) for large CSV input: without it the types
    are inferred by an extra pass, over ``sampling_ratio`` of the rows if set.

    Parquet rows without a ``row_id`` get one from their file and their place in
    it; for CSV input name key columns in ``prepare`` or ``materialise`` it.
    ``file_column`` adds each row's file, spelled as ``list_files`` does; ``deep`` reads all files below a folder, whose own
    folder names are no columns then.
    """
    source = plain_path(F.col("_metadata.file_path"))
    first = path if isinstance(path, str) else path[0]
    paths = path if isinstance(path, str) else list(path)
    if (fmt or format_of(first)) == "parquet":
        reader = spark.read.option("recursiveFileLookup", deep)
        rows = (reader.schema(schema) if schema else reader).parquet(*([paths] if isinstance(paths, str) else paths))
        place = F.concat_ws("-", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index"))
        keyed = "row_id" in map(clean_name, rows.columns)
        more = ([] if keyed else [place.alias("row_id")]) + ([source.alias(file_column)] if file_column else [])
        df = adapt_names(rows.select("*", *more) if more else rows)
    else:
        groups = header_groups(spark, paths, deep)
        if not groups:
            raise ValueError("the dataset contains no observations")
        reader = spark.read.option("header", True).option("recursiveFileLookup", deep)
        if schema is not None:
            reader = reader.schema(schema)
        else:
            reader = reader.option("inferSchema", True)
            if sampling_ratio:
                reader = reader.option("samplingRatio", sampling_ratio)
        parts = []
        for names, files in groups:
            rows = reader.csv(files)
            parts.append(adapt_names(rows.select("*", source.alias(file_column)), [*names, file_column]) if file_column else adapt_names(rows, names))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if df.isEmpty():
        raise ValueError("the dataset contains no observations")
    return df


def union_stations(frames: Mapping[str, DataFrame], station: str = "region") -> DataFrame:
    """The rows of all stations' frames, each with its station's name; a column that a frame lacks is missing there."""
    if not frames:
        raise ValueError("the climate feed has no stations")
    named = [rows.withColumn(station, F.lit(name)) for name, rows in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def station_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ["region", "latitude", "longitude"], V.STATIONS)


def normalise_climate_feed(feed: DataFrame, stations: DataFrame | None = None, station: str = "region") -> DataFrame:
    """Daily feed rows (year, day of year, temperature, rain, station name) as observations.

    ``-999`` is missing in every column; positions come from a join with the station table, broadcast if it is the fixed
    one or its stored size is small.
    """
    feed = adapt_names(feed)
    absent = [c for c in V.FEED_COLUMNS if c not in feed.columns]
    if absent:
        raise ValueError(f"climate feed lacks columns {absent}")
    own = station_table(feed.sparkSession) if stations is None else stations
    known = own.select(F.col("region").alias("_station"), "latitude", "longitude")
    known = F.broadcast(known) if stations is None or small_enough(own) else known

    def present(name):
        value = F.col(name).try_cast("double")
        return F.when(value != V.FEED_MISSING, value)

    source = feed.drop("latitude", "longitude").join(known, F.col(station) == F.col("_station"), "left")
    return source.select(
        day_of_year_timestamp(F.col("year"), F.col("doy")).alias("timestamp"),
        "latitude", "longitude", F.col(station).alias("region"),
        present("t2m").alias("temperature"), present("prectotcorr").alias("rainfall"),
    )


def read_climate_feed(spark: SparkSession, path: str | Sequence[str], stations: DataFrame | None = None,
                      name_from: str = r"([^/]*?)(?:\.[^./]*)?$", deep: bool = False) -> DataFrame:
    """All station files at once; the station is the file's name without its suffix, or what ``name_from`` finds in its path
    (``Port_Blair`` or ``Port%20Blair`` for names with blanks). ``deep`` reads all folders below."""
    types = {"year": "int", "doy": "int", "t2m": "double", "prectotcorr": "double"}
    name = F.regexp_replace(F.regexp_extract("_metadata.file_path", name_from, 1), "%20|_", " ")
    parts = []
    for names, files in header_groups(spark, path, deep):
        header = [clean_name(c) or f"unnamed_{i}" for i, c in enumerate(names)]
        absent = [c for c in V.FEED_COLUMNS if c not in header]
        if absent:
            raise ValueError(f"climate feed lacks columns {absent}")
        schema = T.StructType.fromDDL(", ".join(f"`{c}` {types.get(c, 'string')}" for c in header))
        rows = spark.read.option("recursiveFileLookup", deep).csv(files, header=True, schema=schema, enforceSchema=True)
        parts.append(rows.select(*V.FEED_COLUMNS, name.alias("region")))
    if not parts:
        raise ValueError("the climate feed has no files")
    return normalise_climate_feed(reduce(DataFrame.unionAll, parts), stations)
