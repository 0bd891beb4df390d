"""Sources that are taken in file by file: a ledger says which files are stored, and in which batch of rows.

A store is a folder with ``rows/batch=N`` (the rows of the files that a load read, each with its file) and
``ledger/version=N`` (one row a file: path, change time, size, fingerprint, batch, and whether its rows in that batch still
count). A load lists the source, joins the listing with the ledger and reads new and changed files only. It writes rows first
and the ledger last, so a load that breaks off leaves rows that no ledger names and the next one does it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.runtime import settle, small_enough
from fieldglass.sources.readers import format_of, list_files, read_observations

LEDGER = "path string, modified timestamp, bytes bigint, fingerprint string, batch bigint, live boolean"
FILE = "source_file"
#: changed files that one read names at most; a whole source is read by its path
READ_FILES = 10_000


class Load(NamedTuple):
    """What a load found, by number of files, and the version of the ledger after it."""

    added: int
    changed: int
    removed: int
    unchanged: int
    version: int


def file_fingerprint(path: F.Column, modified: F.Column, size: F.Column) -> F.Column:
    """20 digits over path, change time and size of a file."""
    return F.substring(F.sha2(F.concat_ws(":", path, F.unix_micros(modified), size), 256), 1, 20)


def listing(spark: SparkSession, source: str, deep: bool = True) -> DataFrame:
    """``(path, modified, bytes, fingerprint)`` of a source's files; contents are not read."""
    return list_files(spark, source, deep=deep).withColumn("fingerprint", file_fingerprint(F.col("path"), F.col("modified"), F.col("bytes")))


def written_numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers N of the folders ``prefixN`` below a folder that were written to their end."""
    parent = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(parent):
        return []
    found = [s.getPath() for s in fs.listStatus(parent)]
    done = [p for p in found if p.getName().startswith(prefix) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix(prefix)) for p in done)


def _versions(spark: SparkSession, store: str) -> list[int]:
    return written_numbers(spark, f"{store}/ledger", "version=")


def ledger(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The ledger of a store, by default the last one; empty before the first load."""
    known = _versions(spark, store)
    if not known:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{store}/ledger/version={known[-1] if version is None else version}")


def compare(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` (a listing) beside the live rows of a ledger: (path, state, ..), state being added, changed, removed or unchanged."""
    old = known.where("live").select("path", F.col("fingerprint").alias("old_fingerprint"), F.col("batch").alias("old_batch"))
    state = (
        F.when(F.col("old_fingerprint").isNull(), "added").when(F.col("fingerprint").isNull(), "removed")
        .when(F.col("fingerprint") != F.col("old_fingerprint"), "changed").otherwise("unchanged")
    )
    return found.join(old, "path", "full").withColumn("state", state)


def _chunks(paths: Iterator, size: int) -> Iterator[list[str]]:
    while own := [r["path"] for r in islice(paths, size)]:
        yield own


def load(spark: SparkSession, source: str, store: str, fmt: str | None = None, schema: str | None = None, force: bool = False,
         prepare: Callable[[DataFrame], DataFrame] | None = None) -> Load:
    """Bring ``store`` up to date with the files of ``source``.

    An unchanged source costs its listing: nothing is read or written. Of a changed one only new and changed files are
    read; rows of changed and removed files no longer count. ``force`` reads everything again. ``prepare`` is applied to
    what is read, file by file or many at once, and must keep the column ``source_file``; it must not depend on other files.
    """
    versions = _versions(spark, store)
    known = ledger(spark, store)
    states = settle(compare(listing(spark, source), known), "ledger-states")
    counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
    done = [counts.get(k, 0) for k in ("added", "changed", "removed", "unchanged")]
    if versions and not force and not any(done[:3]):
        return Load(*done, versions[-1])
    version = versions[-1] + 1 if versions else 1
    wanted = states.where("state <> 'removed'") if force else states.where("state IN ('added', 'changed')")
    whole = force or not any(done[1:])
    chunks = _chunks(wanted.select("path").toLocalIterator(), READ_FILES)
    mode = "overwrite"  # a load that broke off may have left rows under this number
    for files in [source] if whole and any(counts.get(k) for k in ("added", "changed", "unchanged")) else chunks:
        rows = read_observations(spark, files, fmt or format_of(source), schema, file_column=FILE, deep=True)
        if whole:  # files that came after the listing wait for the next load
            named = wanted.select(F.col("path").alias(FILE))
            rows = rows.join(F.broadcast(named) if small_enough(named) else named, FILE, "left_semi")
        (prepare(rows) if prepare else rows).write.mode(mode).parquet(f"{store}/rows/batch={version}")
        mode = "append"
    gone = states.where("state IN ('changed', 'removed')").select("path")
    live = known.where(F.col("live") & F.lit(not force))
    kept, replaced = live.join(gone, "path", "left_anti"), live.join(gone, "path", "left_semi").withColumn("live", F.lit(False))
    used = settle(kept.select("batch").distinct(), "ledger-batches")  # rows of batches that no live file needs are never looked at
    dead = known.where("NOT live").unionByName(replaced).join(F.broadcast(used) if small_enough(used) else used, "batch", "left_semi")
    new = wanted.select("path", "modified", "bytes", "fingerprint", F.lit(version).cast("long").alias("batch"), F.lit(True).alias("live"))
    kept.unionByName(dead).unionByName(new).write.mode("overwrite").parquet(f"{store}/ledger/version={version}")
    return Load(*done, version)


def live_batches(spark: SparkSession, store: str) -> list[int]:
    """Batches that hold the rows of a file as it now is: one a load at most."""
    return sorted(r["batch"] for r in ledger(spark, store).where("live").select("batch").distinct().collect())


def still_counting(rows: DataFrame, store: str) -> DataFrame:
    """Of rows with their ``source_file`` and ``batch``, those that no later load has replaced."""
    dead = ledger(rows.sparkSession, store).where("NOT live").select(F.col("path").alias(FILE), "batch")
    return rows.join(F.broadcast(dead) if small_enough(dead) else dead, [FILE, "batch"], "left_anti")


def stored_rows(spark: SparkSession, store: str) -> DataFrame:
    """The rows of all files as they now are, with ``source_file`` and ``batch``.

    Folders of batches that no file needs are not listed; rows that no longer count are taken out by an anti-join with the
    ledger's dead entries, of which there are as many as files changed since the last forced load.
    """
    batches = live_batches(spark, store)
    if not batches:
        raise ValueError("the store holds no rows")
    rows = spark.read.option("mergeSchema", True).option("basePath", f"{store}/rows").parquet(*[f"{store}/rows/batch={b}" for b in batches])
    return still_counting(rows.withColumn("batch", F.col("batch").cast("long")), store)
