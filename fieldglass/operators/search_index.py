"""Search through a dictionary of values: a term becomes a list of values, which a stored table's statistics can answer.

Three tables are kept beside the rows: the distinct values of each text column, the trigrams of each value, and how many values
hold each trigram. A search reads the postings of the term's rarest trigram and never the rows that hold none of its values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.operators.browse import can_hold, holds
from fieldglass.runtime import settle

GRAM = 3
#: values of one column, and the characters of them all, that a filter may name; beyond either the column is scanned, as without an index
NAMED_VALUES = 1_000
NAMED_CHARACTERS = 1 << 20
#: postings that are looked up by broadcast (8 bytes each); more are joined as their size asks for
SENT_POSTINGS = 100_000


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def search_index(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Write the index of ``df``'s text columns (or the given ones) to ``path``; it holds for these rows only.

    One shuffle of distinct values, combined before it, so a value that fills the table is one row a task; one of their
    trigrams. Missing values are in no dictionary; an empty text is a value without trigrams. The list of columns is
    written last: an index without it is not read.
    """
    spark, folder = df.sparkSession, path.rstrip("/")
    names = [c for c in columns or _texts(df) if c in _texts(df)]
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in names]
    if cells:
        values = df.select(F.inline(F.array(*cells))).where("value IS NOT NULL").distinct()
    else:
        values = spark.createDataFrame([], "column string, value string")
    values = values.withColumn("id", F.xxhash64("column", "value"))
    values.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/values")
    # a lookahead reads the text once, whatever its length; substrings by position would start from its beginning each time
    grams = F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1)))
    postings = spark.read.parquet(f"{folder}/values").select(F.explode(grams).alias("gram"), "id")
    postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{folder}/postings")
    counts = spark.read.parquet(f"{folder}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("values"))
    counts.write.mode("overwrite").parquet(f"{folder}/grams")
    spark.createDataFrame([(c,) for c in names], "column string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/columns")


def matching_values(spark: SparkSession, path: str, term: str) -> DataFrame:
    """``(column, value)`` of the index's values that hold the term in any case; every candidate is compared with the term itself.

    Terms shorter than a trigram are looked for in all values.
    """
    folder, term = path.rstrip("/"), term.lower()
    values = spark.read.parquet(f"{folder}/values")
    matching = values.where(F.lower("value").contains(term)).select("column", "value")
    grams = {term[i:i + GRAM] for i in range(len(term) - GRAM + 1)}
    if not grams:
        return matching
    known = spark.read.parquet(f"{folder}/grams").where(F.col("gram").isin(*grams)).collect()  # one row for each trigram of the term
    if len(known) < len(grams):
        return matching.limit(0)
    rarest = min(known, key=lambda r: (r["values"], r["gram"]))
    ids = spark.read.parquet(f"{folder}/postings").where(F.col("gram") == rarest["gram"]).select("id")
    if rarest["values"] <= NAMED_VALUES:
        candidates = values.where(F.col("id").isin(*[r["id"] for r in ids.collect()]))
    else:
        candidates = values.join(F.broadcast(ids) if rarest["values"] <= SENT_POSTINGS else ids, "id", "left_semi")
    return candidates.where(F.lower("value").contains(term)).select("column", "value")


def search_indexed(df: DataFrame, path: str, term: str | None) -> DataFrame:
    """The rows that ``browse.search_rows`` finds, by the index at ``path``.

    A text column gives a filter on its matching values, which reaches the file scan; one with more than ``NAMED_VALUES`` of
    them, one that the index does not cover and every other column whose values can spell the term is scanned. Looking the
    values up runs small jobs; rows are read by the result only. Rows added after the index was written may be missed.
    """
    if not term:
        return df
    spark, term = df.sparkSession, term.lower()
    covered = {r["column"] for r in spark.read.parquet(f"{path.rstrip('/')}/columns").collect()} & set(_texts(df))
    scanned = [c for c in df.columns if c not in covered and can_hold(df.schema[c].dataType, term)]
    found = settle(matching_values(spark, path, term).where(F.col("column").isin(*covered)), "matching-values") if covered else None
    named = []
    if found is not None:
        sizes = found.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("characters")).collect()
        for size in sizes:  # one row a column
            if size["n"] > NAMED_VALUES or size["characters"] > NAMED_CHARACTERS:
                scanned.append(size["column"])
            else:
                own = found.where(F.col("column") == size["column"]).collect()
                named.append(F.col(f"`{size['column']}`").isin(*sorted(r["value"] for r in own)))
    return df.where(reduce(or_, [*named, *[holds(c, term) for c in scanned]], F.lit(False)))
