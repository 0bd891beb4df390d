"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of ``documents``; the last returns the mixed blocks.

Nulls, empty and very long texts, ties and repeated rows are what the stage's operator says of them; an empty table stays an
empty one at every stage. Columns beyond those of ``documents`` are carried along up to the last stage, except that one named like
a result of a stage's operator holds that result after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.decontamination import contaminated
from fieldglass.llm.frames import settle
from fieldglass.llm.line_dedup import drop_repeated_lines
from fieldglass.llm.mixing import mixed_blocks
from fieldglass.llm.ngram_join import first_of_each
from fieldglass.llm.quality_rules import quality_verdicts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go. Null and empty texts fail a rule; repeated rows are judged each."""
    return quality_verdicts(docs).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document holds go; ``n_chars`` follows the text. Texts that lose every line go.

    A null text comes out empty, with no characters; rows that share an id are one document, those without an id the last one.
    """
    left = drop_repeated_lines(docs).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long"))
    return left.where("n_dropped = 0 OR text <> ''").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the least id; of rows equal in id and text any one."""
    return first_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Empty texts have none; items without an id count."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, benchmark).where("NOT contaminated").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the sources' words in their target shares, by output shard and slot."""
    return mixed_blocks(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
]

#: minhash candidates and a pseudorandom mix have no SQL; tests hold the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
