"""Columns of the input that are named as an operator names its own are kept, and change no result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldglass.llm.decontamination import contaminated
from fieldglass.llm.license_scan import license_labels
from fieldglass.llm.line_dedup import drop_repeated_lines
from fieldglass.llm.ngram_join import first_of_each
from fieldglass.llm.quality_rules import quality_verdicts
from fieldglass.llm.url_filters import url_verdicts

NAMES = ("_counts", "_host", "_path", "_best", "_t1", "_t2", "_T2_", "_key", "_f1", "_f2", "_id", "_doc", "_d", "_m1", "_m2", "_keep", "_done", "node", "failed")


def rows_of(df, columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def unharmed(make, plain, clash):
    """The operator's result is the same beside the user's columns, and these come back as they were."""
    want, got = make(plain), make(clash(plain, *NAMES))
    assert rows_of(got, want.columns) == rows_of(want, want.columns)
    assert set(got.columns) == set(want.columns) | set(NAMES)
    assert all(set(r) <= {"mine"} for r in got.select(*NAMES).distinct().collect())


@pytest.mark.parametrize("make", [quality_verdicts, license_labels, drop_repeated_lines], ids=lambda f: f.__name__)
def test_operators_on_documents(make, odd, clash):
    unharmed(make, odd, clash)


def test_near_duplicates(odd, clash):
    unharmed(lambda df: first_of_each(df).withColumn("source", F.lit("")), odd, clash)  # of equal texts with one id either may stay


def test_url_filters(spark, clash):
    rules = spark.createDataFrame([("com/", "allow", "rule"), ("example.com/en/", "block", "rule"), ("example.com/en/", "allow", "rule")],
                                  "rule string, verdict string, kind string")
    pages = spark.createDataFrame([(1, "http://a.example.com/en/x"), (2, None), (3, ""), (4, "http://b.com/" + "y/" * 20_000), (4, "no host")],
                                  "page_id bigint, url string")
    unharmed(lambda df: url_verdicts(df, rules), pages, clash)
    assert {r.page_id: r.verdict for r in url_verdicts(pages, rules).where("page_id IN (1, 2)").collect()} == {1: "block", 2: "allow"}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "another text of same row twice, a line that is long enough its own"), (None, None)], "item_id bigint, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return folder


def test_stages_on_odd_and_empty_tables(spark, odd, none, sf, clash):
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, none, sf)
        assert empty.count() == 0, name
        if name == "mixing":
            blocks = stage(spark, clash(odd, *NAMES), sf)
            assert blocks.count() > 0
            continue
        full = odd.withColumn("n_chars", F.length("text").cast("long")).select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars")
        kept = stage(spark, clash(full, *NAMES), sf)
        assert kept.columns == [*full.columns, *NAMES], name
        assert kept.count() == stage(spark, full, sf).count() > 0, name
    gone = odd.exceptAll(contaminated(odd, spark.read.parquet(f"{sf}/benchmark.parquet")).where("NOT contaminated").select(*odd.columns))
    assert [r.doc_id for r in gone.collect()] == [7]
