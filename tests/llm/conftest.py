import pytest

SCHEMA = "doc_id bigint, text string, source string"

LONG = " ".join(f"word{i % 997} tail{i % 13}" for i in range(30_000))


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties, several rows of one id."""
    return [
        (1, None, "a"), (2, "", "a"), (3, "   \n \t ", None), (None, "a text without an id", "b"), (None, None, None),
        (4, LONG, "b"), (5, LONG, "c"), (6, "same row twice, a line that is long enough", "c"), (6, "same row twice, a line that is long enough", "c"),
        (7, "another text of\nsame row twice, a line that is long enough\nits own", "c"), (7, "one id with two texts\nits own line number two", "a"),
        (8, "naïve café ñandú — Ünïcödé\n\n\nA LINE\nA LINE\na line that is long enough\r\n", "ç"),
        (9, prose(1, 300), "d"), (10, prose(1, 300), "d"), (11, prose(1, 299) + " changed", "d"), (12, prose(2, 40), None),
        (13, "one two three", "a"), (14, "one two three", "a"), (15, "x" * 5000, "a"), (16, "ab " * 700, "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def clashing(df, *names):
    """The table with columns whose names an operator uses as well."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


@pytest.fixture(scope="session")
def clash():
    return clashing
