"""Scalar helpers and index formulas on hand-worked rows."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.functions import scalar
from fieldglass.functions.indices import SPECTRAL, heat, proxy_ndvi, proxy_rest, season, wetness
from fieldglass.operators.schema import clean_name, day_of_year_timestamp


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return row.select(column.alias("out")).first()["out"]


def test_seeded_digest(spark):
    digest = scalar.seeded_digest(["a", "b"], 42)
    assert one(spark, digest, a="x", b=7.0) == hashlib.md5(b"x|7.0|42").hexdigest()
    assert one(spark, digest, a=None, b=7.0) == hashlib.md5(b"7.0|42").hexdigest()  # a missing key is left out


def test_division_guards(spark):
    c = F.col
    assert one(spark, scalar.ratio(c("a"), c("b")), a=1.0, b=0.0) is None
    assert one(spark, scalar.ratio(c("a"), c("b")), a=1e308, b=1e-10) is None
    assert one(spark, scalar.ratio(c("a"), c("b")), a=1.0, b=4.0) == 0.25
    assert one(spark, scalar.finite(F.lit(float("nan")))) is None
    assert one(spark, scalar.finite(F.lit(float("-inf")))) is None


def test_clamp_keeps_missing(spark):
    assert one(spark, scalar.clamp(F.lit(None).cast("double"), -1, 1)) is None
    assert one(spark, scalar.clamp(F.lit(3.0), -1, 1)) == 1.0
    assert one(spark, scalar.clamp(F.lit(-3.0), -1, 1)) == -1.0


@pytest.mark.parametrize("value, level", [(0.0, "Low"), (20.0, "Low"), (20.0001, "Moderate"), (60.0, "Elevated"),
                                          (80.0, "High"), (100.0, "Critical"), (-0.01, None), (100.5, None)])
def test_risk_levels_are_right_closed(spark, value, level):
    assert one(spark, scalar.label_right_closed(F.lit(value), V.RISK_EDGES, V.RISK_LEVELS)) == level


@pytest.mark.parametrize("value, label", [(0.34, "Normal"), (0.54, "Low"), (0.55, "Moderate"), (0.69, "Moderate"),
                                          (0.84, "High"), (1.0, "Critical"), (0.0, "Normal")])
def test_severities_are_right_closed(spark, value, label):
    assert one(spark, scalar.label_right_closed(F.lit(value), V.SEVERITY_EDGES, V.SEVERITY_LABELS)) == label


def test_spectral_golden_row(spark):
    bands = {"red": 0.1, "green": 0.2, "blue": 0.05, "nir": 0.5, "swir": 0.3}
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in bands.items()])
    got = row.select(*[f({b: F.col(b) for b in bands}).alias(k) for k, (_, f) in SPECTRAL.items()]).first()
    want = {"ndvi": .666667, "ndwi": -.428571, "ndbi": -.25, "evi": .579710, "savi": .545455, "nbr": .25}
    for index, value in want.items():
        assert got[index] == pytest.approx(value, abs=1e-6), index


def test_spectral_zero_denominator(spark):
    bands = {b: F.lit(v) for b, v in (("red", 0.1), ("nir", -0.1))}
    row = spark.range(1).select(SPECTRAL["ndvi"][1](bands).alias("ndvi"), SPECTRAL["savi"][1](bands).alias("savi")).first()
    assert row["ndvi"] is None
    assert row["savi"] == pytest.approx(-0.6)


@pytest.mark.parametrize("day, temperature, rain, want", [
    (200, 30.0, 5.0, {"ndvi": .7289, "ndwi": .1470, "evi": .6523, "savi": .6048, "ndbi": -.3757, "nbr": .3520}),
    (15, 24.0, 0.0, {"ndvi": .1360, "ndwi": -.0400, "evi": .1542, "savi": .1779, "ndbi": .0275, "nbr": .0707}),
])
def test_climate_golden_rows(spark, day, temperature, rain, want):
    row = spark.range(1).select(
        day_of_year_timestamp(F.lit(2023), F.lit(day)).alias("t"), F.lit(temperature).alias("temp"), F.lit(rain).alias("rain"))
    m, r, h = season(F.col("t")), wetness(F.col("rain"), 10.0), heat(F.col("temp"))
    row = row.withColumn("ndvi", proxy_ndvi(m, r, h)).withColumns(proxy_rest(F.col("ndvi"), m, r, h)).first()
    for index, value in want.items():
        assert row[index] == pytest.approx(value, abs=1e-9), index


def test_leap_day(spark):
    assert str(one(spark, day_of_year_timestamp(F.lit(2024), F.lit(60)))) == "2024-02-29 00:00:00"


@pytest.mark.parametrize("name, want", [("Band 4 (Red)", "band_4_red"), ("__X__", "x"), ("LST °C", "lst_c"), ("a--b", "a_b"),
                                        ("", "")])
def test_clean_name_both_ways(spark, name, want):
    assert clean_name(name) == want
    assert one(spark, scalar.clean_text(F.lit(name))) == want


def test_fixed_text_rounds_the_binary_value(spark):
    values = [2.25, 2.35, 2.45, 38.55, 0.15, -0.25, -0.04, 1.005, 1.015, 0.125, 0.0005, 12345678.25, 1e16, 0.0]
    values += [i / 1000 for i in range(-2000, 2000, 7)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").selectExpr(
        "v", *[f"{scalar.fixed_text('v', p)} AS t{p}" for p in (1, 2, 3)]).collect()
    for row in rows:
        for p in (1, 2, 3):
            assert row[f"t{p}"] == f"{row['v']:.{p}f}"


def test_json_rows(spark):
    df = spark.sql("SELECT 1.23456789D AS x, double('NaN') AS y, timestamp'2024-01-02 03:04:05' AS t, 'a' AS s, true AS b")
    assert scalar.json_rows(df).first()["json"] == \
        '{"x":1.234568,"y":null,"t":"2024-01-02T03:04:05+00:00","s":"a","b":true}'


def test_sql_literals(spark):
    rows = [("O'Neil \\ x", -1.5e-7, None), ("é", math.pi, 3)]
    got = scalar.literal_table(spark, ["a", "b", "c"], rows).collect()
    assert [tuple(r) for r in got] == rows
