"""Names, field resolution, timestamps, coordinates, states and preparation."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.operators import schema
from fieldglass.plans.catalogue import REGISTRY
from fieldglass.sources import readers, writers


def test_first_alias_wins():
    assert schema.resolve_fields(["lon", "x", "lat", "b8", "prectotcorr"]) == {
        "latitude": "lat", "longitude": "lon", "nir": "b8", "rainfall": "prectotcorr"}


def test_equal_names_keep_the_first(spark):
    df = spark.sql("SELECT 1 AS a, 2 AS b, 3 AS c")
    out = schema.adapt_names(df, ["B 4", "b4", "b_4"])
    assert out.columns == ["b_4", "b4"]
    assert tuple(out.first()) == (1, 2)


def test_csv_names_that_differ_in_case(spark, tmp_path):
    (tmp_path / "x.csv").write_text("B4,b4,Date\n0.1,0.9,2024-01-01\n,0.8,bad\n")
    df = readers.read_observations(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["b4", "date"]
    assert [r["b4"] for r in df.collect()] == [0.1, None]


def test_empty_csv_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        readers.read_observations(spark, str(tmp_path / "x.csv"))
    (tmp_path / "y.txt").write_text("a\n1\n")
    with pytest.raises(ValueError):
        readers.read_observations(spark, str(tmp_path / "y.txt"))


def test_source_choice_prefers_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a\n1\n")
    assert readers.choose_source(spark, str(tmp_path)).endswith("a.csv")
    spark.range(3).toPandas().to_parquet(tmp_path / "z.parquet")
    assert readers.choose_source(spark, str(tmp_path)).endswith("z.parquet")


def test_fingerprint_changes_with_content(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a\n1\n")
    first = readers.fingerprint(spark, str(tmp_path)).first()["fingerprint"]
    assert len(first) == 20 and first == readers.fingerprint(spark, str(tmp_path)).first()["fingerprint"]
    path.write_text("a\n1\n2\n")
    assert first != readers.fingerprint(spark, str(tmp_path)).first()["fingerprint"]


def test_climate_feed_files(spark, tmp_path):
    (tmp_path / "Pune.csv").write_text("YEAR,DOY,T2M,PRECTOTCORR\n2024,60,-999,1.5\n")
    (tmp_path / "Port_Blair.csv").write_text("YEAR,DOY,T2M,PRECTOTCORR\n2023,1,25.5,-999\n")
    rows = {r["region"]: r for r in readers.read_climate_feed(spark, str(tmp_path)).collect()}
    assert str(rows["Pune"]["timestamp"]) == "2024-02-29 00:00:00"
    assert rows["Pune"]["temperature"] is None and rows["Pune"]["rainfall"] == 1.5
    assert rows["Pune"]["latitude"] == 18.5204
    assert rows["Port Blair"]["temperature"] == 25.5 and rows["Port Blair"]["rainfall"] is None


def test_feed_without_required_columns(spark):
    with pytest.raises(ValueError):
        readers.normalise_climate_feed(spark.sql("SELECT 2024 AS year, 1 AS doy, 'Pune' AS region"))


@pytest.mark.parametrize("city, state", [("Pune", "Maharashtra"), ("pune", "India"), ("Atlantis", "India"), (None, "India")])
def test_state_lookup(spark, city, state):
    df = spark.createDataFrame([(city,)], "region string")
    assert schema.state_of_city(df, "region").first()["state"] == state


def test_coordinates_out_of_range(spark):
    df = spark.createDataFrame([(91.0, 10.0), (10.0, -181.0), (None, 5.0), (45.0, 90.0)], "lat double, lon double")
    got = [tuple(r) for r in schema.valid_coordinates(df, "lat", "lon").collect()]
    assert got == [(None, None), (None, None), (None, None), (45.0, 90.0)]


def test_prepare_coerces_bad_values(spark):
    df = spark.createDataFrame([("2024-01-01", "0.1", "0.5"), ("oops", "x", "NaN")], "dt string, b4 string, b8 string")
    rows = schema.prepare(df).collect()
    assert rows[0]["ndvi"] == pytest.approx(0.666667, abs=1e-6)
    assert rows[1]["b4"] is None and rows[1]["b8"] is None and rows[1]["ndvi"] is None and rows[1]["_timestamp"] is None


def test_timestamp_search_needs_enough_rows(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "x"), ("d", "y"), ("e", "z")],
                               "word string, seen string")
    assert schema.find_timestamp(df) == "seen"
    assert schema.find_timestamp(df.where("word IN ('b', 'c', 'd', 'e')")) is None


def test_numbers_are_not_timestamps_but_year_and_day_are(spark):
    df = spark.sql("SELECT 2024 AS year, 60 AS doy, 0.3D AS ndvi")
    assert str(schema.prepare(df).first()["_timestamp"]) == "2024-02-29 00:00:00"


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_text_exports_are_compressed_unless_told_otherwise(spark, tmp_path, fmt):
    df = spark.range(5000).select(F.col("id").cast("string").alias("row_id"), (F.col("id") / 7).alias("score"))
    size = lambda path: sum(f.stat().st_size for f in Path(path).glob("part-*"))
    packed = writers.export(df, str(tmp_path / "packed"), fmt)
    plain = writers.export(df, str(tmp_path / "plain"), fmt, "none")
    read = lambda path: sorted(map(tuple, spark.read.schema(df.schema).option("header", True).format(fmt).load(path).collect()))
    assert 2 * size(packed) < size(plain)
    assert read(packed) == read(plain) and len(read(packed)) == 5000


def test_synthetic_timeline(spark):
    df = spark.range(5).select(F.col("id").alias("value"), F.lit(0.1).alias("ndvi"))
    with pytest.raises(ValueError):
        schema.prepare(df)
    rows = schema.prepare(df, order_key=["value"]).orderBy("value").collect()
    assert [str(r["_timestamp"])[:10] for r in rows] == ["2023-01-01", "2023-01-02", "2023-01-03", "2023-01-04", "2023-01-05"]


def test_long_timeline_keeps_its_days(spark):
    stamped = schema.with_timestamp(spark.range(2_914_000), {}, order_key=["id"])
    assert stamped.where("_timestamp IS NULL").count() == 0
    ends = stamped.where("id IN (2900000, 2913900)").orderBy("id").selectExpr("date_format(_timestamp, 'yyyy-MM-dd') AS day").collect()
    assert [r["day"] for r in ends] == ["9962-12-07", "+10000-12-27"]


def test_timeline_ends_with_the_last_timestamp(spark):
    ends = spark.sql(f"SELECT unix_micros(CAST(date_add(DATE'{V.TIMELINE_START}', {V.TIMELINE_DAYS - 1}) AS TIMESTAMP)) AS u").first()
    assert 0 < 2 ** 63 - ends["u"] <= 86_400_000_000


def test_timeline_query_writes_long_years_as_sql_does(ws, monkeypatch):
    monkeypatch.setattr(V, "TIMELINE_START", "9999-12-31")
    days = [r["day"] for r in REGISTRY["n7_synthetic_timeline"].run(ws).orderBy("event_id").limit(2).collect()]
    assert days == ["9999-12-31", "10000-01-01"]


def test_stand_ins_without_any_climate_column(spark):
    df = spark.sql("SELECT timestamp'2023-07-19' AS date, 'Pune' AS city")
    row = schema.prepare(df).first()
    assert 0.08 <= row["ndvi"] <= 0.88 and row["state"] == "Maharashtra"


def test_all_rain_missing_gives_missing_index(spark):
    df = spark.sql("SELECT timestamp'2023-07-19' AS date, CAST(NULL AS DOUBLE) AS rain, 30D AS temp")
    assert schema.prepare(df).first()["ndvi"] is None


def test_constant_features_and_counts(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 2D), (3D, NULL) AS t(ndvi, temp)")
    assert schema.numeric_features(df) == ["ndvi"]


def test_materialise_by_month(spark, ws, tmp_path):
    stored = writers.materialise(ws.climate, str(tmp_path / "t"), view="obs_test", by_month=True)
    assert stored.count() == ws.climate.count()
    plan = stored.where("obs_year = 2024 AND obs_month = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(obs_year" in plan


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_export_round_trip(spark, tmp_path, fmt):
    df = spark.sql("SELECT 1 AS a, 0.5D AS b, map('k', 'v') AS m")
    path = writers.export(df, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).format(fmt).load(path).count() == 1
    with pytest.raises(ValueError):
        writers.export(df, path, "xlsx")
