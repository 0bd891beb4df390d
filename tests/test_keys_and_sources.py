"""Row keys, paging, readers by name, month folders, findings of odd tables."""

import math

import pytest
from pyspark.sql import functions as F

import fieldglass as fg
from fieldglass import runtime
from fieldglass.operators.browse import page_after
from fieldglass.operators.correlation import correlation_matrix, correlations
from fieldglass.operators.findings import findings, trend_finding
from fieldglass.operators.forest import fit_forest
from fieldglass.operators.regions import index_cards, regional_profile, summary
from fieldglass.sources import readers


def repeated(spark, kinds, n=20_000):
    return spark.range(n).select(F.col("id").alias("row_id"), F.sin(F.col("id") % kinds).alias("ndvi"), F.cos(F.col("id") % kinds).alias("ndwi"))


def test_repetitive_tables_give_full_trees_and_clusters(spark):
    df = repeated(spark, 40)
    _, psi = fit_forest(df, ["ndvi", "ndwi"], ["row_id"], 20_000, 20, 256, 42)
    assert psi == 256
    scored = fg.with_anomaly(df, method="forest")
    assert scored.select("anomaly_score").distinct().count() > 20 and scored.agg(F.max("anomaly_score")).first()[0] > 0.99
    zones = fg.clusters(df, restarts=2)
    assert zones.k >= 2 and zones.profiles.agg(F.sum("size")).first()[0] == 20_000 and zones.converged


def test_no_key_is_refused(spark):
    df = repeated(spark, 12, 2000).drop("row_id")
    for run in (lambda: fg.with_anomaly(df, method="forest"), lambda: fg.clusters(df), lambda: fg.browse(df, sort="ndvi")):
        with pytest.raises(ValueError, match="key"):
            run()


def test_row_keys_of_readers_prepare_and_materialise(spark, tmp_path):
    spark.range(5000).select(F.lit("2024-01-01").alias("date"), (F.col("id") % 3 / 3).alias("ndvi")).repartition(4).write.parquet(str(tmp_path / "obs"))
    read = fg.read_observations(spark, str(tmp_path / "obs"), "parquet")
    assert read.select("row_id").distinct().count() == 5000 and read.where("row_id IS NULL").count() == 0
    again = fg.read_observations(spark, str(tmp_path / "obs"), "parquet")
    assert read.exceptAll(again).count() == 0
    keyed = fg.prepare(spark.range(7).select("id", F.lit("2024-01-01").alias("date"), F.lit(0.5).alias("ndvi")), row_key=["id"])
    assert keyed.select("row_id").distinct().count() == 7
    stored = fg.materialise(fg.prepare(read.drop("row_id")), str(tmp_path / "stored"))
    assert stored.select("row_id").distinct().count() == 5000


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_by_key_visit_every_row_once(spark, order):
    rows = [(i, None if i % 5 == 0 else float(i % 3)) for i in range(23)]
    df = spark.createDataFrame(rows, "row_id int, v double").repartition(3)
    page, seen = fg.browse(df, sort="v", order=order, page_size=4).collect(), []
    while page:
        seen += [(r.row_id, r.v) for r in page]
        page = page_after(df, "v", page[-1].v, 4, order, "row_id", page[-1].row_id).collect()
    sign = 1 if order == "asc" else -1
    assert seen == sorted(rows, key=lambda r: (r[1] is None, sign * (r[1] or 0), r[0]))


def test_csv_files_are_put_together_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,red,nir\n2024-01-01,0.1,0.5\n")
    (tmp_path / "b.csv").write_text("date,nir,red,\n2024-01-02,0.5,0.1,x\n")
    got = fg.prepare(fg.read_observations(spark, str(tmp_path), "csv"))
    assert {round(r.ndvi, 6) for r in got.collect()} == {0.666667} and "unnamed_3" in got.columns


def test_feed_columns_in_any_order(spark, tmp_path):
    (tmp_path / "Pune.csv").write_text("YEAR,DOY,T2M,PRECTOTCORR\n2024,60,25.5,3.5\n")
    (tmp_path / "Port_Blair.csv").write_text("PRECTOTCORR,YEAR,T2M,DOY\n3.5,2024,-999,61\n")
    got = {r.region: r for r in fg.read_climate_feed(spark, str(tmp_path)).collect()}
    assert got["Pune"].temperature == 25.5 and got["Pune"].rainfall == got["Port Blair"].rainfall == 3.5
    assert got["Port Blair"].temperature is None and str(got["Port Blair"].timestamp)[:10] == "2024-03-01"


def test_dataset_folders_are_sources(spark, tmp_path):
    (tmp_path / "z.csv").write_text("a\n1\n")
    spark.range(3).write.parquet(str(tmp_path / "obs.parquet"))
    assert readers.choose_source(spark, str(tmp_path)).endswith("obs.parquet")


def test_time_bounds_prune_month_folders(spark, tmp_path):
    rows = [(i, f"202{y}-{m:02d}-15", 0.1 * m) for i, (y, m) in enumerate((y, m) for y in (3, 4) for m in range(1, 13))]
    stored = fg.materialise(fg.prepare(spark.createDataFrame(rows, "row_id int, date string, ndvi double")), str(tmp_path / "t"), by_month=True)
    series = fg.trend(stored, "ndvi", start="2023-11-01", end="2024-02-20")
    plan = series._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "obs_month" in plan.split("PartitionFilters:")[1].split("\n")[0]
    assert series.agg(F.sum("count")).first()[0] == 4
    assert summary(stored.withColumn("risk_score", F.lit(1.0))).first()["columns"] == len(stored.columns) - 2


def scored(spark, rows):
    df = spark.createDataFrame(rows, "row_id int, date string, ndvi double")
    return fg.prepare(df).withColumns({"risk_score": F.lit(10.0), "anomaly_flag": F.lit(False)})


def test_the_mean_of_the_trend_finding_counts_undated_rows(spark):
    df = scored(spark, [(1, "2024-01-01", 0.2), (2, "2024-02-01", 0.5), (3, "2024-02-02", 0.6), (4, None, 0.0)])
    assert trend_finding(df).first()["evidence"]["latest_mean"] == f"{1.3 / 4:.6f}"


def test_findings_of_one_indicator(spark):
    df = scored(spark, [(i, f"2024-0{1 + i % 3}-01", 0.1 * i) for i in range(9)])
    assert "INDICATOR CORRELATION" not in [r.category for r in findings(df).collect()]
    with pytest.raises(ValueError):
        correlations(df)


def test_reports_of_sparse_indicators(spark):
    df = spark.createDataFrame([(i, "2024-01-01", "Pune", 0.1 * i, None if i else 0.3, math.sin(i)) for i in range(6)],
                               "row_id int, date string, region string, ndvi double, ndbi double, evi double")
    df = fg.prepare(df).withColumn("risk_score", F.lit(1.0))
    assert "ndbi" not in regional_profile(df).columns
    square = {r.indicator: r for r in correlation_matrix(correlations(df), ["ndvi", "evi", "savi"]).collect()}
    assert set(square) == {"ndvi", "evi", "savi"} and square["savi"].ndvi is None and square["ndvi"].ndvi == 1.0
    cards = index_cards(df.withColumn("ndwi", F.lit(None).cast("double"))).collect()
    assert [c.ordinal for c in cards] == list(range(len(cards)))
    with pytest.raises(ValueError):
        index_cards(df, index="no such index")


def test_scratch_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_folder", lambda spark: str(tmp_path))
    path = runtime.scratch_path(spark, "x")
    spark.range(2).write.parquet(path)
    assert any(tmp_path.rglob("*.parquet"))
    runtime.clear_scratch(spark)
    assert not any(tmp_path.rglob("*.parquet"))
