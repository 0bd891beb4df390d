"""Trends, scores, regions, points, paging, findings and intake."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.operators import anomaly, browse, cluster, findings, points, regions, reports, risk, trends
from fieldglass.operators.schema import prepare
from fieldglass.plans.catalogue import REGISTRY
from fieldglass.plans.tables import Workspace
from fieldglass.streaming.intake import take_in


def stamped(spark, rows):
    return spark.createDataFrame(rows, "at string, ndvi double").select(
        F.to_timestamp("at").alias("_timestamp"), "ndvi")


# --- trends -------------------------------------------------------------------------------------


def test_week_is_named_by_its_sunday(spark):
    df = stamped(spark, [("2024-01-07 23:59:00", 1.0), ("2024-01-08 00:00:00", 2.0)])
    got = sorted(str(r["bucket"])[:10] for r in trends.trend(df, "ndvi", "weekly").collect())
    assert got == ["2024-01-07", "2024-01-14"]


@pytest.mark.parametrize("every, rule", [("daily", "D"), ("weekly", "W"), ("monthly", "MS"), ("quarterly", "QS"), ("yearly", "YS")])
def test_buckets_match_pandas(ws, every, rule):
    got = trends.trend(ws.obs, "ndvi", every).orderBy("bucket").toPandas()
    frame = ws.obs.select("_timestamp", "ndvi").toPandas().dropna().set_index("_timestamp")["ndvi"].astype("float64")
    want = frame.resample(rule).agg(["mean", "min", "max", "count"]).dropna(subset=["mean"])
    assert list(got["bucket"]) == list(want.index)
    np.testing.assert_allclose(got[["mean", "min", "max", "count"]], want, atol=1e-12)


@pytest.mark.parametrize("rows, want", [
    ([("2024-01-05", 2.0), ("2024-02-05", 5.0)], 150.0),
    ([("2024-01-05", 0.0), ("2024-02-05", 5.0)], None),
    ([("2024-01-05", 2.0)], None),
    ([("2024-01-05", None), ("2024-02-05", 4.0), ("2024-03-05", 3.0)], -25.0),
])
def test_net_change(spark, rows, want):
    got = trends.trend_change(trends.trend(stamped(spark, rows), "ndvi")).first()["change_percent"]
    assert got == (None if want is None else pytest.approx(want))


def test_time_bounds_are_inclusive_and_bad_ones_ignored(spark):
    df = stamped(spark, [("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-02 00:00:01", 3.0)])
    assert trends.in_time(df, "2024-01-01", "2024-01-02").count() == 2
    assert trends.in_time(df, "rubbish", None).count() == 3
    assert trends.trend(df, "ndvi", start="2030-01-01").count() == 0


def test_time_and_region_filters_reach_the_scan(spark, ws):
    plan = trends.trend(ws.obs, "ndvi", region="NATION_3", start="1997-01-01")._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line][0]
    assert "GreaterThanOrEqual(_timestamp" in scan and "EqualTo(region,NATION_3)" in scan
    assert "ReadSchema: struct<region:string,_timestamp:timestamp,ndvi:double>" in scan


def test_trend_of_text_is_refused(ws):
    with pytest.raises(ValueError):
        trends.trend(ws.obs, "region")


def test_rolling_and_slope(spark):
    df = stamped(spark, [(f"2024-01-{d:02d}", float(d * d)) for d in range(1, 15)])
    series = trends.trend(df, "ndvi", "daily")
    want = pd.Series([float(d * d) for d in range(1, 15)])
    band = trends.rolling_band(series).orderBy("bucket").toPandas()
    np.testing.assert_allclose(band["moving_average"], want.rolling(7, min_periods=1).mean())
    np.testing.assert_allclose(band["rolling_std"].astype(float), want.rolling(7, min_periods=1).std())
    slope, intercept = np.polyfit(range(14), want, 1)
    got = trends.trend_slope(series).first()
    assert got["slope"] == pytest.approx(slope) and got["intercept"] == pytest.approx(intercept)
    assert [str(r["bucket"])[:10] for r in trends.latest_buckets(series, 2).collect()] == ["2024-01-13", "2024-01-14"]


# --- anomaly and risk ---------------------------------------------------------------------------


def test_few_rows_use_z_scores(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1, 1, 1, 9])], "row_id int, ndvi double")
    got = anomaly.with_anomaly(df).orderBy("row_id").toPandas()
    values = pd.Series([1, 1, 1, 1, 9.0])
    want = ((values - values.mean()) / values.std(ddof=0)).abs().div(4).clip(0, 1)
    np.testing.assert_allclose(got["anomaly_score"], want)


def test_constant_and_missing_features(spark):
    df = spark.createDataFrame([(i, 0.5, None) for i in range(10)], "row_id int, ndvi double, temp double")
    got = anomaly.with_anomaly(df, method="zscore").agg(F.max("anomaly_score"), F.count_if("anomaly_flag")).first()
    assert tuple(got) == (0.0, 0)
    assert risk.with_risk(anomaly.with_anomaly(df, method="zscore")).where("risk_score IS NULL").count() == 0


def planted(spark, n=3000):
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(n)]
    rows += [(n + i, 9.0 + i, -9.0 - i) for i in range(3)] + [(n + 3, None, None), (n + 4, 0.1, None)]
    return spark.createDataFrame(rows, "row_id int, ndvi double, ndwi double")


def test_forest_properties(spark):
    df = planted(spark)
    scored = anomaly.with_anomaly(df, method="forest").toPandas().set_index("row_id")["anomaly_score"]
    assert scored.between(0, 1).all() and scored.max() == pytest.approx(1.0, abs=1e-6)
    assert scored[3003] == 0.0  # nothing to go by
    assert set(scored.nlargest(3).index) == {3000, 3001, 3002}
    assert scored.median() < 0.4
    again = anomaly.with_anomaly(df.repartition(11), method="forest").toPandas().set_index("row_id")["anomaly_score"]
    pd.testing.assert_series_equal(scored.sort_index(), again.sort_index())
    other = anomaly.with_anomaly(df, method="forest", seed=1).toPandas().set_index("row_id")["anomaly_score"]
    assert not other.sort_index().equals(scored.sort_index())


def test_forest_draws_full_samples_without_replacement_at_every_size(spark):
    from fieldglass.operators.forest import tree_samples

    rows = spark.range(20000).select(F.col("id").alias("row_id"), F.rand(1).alias("x"))
    drawn = tree_samples(rows, ["row_id"], 20000, 8, 64, 42)
    sizes = drawn.groupBy("tree").count().collect()
    assert len(sizes) == 8 and all(r["count"] == 64 for r in sizes)
    assert drawn.select("tree", "row_id").distinct().count() == 8 * 64
    few = tree_samples(rows.limit(100), ["row_id"], 100, 8, 64, 42).groupBy("tree").count().collect()
    assert len(few) == 8 and all(r["count"] == 64 for r in few)


def test_contamination_flags_the_top(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") / 100).alias("anomaly_score"))
    assert anomaly.flag_top_fraction(df, 0.1).where("contaminated").count() == 10


def test_risk_golden_row(spark):
    """ndvi .6, ndwi -.2, ndbi .1, temperature rank .75, rain rank .5, no anomaly: 41.85, Elevated."""
    rows = [(0, .6, -.2, .1, 3.0, 2.0), (1, 0., 0., 0., 1.0, 1.0), (2, 0., 0., 0., 2.0, 3.0), (3, 0., 0., 0., 4.0, 4.0)]
    df = spark.createDataFrame(rows, "row_id int, ndvi double, ndwi double, ndbi double, temperature double, rainfall double")
    row = risk.with_risk(df.withColumn("anomaly_score", F.lit(0.0))).where("row_id = 0").first()
    assert row["risk_score"] == pytest.approx(41.85) and row["risk_level"] == "Elevated"


def test_contributions_add_up_whatever_the_partitioning(ws):
    parts = [c for c in ws.scored.columns if c.endswith("_contribution")]
    gap = ws.scored.agg(F.max(F.abs(sum(F.col(p) for p in parts) - F.col("risk_score")))).first()[0]
    assert len(parts) == 6 and gap < 1e-9 and sum(V.RISK_WEIGHTS.values()) == pytest.approx(1)
    plain = ws.scored.drop(*parts, "risk_score", "risk_level").repartition(9)
    again = risk.with_risk(plain, range_rows=500).select("row_id", F.col("risk_score").alias("again"))
    joined = ws.scored.select("row_id", "risk_score").join(again, "row_id")
    assert joined.count() == ws.scored.count()
    assert joined.where(F.abs(F.col("again") - F.col("risk_score")) > 1e-9).count() == 0


def test_part_without_values_counts_fifty(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS ndvi, 0D AS anomaly_score")
    assert risk.with_risk(df).first()["risk_score"] == pytest.approx(50 * .28 / .41)


# --- clusters -----------------------------------------------------------------------------------


def blobs(spark, n=300):
    rng = np.random.default_rng(4)
    rows = [(i, float((i % 3) * 5 + rng.normal() * .2), float((i % 3) * -4 + rng.normal() * .2)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id int, ndvi double, ndwi double")


def test_clusters_find_the_groups(spark):
    df = blobs(spark)
    zones = cluster.clusters(df, restarts=4)
    assert zones.k == 3 and zones.silhouette > 0.8
    got = zones.assigned.toPandas()
    assert got.groupby(got["row_id"] % 3)["cluster"].nunique().eq(1).all()
    profiles = zones.profiles.toPandas()
    assert profiles["size"].sum() == 300 and profiles["description"].str.contains("vegetation|canopy").all()
    capped = cluster.clusters(df, restarts=4, sample_cap=60)  # starts from a sample, refined over all rows
    assert capped.k == 3 and capped.profiles.toPandas()["size"].tolist() == [100, 100, 100]
    assert cluster.clusters(df, k=2, restarts=2).profiles.count() == 2


def test_silhouettes_match_brute_force(spark):
    points_ = np.array([[r["ndvi"], r["ndwi"]] for r in blobs(spark, 60).orderBy("row_id").collect()])
    models = {2: [[0., 0.], [8., -6.]], 3: [[0., 0.], [5., -4.], [10., -8.]]}
    got = cluster.mean_silhouettes(spark, spark.sparkContext.broadcast(points_), 60, models)
    distance = np.sqrt(((points_[:, None] - points_[None]) ** 2).sum(2))
    for k, centres in models.items():
        label = ((points_[:, None] - np.array(centres)[None]) ** 2).sum(2).argmin(1)
        values = []
        for i in range(60):
            own = label == label[i]
            a = distance[i][own].sum() / (own.sum() - 1)
            b = min(distance[i][label == c].mean() for c in set(label) - {label[i]})
            values.append((b - a) / max(a, b))
        assert got[k] == pytest.approx(np.mean(values), abs=1e-6)


def matrix_of(spark, n):
    return blobs(spark, n).select("ndvi", "ndwi").repartition(5)


def test_squared_silhouettes_match_brute_force(spark):
    df = matrix_of(spark, 60)
    points_ = np.array([[r["ndvi"], r["ndwi"]] for r in df.collect()])
    models = {2: np.array([[0., 0.], [8., -6.]]), 3: np.array([[0., 0.], [5., -4.], [10., -8.]]), 4: np.array([[5., -4.], [99., 99.], [99., -99.], [-99., 99.]])}
    got = cluster.squared_silhouettes(df, 2, models)
    distance = ((points_[:, None] - points_[None]) ** 2).sum(2)
    for k in (2, 3):
        label = ((points_[:, None] - models[k][None]) ** 2).sum(2).argmin(1)
        values = []
        for i in range(60):
            own = label == label[i]
            a = distance[i][own].sum() / (own.sum() - 1)
            b = min(distance[i][label == c].mean() for c in set(label) - {label[i]})
            values.append((b - a) / max(a, b))
        assert got[k] == pytest.approx(np.mean(values), abs=1e-9)
    assert got[4] == -1.0  # one cluster in use


def test_refined_centres_are_means_of_their_rows(spark):
    df = matrix_of(spark, 300)
    points_ = np.array([[r["ndvi"], r["ndwi"]] for r in df.collect()])
    starts = {2: points_[:2], 3: np.array([[1., -1.], [4., -3.], [9., -9.]])}
    models, rested = cluster.refine(df, 2, starts, 100, 1e-4)
    assert rested == {2, 3}
    for centres in models.values():
        label = ((points_[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for c in set(label):
            assert centres[c] == pytest.approx(points_[label == c].mean(0), abs=1e-3)
    sums = cluster.cluster_sums(df, 2, [models[3]])[0]
    assert sums[:, 0].tolist() == [100, 100, 100] and sums[:, 1].sum() == pytest.approx((points_ ** 2).sum())
    assert cluster.refine(df, 2, starts, 1, 1e-9)[1] == set()  # one round does not suffice


def test_clusters_of_few_different_points(spark):
    df = spark.range(500).selectExpr("id AS row_id", "CAST(id % 2 AS DOUBLE) AS ndvi", "CAST(id % 2 AS DOUBLE) AS ndwi")
    zones = cluster.clusters(df, restarts=2)
    assert zones.k == 2 and sorted(zones.profiles.toPandas()["size"]) == [250, 250] and zones.silhouettes[2] == pytest.approx(1.0)


def test_packed_points_are_the_same_points(spark):
    df = spark.range(1000).selectExpr("id / 7D AS a", "id % 13 - 5D AS b", "xxhash64(id) AS h").repartition(3)
    packed = df.mapInArrow(cluster.pack_points(2), "points binary, keys binary")
    assert packed.count() < 40
    drawn = np.array([[1.0, 2.0], [90.0, -3.0]])
    for one, other in zip(cluster.cluster_sums(df, 2, [drawn, drawn[:1]]), cluster.cluster_sums(packed, 2, [drawn, drawn[:1]])):
        np.testing.assert_allclose(one, other)
    (far, cost), (far_packed, cost_packed) = (cluster.far_points(m, 2, drawn, 1e5, 1, 20.0) for m in (df, packed))
    assert cost == pytest.approx(cost_packed) and len(far) and far.tolist() == far_packed.tolist()
    models = {2: drawn}
    assert cluster.squared_silhouettes(df, 2, models)[2] == pytest.approx(cluster.squared_silhouettes(packed, 2, models)[2])
    assert cluster.cluster_sums(packed.limit(0), 2, [drawn])[0].sum() == 0


def test_clusters_read_packed_points(spark, monkeypatch):
    read, plain = [], cluster.refine
    monkeypatch.setattr(cluster, "refine", lambda matrix, *rest: read.append(matrix.columns) or plain(matrix, *rest))
    cluster.clusters(blobs(spark))
    assert read == [["points", "keys"]]


def test_scores_from_raw_read_the_sources_once(ws):
    files = REGISTRY["r9_score_from_raw"].run(ws).inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_forest_query_reads_no_risk(ws):
    assert not any(c.startswith("risk") for c in ws.forest_anomaly.columns) and {"risk_score", "anomaly_score"} <= set(ws.forest.columns)


def test_clusters_need_enough(spark):
    with pytest.raises(ValueError):
        cluster.clusters(blobs(spark, 11))
    with pytest.raises(ValueError):
        cluster.clusters(blobs(spark).select("row_id", "ndvi"))


# --- reports ------------------------------------------------------------------------------------


def test_findings_without_scores_write_no_table(spark, ws, sf_dir):
    """Findings 1 to 4 and 7 show no score: neither the prepared nor the scored table is made for them."""
    fresh = Workspace(spark, sf_dir)
    whole = {r["ordinal"]: r for r in REGISTRY["i9_findings"].run(ws).collect()}
    names = ("i1_vegetation_trend", "i2_moisture", "i3_heat", "i4_rain", "i7_strongest_pair")
    for name in names:
        got = REGISTRY[name].run(fresh).collect()
        assert got == [whole[i] for i in [int(name[1])] if i in whole], name
    assert not {"obs", "scored"} & set(vars(fresh))
    assert {1, 2, 3, 4} <= set(whole)


def test_findings_read_once_write_no_scored_rows(spark, ws, sf_dir):
    fresh = Workspace(spark, sf_dir)
    whole = {r["ordinal"]: r for r in REGISTRY["i9_findings"].run(ws).collect()}
    for name in ("i5_anomalies", "i6_region_extremes", "i8_risk_counts"):
        assert REGISTRY[name].run(fresh).collect() == [whole[int(name[1])]], name
    assert "scored" not in vars(fresh)


def test_level_findings_without_scores(spark):
    rows = spark.createDataFrame([(0.5, 20.0), (None, None), (-0.5, 31.0)], "ndwi double, temperature double")
    plain = findings.level_findings(rows, {"temperature": "temperature"}).collect()
    scored = findings.level_findings(rows.withColumns({"anomaly_flag": F.lit(True), "risk_score": F.lit(80.0)}), {"temperature": "temperature"})
    assert [r["ordinal"] for r in plain] == [2, 3] and scored.where("ordinal < 4").collect() == plain
    assert [r["category"] for r in scored.where("ordinal > 3").collect()] == ["ML ANOMALY OUTLIERS", "RISK STRATIFICATION"]


def test_summary_reads_few_columns_without_expanding(ws):
    plan = regions.summary(ws.scored)._jdf.queryExecution().executedPlan().toString()
    first_stage = plan[plan.rindex("FileScan") - 3000:] if len(plan) > 3000 else plan
    assert "red" not in plan[plan.rindex("ReadSchema"):] and "Expand" not in first_stage[first_stage.rindex("partial_sum"):]


def test_region_ranks_both_ways(ws):
    profile = regions.regional_profile(ws.scored)
    small = {r["region"]: r["risk_rank"] for r in regions.rank_regions(profile).collect()}
    large = {r["region"]: r["risk_rank"] for r in regions.rank_regions(profile, range_rows=5).collect()}
    order = [r["region"] for r in profile.collect()]
    assert small == large and [small[r] for r in order] == sorted(small.values())


def test_region_ranks_when_means_differ_in_their_last_bits(spark):
    """As sums of the same rows do when tasks end in another order."""
    noise = F.udf(lambda: random.random() * 1e-9, "double").asNondeterministic()
    profile = spark.range(12).select(F.col("id").alias("region"), (F.col("id") + noise()).alias("risk_score"))
    found = {r["region"]: r["risk_rank"] for r in regions.rank_regions(profile).collect()}
    assert found == {i: 12 - i for i in range(12)}


def test_points_filters_and_cap(ws):
    everything = points.points(ws.scored)
    some = points.points(ws.scored, cap=4)
    assert some.count() == 4 and everything.count() > 4
    again = points.points(ws.scored.repartition(5), cap=4)
    assert [r["region"] for r in some.collect()] == [r["region"] for r in again.collect()]
    total = points.matching_total(ws.scored, anomalies_only=True).first()[0]
    assert total == ws.scored.where("anomaly_flag").count()


def test_pages(ws):
    with pytest.raises(ValueError):
        browse.browse(ws.obs, page_size=501)
    first, second = browse.browse(ws.obs, sort="ndvi", page_size=3), browse.browse(ws.obs, sort="ndvi", page=2, page_size=3)
    keys = [r["row_id"] for r in first.collect() + second.collect()]
    assert len(set(keys)) == 6
    assert "TakeOrderedAndProject" in first._jdf.queryExecution().executedPlan().toString()
    assert browse.browse(ws.obs, search="no such text").count() == 0
    assert reports.flagged(ws.scored, severity="HIGH").where("severity <> 'High'").count() == 0


def test_search_is_literal(spark):
    df = spark.createDataFrame([("a.b",), ("aXb",), (None,)], "row_id string")
    assert [r[0] for r in browse.search_rows(df, "A.B").collect()] == ["a.b"]


def test_health(spark, ws):
    assert browse.health(ws.obs).first()["status"] == "healthy"
    bad = browse.health(ws.obs.limit(0), "no file").first()
    assert (bad["status"], bad["dataset_available"], bad["dataset_error"]) == ("degraded", False, "no file")


def test_findings_skip_rules_without_a_result(spark):
    df = spark.createDataFrame([(0.5, 10.0, False)] * 3, "ndvi double, risk_score double, anomaly_flag boolean").withColumn(
        "_timestamp", F.lit("2024-01-01").cast("timestamp")).withColumn("ndwi", F.lit(0.1))
    got = findings.findings(df).collect()
    assert [r["category"] for r in got] == ["HYDROLOGY & MOISTURE", "RISK STRATIFICATION"]
    assert got[0]["statement"].startswith("Surface moisture index (NDWI) averages 0.100; 0.0% of observations")
    texts = findings.recommendations(findings.findings(df)).collect()
    assert len(texts) == 5 and [t["finding"] is not None for t in texts] == [True, False, False, False, False]


def test_findings_in_order(ws):
    got = findings.findings(ws.scored).collect()
    assert [r["ordinal"] for r in got] == sorted(r["ordinal"] for r in got)
    assert [r["ordinal"] for r in findings.first_findings(findings.findings(ws.scored)).collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("kind", reports.KINDS)
def test_report_kinds(ws, kind):
    assert reports.report(ws.scored, kind).count() > 0
    with pytest.raises(ValueError):
        reports.report(ws.scored, "other")


# --- intake and contract ------------------------------------------------------------------------


def test_intake_skips_known_files(spark, tmp_path):
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    rows = spark.sql("SELECT timestamp'2024-05-01' AS `Obs Date`, 0.1D AS B4, 0.5D AS B8, 'Pune' AS City")
    rows = rows.withColumnRenamed("Obs Date", "Observation Date")
    rows.write.parquet(source)
    assert take_in(spark, source, rows.schema, target, progress) == 1
    assert take_in(spark, source, rows.schema, target, progress) == 0
    rows.union(rows).write.mode("append").parquet(source)
    assert take_in(spark, source, rows.schema, target, progress) == 2
    stored = spark.read.parquet(target)
    assert stored.count() == 3 and stored.where("ndvi > 0.66 AND state = 'Maharashtra'").count() == 3


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns == ["state", "bucket", "mean", "min", "max", "count", "change_percent"]
    names, checks = contract.queries(), contract.oracle_sql()
    assert set(checks) <= set(names) and len(names) > 150


def test_scratch_folder_must_be_shared(spark, monkeypatch):
    from fieldglass import runtime

    class Context:
        master = "spark://somewhere:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        runtime.shared_folder(Session())
    assert runtime.shared_folder(spark)


def test_prepared_is_the_same_on_any_partitioning(spark, ws):
    again = prepare(ws.climate.select("row_id", "timestamp", "region", "temperature", "rainfall").repartition(13))
    both = again.select("row_id", "ndvi", "nbr").exceptAll(ws.climate.select("row_id", "ndvi", "nbr"))
    assert both.count() == 0
