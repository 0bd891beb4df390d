"""Pages by number, and the counts, shares and joins behind the reports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import fieldglass as fg
from fieldglass.operators.findings import union_findings
from fieldglass.operators.pages import page_at, page_index

SCHEMA = "row_id int, v double, extra string"


def _rows(n=1700):
    """Ties (a third of all rows equal), missing values, and values of their own."""
    return [(i, None if i % 7 == 0 else 5.0 if i % 3 == 0 else float(i % 400), f"x{i}") for i in range(n)]


def _ordered(rows, order):
    sign = -1 if order == "desc" else 1
    return [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, sign * (r[1] or 0.0), r[0]))]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "t")
    spark.createDataFrame(_rows(), SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_every_page_is_the_slice_of_the_sorted_rows(spark, stored, order, tmp_path):
    page_index(stored, "v", order, stride=500, range_rows=300).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == 4  # 1,700 rows
    expected = _ordered(_rows(), order)
    for page, size in [(1, 50), (2, 50), (11, 50), (17, 100), (6, 90), (4, 499), (4, 500), (34, 50), (35, 50), (5, 500), (100, 500)]:
        got = [r.row_id for r in page_at(stored, index, page, size).collect()]
        assert got == expected[(page - 1) * size: page * size], (page, size)


def test_pages_by_key_alone_and_of_an_empty_table(stored):
    index = page_index(stored, "no such column", stride=500)
    assert [r.row_id for r in page_at(stored, index, 3, 200).collect()] == list(range(400, 600))
    empty = stored.limit(0)
    none = page_at(empty, page_index(empty, "v"), 1)
    assert none.count() == 0 and none.columns == stored.columns
    with pytest.raises(ValueError):
        page_at(stored, index, 0)
    with pytest.raises(ValueError):
        page_index(stored, "v", stride=10)


def test_a_deep_page_reads_a_bounded_range(spark, stored):
    """The bounds of both entries reach the scan as comparisons."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # filters are printed whole
    index = page_index(stored, "v", stride=500)
    plan = page_at(stored, index, 15, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(v" in plan and "LessThan(v" in plan


def test_flagged_pages_follow_each_other(spark):
    rows = [(i, float(i % 4) / 4, i % 5 != 0, "High") for i in range(60)]
    scored = spark.createDataFrame(rows, "row_id int, anomaly_score double, anomaly_flag boolean, severity string")
    expected = [r[1] for r in sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))]
    ids = [r[0] for r in sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))]
    page = fg.flagged_after(scored, expected[9], ids[9], page_size=10).collect()
    assert [r.anomaly_score for r in page] == expected[10:20]
    assert fg.flagged_after(scored, expected[-1], ids[-1]).count() == 0


def test_counts_and_shares_with_missing_values(spark):
    rows = [("a", 61.0, -0.2), ("a", 80.0, None), ("a", None, -0.1), ("b", 50.0, 0.3), (None, 79.9, -0.5)]
    scored = spark.createDataFrame(rows, "place string, risk_score double, ndwi double")
    assert fg.threshold_counts(scored).first() == (3, 1, 3, 2)
    assert fg.threshold_counts(scored.drop("ndwi")).first()["stressed"] == 0
    assert fg.threshold_counts(scored.limit(0)).first() == (0, 0, 0, 0)
    assert fg.threshold_counts(scored, ["place"]).count() == 3
    assert fg.distinct_counts(scored, ["place", "ndwi"]).first() == (2, 4)
    assert fg.distinct_counts(scored, ["place"], error=0.05).first() == (2,)
    shares = {r.place: r.share for r in fg.share_of_rows(scored, F.col("ndwi") < -0.1, ["place"]).collect()}
    assert shares == {"a": pytest.approx(100 / 3), "b": 0.0, None: 100.0}
    spread = fg.deviations(scored.where("place = 'a'"), "risk_score").first()
    assert (spread.population, spread["sample"]) == (pytest.approx(9.5), pytest.approx(9.5 * 2 ** 0.5))
    assert fg.deviations(scored.where("place = 'b'"), "risk_score").first() == (0.0, None)


def test_scores_are_attached_by_key(spark):
    rows = spark.createDataFrame([(1, "a", 9.0), (2, "b", 9.0), (3, None, 9.0)], "row_id int, place string, score double")
    scores = spark.createDataFrame([(1, 0.5, "x"), (3, None, "y"), (4, 0.9, "z")], "row_id int, score double, place string")
    got = {r.row_id: (r.place, r.score) for r in fg.attach_scores(rows, scores, ["score"]).collect()}
    assert got == {1: ("a", 0.5), 2: ("b", None), 3: (None, None)}
    got = {r.row_id: r.score for r in fg.attach_scores(rows, scores, ["score"], missing=0.0).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0}
    assert fg.attach_scores(rows, scores.limit(0), ["score"]).count() == 3


def test_report_of_scores_computed_apart(spark):
    anomalies = spark.createDataFrame([(1, 0.5, True, "High"), (2, 0.1, False, "Low")],
                                      "row_id int, anomaly_score double, anomaly_flag boolean, severity string")
    risks = spark.createDataFrame([(2, 10.0, "Low", 4.0)], "row_id int, risk_score double, risk_level string, water_contribution double")
    out = {r.row_id: r.risk_score for r in fg.report(anomalies, "anomalies", risks).collect()}
    assert out == {1: None, 2: 10.0}


def test_stations_and_findings_are_united(spark):
    one = spark.createDataFrame([(2024, 1, 3.0)], "YEAR int, DOY int, T2M double")
    two = spark.createDataFrame([(2024, 2, 4.0, 1.5)], "YEAR int, DOY int, T2M double, PRECTOTCORR double")
    got = fg.union_stations({"Pune": one, "Delhi": two, None: two.limit(0)})
    assert sorted((r.region, r.T2M, r.PRECTOTCORR) for r in got.collect()) == [("Delhi", 4.0, 1.5), ("Pune", 3.0, None)]
    with pytest.raises(ValueError):
        fg.union_stations({})
    rows = spark.createDataFrame([(5, "e"), (2, "b")], "ordinal int, category string")
    assert [r.ordinal for r in union_findings([rows, rows.where("false"), rows.selectExpr("ordinal + 1 AS ordinal", "category")]).collect()] == [2, 3, 5, 6]
