"""Exact ranks, positions, quantiles and correlations against pandas, and the shape of their plans."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldglass.operators import distribution as D
from fieldglass.plans import tables
from fieldglass.operators.correlation import correlation_matrix, correlations, strongest

SAMPLE = [5.0, 1.0, 3.0, 3.0, None, 9.0, 2.0, 2.0, 2.0, 7.5]


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")


def mixed(n=4000, seed=1):
    """A third of the rows share one value, some are missing, the rest are spread out."""
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < 0.34, 0.0, rng.normal(size=n))
    return [None if rng.random() < 0.05 else float(x) for x in v]


def test_golden_sample(spark):
    df = frame(spark, SAMPLE)
    q = D.exact_quantiles(df, {"v": (F.col("v"), [0.92, 0.5, 0.0, 1.0])})["v"]
    assert q == pytest.approx([8.04, 3.0, 1.0, 9.0])
    ranks = {r["id"]: r["pct"] for r in D.with_percent_rank(df, {"v": "pct"}).collect()}
    assert ranks[6] == pytest.approx(1 / 3) and ranks[4] is None


@pytest.mark.parametrize("limits", [{}, {"range_rows": 200}])
def test_percent_rank_matches_pandas(spark, limits):
    values = mixed()
    got = D.with_percent_rank(frame(spark, values).repartition(7), {"v": "pct"}, **limits).orderBy("id").toPandas()
    want = pd.Series(values, dtype="float64").rank(pct=True)
    assert len(got) == len(values)
    np.testing.assert_allclose(got["pct"].astype("float64"), want, rtol=0, atol=1e-12)


@pytest.mark.parametrize("limits", [{}, {"range_rows": 20}])
def test_quantiles_match_pandas(spark, limits):
    a, b = mixed(seed=2), [float(i % 10) for i in range(4000)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double").repartition(5)
    qs = [0.0, 0.08, 0.25, 0.5, 0.75, 0.92, 1.0]
    got = D.exact_quantiles(df, {"a": (F.col("a"), qs), "b": (F.col("b"), qs)}, **limits)
    for name, values in (("a", a), ("b", b)):
        assert got[name] == pytest.approx(list(pd.Series(values, dtype="float64").quantile(qs)), abs=1e-12)


def test_quantiles_when_every_partition_is_different(spark):
    """Sorted data: each sketch sees another range, so the brackets are wide and still right."""
    df = spark.range(0, 20000, 1, 40).select((F.col("id") * 1.5).alias("v"))
    got = D.exact_quantiles(df, {"v": (F.col("v"), [0.1, 0.5, 0.999])})["v"]
    assert got == pytest.approx(list(pd.Series(np.arange(20000) * 1.5).quantile([0.1, 0.5, 0.999])))


def test_quantiles_survive_a_wrong_bracket(spark, monkeypatch):
    df = frame(spark, mixed(seed=5))
    real, calls = D._locate, []

    def wrong_first(plain, brackets, *rest):
        calls.append(brackets)
        if len(calls) == 1:
            brackets = {k: (c, 100.0, 101.0) for k, (c, _, _) in brackets.items()}
        return real(plain, brackets, *rest)

    monkeypatch.setattr(D, "_locate", wrong_first)
    got = D.exact_quantiles(df, {"v": (F.col("v"), [0.5])})["v"][0]
    assert len(calls) == 2 and got == pytest.approx(pd.Series(mixed(seed=5), dtype="float64").median())


def test_quantiles_of_nothing(spark):
    df = frame(spark, [None, None])
    assert D.exact_quantiles(df, {"v": (F.col("v"), [0.5])}) == {"v": [None]}
    ranks = D.RankTable(df, {"v": F.col("v")})
    assert ranks.counts == {"v": 0} and ranks.medians == {"v": None}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=40))
def test_ranks_and_medians_property(spark, values):
    df = frame(spark, values)
    ranks = D.RankTable(df, {"v": F.col("v")})
    got = ranks.attach(df, "v", F.col("v"), "pct").orderBy("id").toPandas()["pct"].astype("float64")
    want = pd.Series(values, dtype="float64").rank(pct=True)
    np.testing.assert_allclose(got, want, atol=1e-12)
    if want.notna().any():
        assert ranks.medians["v"] == pytest.approx(want.median())


@pytest.fixture
def no_automatic_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_few_values_leave_the_rows_in_place(spark, no_automatic_broadcast):
    df = spark.range(2000).select("id", F.expr("IF(id % 9 = 0, NULL, CAST(id % 40 AS DOUBLE))").alias("v"))
    few, many = D.RankTable(df, {"v": F.col("v")}), D.RankTable(df, {"v": F.col("v")}, range_rows=10)
    placed, moved = few.attach(df, "v", F.col("v"), "pct"), many.attach(df, "v", F.col("v"), "pct", ["id"])
    assert "Exchange hashpartitioning" not in _plan(placed) and "Exchange hashpartitioning" in _plan(moved)
    assert sorted(map(str, placed.collect())) == sorted(map(str, moved.collect()))


def test_line_items_are_not_shuffled_to_their_suppliers(spark, sf_dir, no_automatic_broadcast):
    assert "Exchange hashpartitioning" not in _plan(tables.obs_raw(spark, sf_dir))


def test_many_suppliers_are_joined_by_shuffle(spark, sf_dir, no_automatic_broadcast, monkeypatch):
    rows = tables.obs_raw(spark, sf_dir)
    monkeypatch.setattr(tables, "small_enough", lambda table: False)
    moved = tables.obs_raw(spark, sf_dir)
    assert "Exchange hashpartitioning" in _plan(moved)
    assert rows.exceptAll(moved).count() == 0 and moved.exceptAll(rows).count() == 0


@pytest.mark.parametrize("limits", [{}, {"range_rows": 100}])
def test_row_position(spark, limits):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(6)
    rows = D.with_row_position(df, ["k"], **limits).collect()
    assert all(r["k"] == r["position"] for r in rows) and len(rows) == 1000


def test_large_rank_plan_has_no_window_over_all_rows(spark):
    ranked = D.with_percent_rank(frame(spark, mixed()), {"v": "pct"}, range_rows=500)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line and "specifiedwindow" in line.lower()]
    on_rows = [line for line in windows if "_part" not in line]
    assert not on_rows, on_rows
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


PAIRS = [(1.0, 2.0), (2.0, None), (3.0, 5.0), (None, 9.0), (4.0, 4.0)]


def test_correlation_golden(spark):
    df = spark.createDataFrame(PAIRS, "ndvi double, ndwi double")
    row = correlations(df).first()
    assert row["correlation"] == pytest.approx(0.785714, abs=1e-6) and row["observations"] == 3


def test_constant_or_short_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(0.1, 1.0, 1.0), (0.1, 2.0, None), (0.1, 4.0, 2.0)], "ndvi double, ndwi double, ndbi double")
    got = {(r["a"], r["b"]) for r in correlations(df).collect()}
    assert got == set()


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) + 1e6
    data = pd.DataFrame(base, columns=["ndvi", "ndwi", "ndbi", "evi", "temp"]).mask(rng.random((500, 5)) < 0.2)
    rows = [tuple(None if pd.isna(x) else float(x) for x in r) for r in data.itertuples(index=False)]
    df = spark.createDataFrame(rows, "ndvi double, ndwi double, ndbi double, evi double, temp double").repartition(4)
    want = data.corr(min_periods=3)
    for r in correlations(df).collect():
        assert r["correlation"] == pytest.approx(want.loc[r["a"], r["b"]], abs=1e-9)
        assert r["observations"] == len(data[[r["a"], r["b"]]].dropna())
    square = correlation_matrix(correlations(df), list(data.columns)).toPandas().set_index("indicator")
    np.testing.assert_allclose(square.loc[data.columns, data.columns].to_numpy(), want.to_numpy(), atol=1e-9)
    top = strongest(correlations(df), 2).collect()
    assert abs(top[0]["correlation"]) >= abs(top[1]["correlation"])


def test_correlation_needs_two_features(spark):
    with pytest.raises(ValueError):
        correlations(spark.sql("SELECT 1D AS ndvi"))
