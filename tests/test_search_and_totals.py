"""Search through the dictionary of values, and totals that follow a store's loads."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

import fieldglass as fg
from fieldglass.operators import search_index
from fieldglass.operators.browse import search_rows
from fieldglass.sources import ledger, totals

# --- search -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark):
    draw = random.Random(3)
    letters = "abcAB é😀%_'\\\n"
    rows = [(k, "".join(draw.choice(letters) for _ in range(draw.randrange(9))), draw.choice(["Pune", "pune north", None, "", "x😀yz"]), k / 8)
            for k in range(400)]
    rows += [(400, None, None, None), (401, "word " * 40_000 + "Needle end", "Pune", 1.0), (402, "ab", "Pune", 2.0), (402, "ab", "Pune", 2.0)]
    df = spark.createDataFrame(rows, "row_id int, note string, `the place` string, value double")
    return df.withColumn("flag", F.col("row_id") % 2 == 0)


@pytest.fixture(scope="module")
def index(texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    fg.search_index(texts, path)
    return path


TERMS = ["abc", "ABCA", "a", "é", "é😀", "😀%_", "x😀y", "pune", "PUNE NORTH", "needle", "12.5", "40", "true", "rue", "\\\n", "'", "no such", "word word", "b a"]


@pytest.mark.parametrize("term", TERMS)
def test_indexed_search_finds_what_a_scan_finds(texts, index, term):
    want = sorted(r.row_id for r in search_rows(texts, term).collect())
    assert sorted(r.row_id for r in fg.search_indexed(texts, index, term).collect()) == want


def test_many_values_are_scanned_for(texts, index, monkeypatch):
    monkeypatch.setattr(search_index, "NAMED_VALUES", 2)
    monkeypatch.setattr(search_index, "SENT_POSTINGS", 3)
    for term in ("ab", "abc", "pune", "bA"):
        found = fg.search_indexed(texts, index, term)
        assert sorted(r.row_id for r in found.collect()) == sorted(r.row_id for r in search_rows(texts, term).collect())
    monkeypatch.setattr(search_index, "NAMED_CHARACTERS", 3)
    assert fg.search_indexed(texts, index, "pune").count() == search_rows(texts, "pune").count()


def test_search_without_values_columns_or_terms(spark, texts, index, tmp_path):
    assert fg.search_indexed(texts, index, None).count() == fg.search_indexed(texts, index, "").count() == texts.count()
    more = texts.withColumn("extra", F.concat(F.lit("Extra "), "row_id"))  # a column that the index doesn't cover
    assert fg.search_indexed(more, index, "extra 12").count() == search_rows(more, "extra 12").count() > 0
    fg.search_index(texts.limit(0), str(tmp_path / "empty"))
    assert fg.search_indexed(texts.limit(0), str(tmp_path / "empty"), "pune").count() == 0
    numbers = texts.select("row_id", "value")
    fg.search_index(numbers, str(tmp_path / "numbers"))
    assert fg.search_indexed(numbers, str(tmp_path / "numbers"), "12.5").count() == search_rows(numbers, "12.5").count() > 0


def test_values_reach_the_scan_of_a_stored_table(spark, texts, index, tmp_path):
    texts.write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    plan = fg.search_indexed(stored, index, "north")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    assert "pune north" in pushed and "note" not in pushed
    assert "contains" not in plan.lower()
    nothing = fg.search_indexed(stored, index, "nowhere at all")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in nothing.lower()


# --- totals -------------------------------------------------------------------------------------

PLAIN = "date string, region string, state string, red double, nir double"


def write_month(spark, source, month, shift=0.0):
    rows = [(f"2024-{month:02d}-{1 + k % 28:02d}", [None, "Pune", "Nagpur"][k % 3], ["M", "M", None, "N"][k % 4],
             0.1 + k / 1000 + shift, None if k % 5 == 0 else 0.5 + k / 500) for k in range(200)]
    rows.append((None, "Pune", "M", 0.3, 0.7))
    spark.createDataFrame(rows, PLAIN).coalesce(1).write.mode("overwrite").parquet(f"{source}/{month}")


def near(frame):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()], key=str)


def same_as_a_recompute(spark, store):
    rows = fg.stored_rows(spark, store)
    for every in ("daily", "weekly", "monthly"):
        assert near(fg.kept_trend(spark, store, "ndvi", every, by=["region"])) == near(fg.trend(rows, "ndvi", every, by=["region"]))
    assert near(fg.kept_trend(spark, store, "red", region="Pune")) == near(fg.trend(rows, "red", region="Pune"))
    some = rows.where("_timestamp >= '2024-01-10' AND _timestamp < '2024-02-06'")
    assert near(fg.kept_trend(spark, store, "red", "weekly", first_day="2024-01-10", last_day="2024-02-05")) == near(fg.trend(some, "red", "weekly"))
    want = rows.where("region IS NOT NULL").groupBy("region", "state").agg(F.avg("ndvi"), F.avg("red")).where("state IS NOT NULL")
    assert near(fg.kept_profile(spark, store).drop("observations")) == near(want)
    regions = {r.region: r["count"] for r in rows.groupBy("region").count().collect()}
    assert {r.region: r.observations for r in fg.kept_profile(spark, store).collect()} == {k: v for k, v in regions.items() if k}
    assert {r.region: r.rows for r in fg.kept_counts(spark, store, ["region"]).collect()} == regions


def test_totals_follow_the_loads(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for month in (1, 2):
        write_month(spark, source, month)
    fg.load(spark, source, store, "parquet", prepare=fg.prepare)
    with pytest.raises(ValueError):
        fg.refresh_totals(spark, store)  # nothing says by what, yet
    assert fg.refresh_totals(spark, store, ["region", "state"], ["ndvi", "red"]) == ([1], [])
    same_as_a_recompute(spark, store)

    write_month(spark, source, 3)
    fg.load(spark, source, store, "parquet", prepare=fg.prepare)
    with pytest.raises(ValueError):
        fg.kept_trend(spark, store, "ndvi")  # never a trend that lacks what was loaded
    away = tmp_path / "store" / "rows" / "batch=1"
    shutil.move(away, tmp_path / "away")  # the months before are not read
    assert fg.refresh_totals(spark, store) == ([2], [1])
    shutil.move(tmp_path / "away", away)
    same_as_a_recompute(spark, store)

    write_month(spark, source, 1, shift=0.2)  # a month is replaced, so its old totals no longer count
    fg.load(spark, source, store, "parquet", prepare=fg.prepare)
    assert fg.refresh_totals(spark, store) == ([3], [1, 2])
    same_as_a_recompute(spark, store)
    fg.load(spark, source, store, "parquet", prepare=fg.prepare, force=True)
    assert fg.refresh_totals(spark, store) == ([4], [])
    same_as_a_recompute(spark, store)
    assert fg.refresh_totals(spark, store) == ([], [4])


def test_totals_say_what_they_lack(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    write_month(spark, source, 1)
    fg.load(spark, source, store, "parquet", prepare=fg.prepare)
    fg.refresh_totals(spark, store, ["region"], ["red", "absent"])
    for call in (lambda: fg.refresh_totals(spark, store, ["state"], ["red"]), lambda: fg.kept_trend(spark, store, "nir"),
                 lambda: fg.kept_trend(spark, store, "red", by=["state"]), lambda: fg.kept_profile(spark, store)):
        with pytest.raises(ValueError):
            call()
    assert fg.kept_trend(spark, store, "absent").count() == 0
    plain = str(tmp_path / "plain")
    fg.load(spark, source, plain, "parquet")
    with pytest.raises(ValueError):
        fg.refresh_totals(spark, plain, ["region"], ["red"])
    with pytest.raises(ValueError):
        fg.kept_trend(spark, str(tmp_path / "nothing"), "red")


def test_a_load_that_broke_off_leaves_no_rows_behind(spark, tmp_path, monkeypatch):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    write_month(spark, source, 1)
    fg.load(spark, source, store, "parquet", prepare=fg.prepare)
    for month in (2, 3):
        write_month(spark, source, month)
    monkeypatch.setattr(ledger, "READ_FILES", 1)
    calls = []

    def breaks(rows):
        calls.append(1)
        if len(calls) > 1:
            raise RuntimeError
        return fg.prepare(rows)

    with pytest.raises(RuntimeError):
        fg.load(spark, source, store, "parquet", prepare=breaks)
    assert fg.load(spark, source, store, "parquet", prepare=fg.prepare).added == 2
    assert fg.stored_rows(spark, store).count() == 3 * 201
    assert totals.refresh_totals(spark, store, ["region"], ["red"]) == ([1, 2], [])
    assert fg.kept_trend(spark, store, "red", "yearly").first()["count"] == 3 * 200
