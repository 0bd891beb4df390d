"""The table laid out along a curve over the map."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import fieldglass as fg
from fieldglass.functions.scalar import place_code


def _morton(latitude, longitude):
    a, b = (max(0, min(65535, int((d + s / 2) / s * 65536.0 // 1))) for d, s in ((latitude, 180.0), (longitude, 360.0)))
    return sum((a >> i & 1) << 2 * i + 1 | (b >> i & 1) << 2 * i for i in range(16))


def test_place_code_interleaves_both_coordinates(spark):
    places = [(0.0, 0.0), (-90.0, -180.0), (90.0, 180.0), (18.52, 73.86), (-33.9, 151.2), (89.999, -179.999)]
    df = spark.createDataFrame([*places, (None, 3.0), (3.0, None)], "a double, b double")
    got = [r.c for r in df.select(place_code(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [*[_morton(*p) for p in places], None, None]


@pytest.fixture(scope="module")
def places(spark):
    """40,000 rows: a third at one place, some without a position, the others all over the map."""
    a, b = F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100_000, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)) / 100_000
    hot = F.col("id") % 3 == 0
    rows = spark.range(40_000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 50 != 1, F.when(hot, 48.0).otherwise(a * 180 - 90)).alias("latitude"),
        F.when(hot, 11.0).otherwise(b * 360 - 180).alias("longitude"), F.lit(0.5).alias("ndvi"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 200).alias("_timestamp"))
    return rows.cache()


@pytest.mark.parametrize("by_month", [False, True])
def test_a_box_touches_few_row_groups(spark, places, tmp_path, by_month):
    path = str(tmp_path / "t")
    stored = fg.materialise(places, path, view="placed", by_place=True, by_month=by_month, group_bytes=8 << 10)
    assert stored.count() == 40_000 and "_place" not in stored.columns
    about = fg.stored_metadata(spark, path).first()
    assert about.rows == 40_000 and about.non_missing["latitude"] == places.count() - places.where("latitude IS NULL").count()
    box = (20.0, 60.0, 35.0, 90.0)
    within = places.where("latitude BETWEEN 20 AND 35 AND longitude BETWEEN 60 AND 90")
    got = fg.in_box(stored, *box).select("row_id").collect()
    assert sorted(r.row_id for r in got) == sorted(r.row_id for r in within.select("row_id").collect())
    if by_month:
        return
    touched = total = 0
    for file in Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            ends = [meta.row_group(g).column(at[c]).statistics for c in ("latitude", "longitude")]
            total += 1
            touched += all(s.has_min_max and s.min <= high and s.max >= low for s, low, high in zip(ends, (20.0, 60.0), (35.0, 90.0)))
    assert total >= 40 and touched <= total / 10, (touched, total)


def test_boxes_over_the_date_line_and_without_coordinates(spark):
    df = spark.createDataFrame([(1, 0.0, 179.0), (2, 0.0, -179.0), (3, 0.0, 0.0), (4, None, 179.5)], "row_id int, latitude double, longitude double")
    assert sorted(r.row_id for r in fg.in_box(df, -1, 178, 1, -178).collect()) == [1, 2]
    assert fg.in_box(df.limit(0), -90, -180, 90, 180).count() == 0
    with pytest.raises(ValueError):
        fg.in_box(df.drop("latitude"), 0, 0, 1, 1)
    with pytest.raises(ValueError):
        fg.materialise(df.drop("longitude"), "/tmp/never-written", by_place=True)
