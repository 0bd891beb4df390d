"""The ledger of sources, metadata gathered by the write, and headers read in one job."""

import os

import pytest
from pyspark.sql import functions as F

import fieldglass as fg
from fieldglass.sources import ledger, readers
from fieldglass.sources.writers import ABOUT


def totals(spark, store):
    rows = ledger.stored_rows(spark, store)
    return {r.name: (r.n, r.batch) for r in rows.groupBy(F.regexp_extract("source_file", "([^/]+)$", 1).alias("name"), "batch").agg(
        F.sum("red").alias("n")).collect()}


def written(folder, name, *values, moved=0):
    file = folder / name
    file.write_text("date,red\n" + "".join(f"2024-01-01,{v}\n" for v in values))
    stamp = file.stat().st_mtime + moved
    os.utime(file, (stamp, stamp))
    return file


SCHEMA = "date string, red double"


def test_loads_read_what_changed(spark, tmp_path, monkeypatch):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    written(source, "a 1.csv", 1, 2)
    written(source, "b+%41.csv", 10)
    first = fg.load(spark, str(source), store, "csv", SCHEMA)
    assert first == (2, 0, 0, 0, 1) and totals(spark, store) == {"a 1.csv": (3, 1), "b+%41.csv": (10, 1)}

    def refused(*args, **kwargs):
        raise AssertionError("an unchanged source was read")

    with monkeypatch.context() as patch:
        patch.setattr(ledger, "read_observations", refused)
        assert fg.load(spark, str(source), store, "csv", SCHEMA) == (0, 0, 0, 2, 1)

    read = []
    real = ledger.read_observations
    monkeypatch.setattr(ledger, "read_observations", lambda spark, files, *a, **k: (read.append(files), real(spark, files, *a, **k))[1])
    written(source, "a 1.csv", 5, moved=100)
    written(source, "c.csv", 7)
    assert fg.load(spark, str(source), store, "csv", SCHEMA) == (1, 1, 0, 1, 2)
    assert [sorted(f.rsplit("/", 1)[1] for f in files) for files in read] == [["a 1.csv", "c.csv"]]
    assert totals(spark, store) == {"a 1.csv": (5, 2), "b+%41.csv": (10, 1), "c.csv": (7, 2)}

    written(source, "b+%41.csv", 20, 1, moved=100)  # batch 1 has no live file left
    assert fg.load(spark, str(source), store, "csv", SCHEMA).version == 3
    assert totals(spark, store) == {"a 1.csv": (5, 2), "b+%41.csv": (21, 3), "c.csv": (7, 2)}
    assert ledger.ledger(spark, store).where("NOT live").count() == 0

    assert fg.load(spark, str(source), store, "csv", SCHEMA, force=True) == (0, 0, 0, 3, 4)
    assert totals(spark, store) == {"a 1.csv": (5, 4), "b+%41.csv": (21, 4), "c.csv": (7, 4)}


def test_removed_files_and_broken_loads(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for k in range(3):
        written(source, f"{k}.csv", k + 1)
    with pytest.raises(RuntimeError):  # breaks off after the files were read: nothing counts as taken in
        fg.load(spark, str(source), store, "csv", SCHEMA, prepare=lambda rows: (_ for _ in ()).throw(RuntimeError()))
    assert fg.load(spark, str(source), store, "csv", SCHEMA, prepare=lambda rows: rows.withColumn("twice", 2 * F.col("red"))).version == 1
    elsewhere = tmp_path / "other"
    elsewhere.mkdir()
    written(elsewhere, "0.csv", 1)
    assert fg.load(spark, str(elsewhere), store, "csv", SCHEMA) == (1, 0, 3, 0, 2)  # a store follows the source it is given
    assert totals(spark, store) == {"0.csv": (1, 2)}
    with pytest.raises(ValueError):
        fg.stored_rows(spark, str(tmp_path / "nowhere"))


def test_metadata_is_gathered_by_the_write(spark, tmp_path):
    raw = spark.createDataFrame([(1, "2024-01-01", 0.1, 0.5, None), (2, "2024-03-01", 0.2, None, "x"), (3, None, None, 0.5, None)],
                                "row_id int, date string, red double, nir double, note string")
    raw.write.parquet(str(tmp_path / "raw.parquet"))
    path, group = str(tmp_path / "t"), "about"
    table = fg.materialise(fg.prepare(raw), path, by_month=True, source=str(tmp_path / "raw.parquet"))
    about = fg.stored_metadata(spark, path).first()
    assert about.rows == 3 and about.non_missing["red"] == 2 and about.non_missing["note"] == 1 and about.least["nir"] == 0.5
    assert about.greatest["red"] == 0.2 and str(about.first)[:10] == "2024-01-01" and str(about.last)[:10] == "2024-03-01"
    assert about.dataset == "raw.parquet" and about.fingerprint == fg.fingerprint(spark, str(tmp_path / "raw.parquet")).first().fingerprint
    plan = fg.stored_metadata(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert "json" in plan and "parquet" not in plan
    assert table.count() == spark.read.parquet(path).count() == 3 and ABOUT not in "".join(table.columns)
    counted = fg.metadata(table, str(tmp_path / "raw.parquet")).first()
    assert (counted.rows, counted.dataset, counted.fingerprint) == (3, about.dataset, about.fingerprint)
    spark.sparkContext.setJobGroup(group, "")
    fg.materialise(fg.prepare(raw.limit(0)), str(tmp_path / "none"))
    assert fg.stored_metadata(spark, str(tmp_path / "none")).first().rows == 0


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for k in range(300):
        head, row = ("date,red", "2024-01-01,1") if k % 2 else ("red,\"date\",extra", "1,2024-01-01,x")
        (tmp_path / f"f {k}.csv").write_text(f"\n{head}\n" + f"{row}\n" * (2000 if k < 4 else 3))
    (tmp_path / "empty.csv").write_text("")
    spark.sparkContext.setJobGroup("headers", "")
    lines = readers.header_lines(spark, str(tmp_path))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext.setJobGroup("others", "")
    assert len(jobs) <= 2 and lines.count() == 300 and lines.select("line").distinct().count() == 2  # the scan; listing many files may be a job too
    got = fg.read_observations(spark, str(tmp_path), "csv")
    assert got.count() == 2 * (2000 * 2) + 296 * 3 and got.agg(F.count("date"), F.sum("red")).first() == (8888, 8888)


def test_flagged_total(spark, ws):
    one = fg.flagged_total(ws.scored).first().total
    assert one == ws.scored.where("anomaly_flag").count()
