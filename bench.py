"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default the sf0.1 test tables) and ``BENCH_CPUS``
(default 8). Each query runs once to warm up; the figure is the median of
``BENCH_RUNS`` further runs (default 3). Every run computes its result anew.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession

from fieldglass import (
    browse,
    clusters,
    correlations,
    density,
    findings,
    flagged,
    histogram,
    index_cards,
    moving_average,
    points,
    prepare,
    regional_profile,
    risk_report,
    summary,
    trend,
    trend_change,
    with_anomaly,
    with_percent_rank,
    with_risk,
)
from fieldglass.plans.tables import climate_raw, obs_raw, workspace
from fieldglass.runtime import settle

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("fieldglass-bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per expression
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_out(df: DataFrame) -> None:
    """Compute every row and column without bringing them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    ws = workspace(spark, SF_DIR)
    ws.obs.count(), ws.scored.count(), ws.climate.count()
    small = lambda df: df.toPandas()  # noqa: E731  (reports of a few rows)
    queries = {
        "prepare_spectral": lambda: run_out(prepare(obs_raw(spark, SF_DIR))),
        "prepare_climate": lambda: run_out(prepare(climate_raw(spark, SF_DIR))),
        "materialise_observations": lambda: settle(prepare(obs_raw(spark, SF_DIR)), "bench"),
        "trend_monthly_from_source": lambda: small(trend(prepare(obs_raw(spark, SF_DIR)), "ndvi", "monthly")),
        "trend_weekly_by_region": lambda: small(trend_change(trend(ws.obs, "ndvi", "weekly", by=["region"]), ["region"])),
        "moving_average_daily": lambda: small(moving_average(trend(ws.obs, "ndvi", "daily"))),
        "index_cards": lambda: small(index_cards(ws.obs)),
        "correlations": lambda: small(correlations(ws.obs)),
        "percent_rank": lambda: run_out(with_percent_rank(ws.obs, {"temperature": "t", "rainfall": "r"})),
        "anomaly_zscore": lambda: run_out(with_anomaly(ws.obs, method="zscore")),
        "anomaly_forest": lambda: run_out(with_anomaly(ws.obs, method="forest")),
        "risk": lambda: run_out(with_risk(ws.scored.drop(*[c for c in ws.scored.columns if "risk" in c or "contrib" in c]))),
        "summary": lambda: small(summary(ws.scored)),
        "regional_profile": lambda: small(regional_profile(ws.scored)),
        "points": lambda: small(points(ws.scored)),
        "risk_report": lambda: small(risk_report(ws.scored)),
        "flagged_page": lambda: small(flagged(ws.scored)),
        "browse_sorted_page": lambda: small(browse(ws.obs, search="nation_1", sort="ndvi", order="desc")),
        "histogram": lambda: small(histogram(ws.obs, "ndvi")),
        "density": lambda: small(density(ws.obs, "ndvi")),
        "findings": lambda: small(findings(ws.scored)),
        "clusters": lambda: small(clusters(ws.obs).profiles),
    }
    seconds = {}
    for name, run in queries.items():
        run()
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(SF_DIR).name, "cpus": int(CPUS), "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
