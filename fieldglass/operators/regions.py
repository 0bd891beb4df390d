"""Reports per region, state or whole table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.functions.scalar import literal_table
from fieldglass.operators.distribution import RANGE_ROWS, running_before
from fieldglass.operators.schema import numeric_features, present, resolve_fields
from fieldglass.operators.trends import bucket_of, change_percent, in_region
from fieldglass.runtime import settle


def summary(scored: DataFrame, fields: Mapping[str, str] | None = None) -> DataFrame:
    """One row: sizes, distinct regions and states, mean of each index, mean risk, high-risk rows.

    The rows are first reduced to one per region and state, so the distinct counts never expand the input.
    """
    fields = fields or resolve_fields(scored.columns)
    region = F.col(fields["region"]) if "region" in fields else F.lit(None).cast("string")
    state = F.col("state") if "state" in scored.columns else F.lit(None).cast("string")
    averaged = [i for i in V.INDEX_NAMES if i in scored.columns] + ["risk_score"]
    groups = scored.groupBy(region.alias("_region"), state.alias("_state")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("risk_score") >= V.HIGH_RISK_FROM).alias("_high"),
        *[a for c in averaged for a in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_n_{c}"))],
    )
    means = {c: F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")) for c in averaged}
    derived = {"anomaly_score", "anomaly_flag", "severity", "risk_score", "risk_level", "obs_year", "obs_month", "cluster", "contaminated"}
    width = len([c for c in scored.columns if c not in derived and not c.endswith("_contribution")])
    return groups.agg(
        F.sum("_rows").alias("rows"), F.lit(width).alias("columns"),
        F.countDistinct("_region").alias("regions"), F.countDistinct("_state").alias("states"),
        *[means[c].alias(f"mean_{c}") for c in averaged if c != "risk_score"],
        means["risk_score"].alias("average_risk"), F.sum("_high").alias("high_risk"),
    )


def index_cards(df: DataFrame, region: str | None = None, index: str | None = None,
                fields: Mapping[str, str] | None = None) -> DataFrame:
    """One card per indicator: mean, least, greatest, sample deviation, net monthly change, descriptive texts.

    One scan: per month the count, mean, variance and extremes of every
    indicator, then months are combined (within plus between variance).
    """
    fields = fields or resolve_fields(df.columns)
    wanted = []
    for key, *texts in V.INDICATOR_CARDS:
        column = fields.get(key) if key in V.CLIMATE_FIELDS else key
        if column in df.columns and index in (None, key, column):
            wanted.append((column, *texts))
    if not wanted:
        raise ValueError(f"no indicator {index!r} in this table" if index else "no indicator in this table")
    monthly = in_region(df, region, fields).groupBy(bucket_of(F.col("_timestamp"), "monthly").alias("bucket")).agg(*[
        F.expr(f"struct(count(`{c}`) AS n, avg(`{c}`) AS mean, var_pop(`{c}`) AS var, min(`{c}`) AS low, "
               f"max(`{c}`) AS high) AS k{i}") for i, (c, *_) in enumerate(wanted)
    ])
    rows = ", ".join(f"named_struct('key', '{c}', 'bucket', bucket, 'k', k{i})" for i, (c, *_) in enumerate(wanted))
    long = monthly.selectExpr(f"inline(array({rows}))").select("key", "bucket", "k.*").where("n > 0")
    # one row per month and indicator from here on
    overall = long.withColumn("overall", F.expr(
        "sum(n * mean) OVER (PARTITION BY key) / sum(n) OVER (PARTITION BY key)"))
    cards = overall.withColumn("_dated", F.expr("IF(bucket IS NULL, NULL, mean)")).groupBy("key").agg(
        *map(F.expr, ["max(overall) AS current_average", "min(low) AS minimum", "max(high) AS maximum",
                      "sqrt(try_divide(sum(n * (var + pow(mean - overall, 2))), sum(n) - 1)) AS std"]),
        change_percent("_dated", "bucket").alias("trend"),
    )
    texts = literal_table(df.sparkSession, ["_key", "name", "full_name", "description", "healthy_range",
                                            "stressed_range", "ordinal"], [(*row, i) for i, row in enumerate(wanted)])
    return (
        texts.join(cards, F.col("_key") == F.col("key"), "left")
        .withColumn("key", F.col("_key")).drop("_key").orderBy("ordinal")
    )


def regional_profile(scored: DataFrame, fields: Mapping[str, str] | None = None) -> DataFrame:
    """Mean of each indicator and of risk by region and state; ``observations`` counts the whole region."""
    fields = fields or resolve_fields(scored.columns)
    if "region" not in fields:
        raise ValueError("regional analysis needs a region column")
    region = fields["region"]
    keys = [region, "state"] if "state" in scored.columns else [region]
    means = [F.avg(c).alias(c) for c in [*numeric_features(scored, fields), "risk_score"]]
    grouped = present(scored, [region]).groupBy(*keys).agg(*means, F.count(F.lit(1)).alias("_rows"))
    per_region = Window.partitionBy(region)  # over groups, not over rows
    profile = grouped.withColumn("observations", F.sum("_rows").over(per_region)).drop("_rows")
    return present(profile, keys).orderBy(F.col("risk_score").desc(), *keys)


def rank_regions(profile: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``risk_rank``: the dense rank of the groups by mean risk, highest first (counts the distinct scores).

    The profile is written first: a mean computed twice may differ in its last bits, and its score would then find no rank.
    """
    profile = settle(profile, "profile")
    scores = settle(profile.select((-F.col("risk_score")).alias("_order")).distinct(), "scores")
    distinct = scores.count()
    placed = running_before(scores, None, ["_order"], F.lit(1), distinct, range_rows)
    ranks = placed.select("_order", (F.col("before") + 1).cast("int").alias("risk_rank"))
    joined = profile.withColumn("_score", -F.col("risk_score")).join(
        ranks, F.col("_score").eqNullSafe(F.col("_order")), "left")
    return joined.drop("_score", "_order")


def extreme_regions(profile: DataFrame, region: str = "region") -> DataFrame:
    """Highest- and lowest-risk region with their scores: aggregates, no sort. Ties break by region name."""
    named = profile.where(F.col("risk_score").isNotNull()).select(
        F.struct("risk_score", F.col(region).alias("name")).alias("pair"))
    return named.agg(F.max("pair").alias("high"), F.min("pair").alias("low")).select(
        F.col("high.name").alias("highest"), F.col("high.risk_score").alias("highest_risk"),
        F.col("low.name").alias("lowest"), F.col("low.risk_score").alias("lowest_risk"),
    )


def spatial_density(df: DataFrame, by: str = "state", cell: float = 1.0,
                    fields: Mapping[str, str] | None = None) -> DataFrame:
    """Rows, distinct points, cells, rows per cell, centroid, and greatest distance (km) from the centroid.

    Rows are reduced to distinct points, which are settled, before anything is joined: one scan of the table.
    """
    fields = fields or resolve_fields(df.columns)
    by = fields.get(by, by)
    lat, lon = fields["latitude"], fields["longitude"]
    places = settle(present(df, [by, lat, lon]).groupBy(
        F.col(by).alias("_by"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(F.count(F.lit(1)).alias("n")), "places")
    centres = places.groupBy("_by").agg(
        F.sum("n").alias("observations"), F.count(F.lit(1)).alias("points"),
        (F.sum(F.col("lat") * F.col("n")) / F.sum("n")).alias("centre_latitude"),
        (F.sum(F.col("lon") * F.col("n")) / F.sum("n")).alias("centre_longitude"),
    )
    cells = places.select("_by", F.floor(F.col("lat") / cell).alias("cy"), F.floor(F.col("lon") / cell).alias("cx"))
    cells = cells.distinct().groupBy("_by").agg(F.count(F.lit(1)).alias("cells"))
    half_lat = F.sin(F.radians(F.col("lat") - F.col("centre_latitude")) / 2)
    half_lon = F.sin(F.radians(F.col("lon") - F.col("centre_longitude")) / 2)
    h = half_lat * half_lat + F.cos(F.radians("lat")) * F.cos(F.radians("centre_latitude")) * half_lon * half_lon
    distance = 2 * 6371.0088 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    radius = places.join(centres.select("_by", "centre_latitude", "centre_longitude"), "_by").groupBy("_by").agg(
        F.max(distance).alias("radius_km"))
    return (
        centres.join(cells, "_by").join(radius, "_by")
        .withColumn("observations_per_cell", F.col("observations") / F.col("cells"))
        .withColumnRenamed("_by", by)
    )
