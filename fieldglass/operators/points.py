"""Map points: filters on scored rows, one point per place."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.functions.scalar import literal_table, seeded_digest
from fieldglass.operators.risk import risk_level
from fieldglass.operators.schema import present, resolve_fields, state_of_city


def same_text(column, text: str):
    return F.lower(F.col(column).cast("string")) == text.lower()


def matching(scored: DataFrame, region: str | None = None, state: str | None = None, risk: str | None = None,
             anomalies_only: bool = False, fields: Mapping[str, str] | None = None) -> DataFrame:
    """Rows by region and state (any case), exact risk level, and anomaly flag."""
    fields = fields or resolve_fields(scored.columns)
    rows = scored
    if region and "region" in fields:
        rows = rows.where(same_text(fields["region"], region))
    if state and "state" in rows.columns:
        rows = rows.where(same_text("state", state))
    if risk:
        rows = rows.where(risk_level(F.col("risk_score")) == risk)
    return rows.where("anomaly_flag") if anomalies_only else rows


def in_box(df: DataFrame, south: float, west: float, north: float, east: float, fields: Mapping[str, str] | None = None) -> DataFrame:
    """Rows inside a box of coordinates, its edges included; ``west`` beyond ``east`` crosses the date line.

    Plain comparisons, so that the statistics of a table laid out by place skip what lies elsewhere. A row without a
    position is in no box.
    """
    fields = fields or resolve_fields(df.columns)
    if not {"latitude", "longitude"} <= set(fields):
        raise ValueError("geospatial analysis needs coordinates")
    latitude, longitude = F.col(fields["latitude"]), F.col(fields["longitude"])
    across = longitude.between(west, east) if west <= east else (longitude >= west) | (longitude <= east)
    return df.where(latitude.between(south, north) & across)


def matching_total(scored: DataFrame, **filters) -> DataFrame:
    """Matching rows, those without coordinates included."""
    return matching(scored, **filters).agg(F.count(F.lit(1)).alias("total_matching"))


def group_points(rows: DataFrame, fields: Mapping[str, str] | None = None) -> DataFrame:
    """One row per place with its means, severity by mean risk, and hot flag; rows without a full key are dropped."""
    fields = fields or resolve_fields(rows.columns)
    if not {"latitude", "longitude"} <= set(fields):
        raise ValueError("geospatial analysis needs coordinates")
    sources = {"latitude": fields["latitude"], "longitude": fields["longitude"]}
    if "region" in fields:
        sources["region"] = fields["region"]
    if "state" in rows.columns:
        sources["state"] = "state"
    means = {m: fields.get(m, m) for m in V.POINT_MEANS if fields.get(m, m) in rows.columns}
    keyed = present(rows, list(sources.values())).select(
        *[F.col(c).alias(k) for k, c in sources.items()], *[F.col(c).alias(m) for m, c in means.items()])
    if not means:
        points = keyed.dropDuplicates()
    else:
        points = keyed.groupBy(*sources).agg(*[F.avg(m).alias(m) for m in means])
    if "risk_score" in means:
        points = points.withColumns({
            "severity": risk_level(F.col("risk_score")),
            "hot": F.coalesce(F.col("risk_score") >= V.HOT_POINT_FROM, F.lit(False)),
        })
    if "region" in sources:
        points = points.withColumn("city", F.col("region"))
        if "state" not in sources:
            points = state_of_city(points, "city")
    return points


def cap_points(points: DataFrame, cap: int = V.MAX_POINTS, seed: int = V.SEED) -> DataFrame:
    """At most ``cap`` points, chosen by a digest of their place: repeatable and independent of partitioning."""
    keys = [c for c in ("latitude", "longitude", "region", "state") if c in points.columns]
    return points.orderBy(seeded_digest(keys, seed), *keys).limit(cap)


def points(scored: DataFrame, region: str | None = None, state: str | None = None, risk: str | None = None,
           anomalies_only: bool = False, cap: int | None = None, seed: int = V.SEED) -> DataFrame:
    """All matching points; ``cap`` leaves that many by ``cap_points``."""
    grouped = group_points(matching(scored, region, state, risk, anomalies_only))
    return grouped if cap is None else cap_points(grouped, cap, seed)


def map_positions(points: DataFrame) -> DataFrame:
    """Add the drawn position: the known city's fixed one, else the point's own. Broadcast lookup of 20 rows."""
    known = literal_table(points.sparkSession, ["_city", "_lat", "_lon"], V.MAP_POSITIONS)
    joined = points.join(F.broadcast(known), F.col("city") == F.col("_city"), "left")
    return joined.withColumns({
        "map_latitude": F.coalesce("_lat", "latitude"), "map_longitude": F.coalesce("_lon", "longitude"),
    }).drop("_city", "_lat", "_lon")
