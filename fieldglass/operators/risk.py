"""Weighted environmental risk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.functions.scalar import clamp, label_right_closed
from fieldglass.operators.distribution import RankTable, exact_quantiles
from fieldglass.operators.schema import resolve_fields


def low_is_bad(index: Column) -> Column:
    """0 at an index of 1, 100 at -1."""
    return (1 - (clamp(index, -1, 1) + 1) / 2) * 100


def high_is_bad(index: Column) -> Column:
    """100 at an index of 1, 0 at -1."""
    return ((clamp(index, -1, 1) + 1) / 2) * 100


def risk_level(score: Column) -> Column:
    return label_right_closed(score, V.RISK_EDGES, V.RISK_LEVELS)


class _Parts:
    """Risk parts of a table: unfilled expressions, medians, and the rank tables behind two of them."""

    def __init__(self, df: DataFrame, fields: Mapping[str, str], **limits) -> None:
        self.expressions: dict[str, Column] = {}
        self.medians: dict[str, float | None] = {}
        self.ranked = {f: F.col(fields[f]) for f in V.CLIMATE_FIELDS if f in fields}
        for part, index, form in (("vegetation", "ndvi", low_is_bad), ("water", "ndwi", low_is_bad),
                                  ("urban", "ndbi", high_is_bad)):
            if index in df.columns:
                self.expressions[part] = form(F.col(index).cast("double"))
        if self.expressions:
            found = exact_quantiles(df, {p: (c, [0.5]) for p, c in self.expressions.items()}, **limits)
            self.medians = {p: q[0] for p, q in found.items()}
        self.ranks = RankTable(df, self.ranked, **limits) if self.ranked else None
        for field, middle in (self.ranks.medians if self.ranks else {}).items():
            pct = F.col(f"_{field}_pct")
            self.expressions[field] = pct * 100 if field == "temperature" else (1 - pct) * 100
            if middle is not None:
                middle = middle * 100 if field == "temperature" else (1 - middle) * 100
            self.medians[field] = middle

    def attach(self, df: DataFrame) -> DataFrame:
        for field, column in self.ranked.items():
            df = self.ranks.attach(df, field, column, f"_{field}_pct")
        return df

    def filled(self) -> dict[str, Column]:
        out = {}
        for part, expression in self.expressions.items():
            middle = self.medians[part]
            out[part] = F.coalesce(expression, F.lit(V.EMPTY_PART_FILL if middle is None else middle))
        out["anomaly"] = F.coalesce(F.col("anomaly_score"), F.lit(0.0)) * 100
        return out


def part_medians(df: DataFrame, fields: Mapping[str, str] | None = None, **limits) -> dict[str, float | None]:
    return _Parts(df, fields or resolve_fields(df.columns), **limits).medians


def risk_parts(df: DataFrame, fields: Mapping[str, str] | None = None, **limits) -> tuple[DataFrame, dict[str, Column]]:
    """The table with percent-rank columns attached, and each part filled with its median (50 if it has none)."""
    parts = _Parts(df, fields or resolve_fields(df.columns), **limits)
    return parts.attach(df), parts.filled()


def with_risk(df: DataFrame, fields: Mapping[str, str] | None = None, **limits) -> DataFrame:
    """Add ``risk_score``, ``risk_level`` and one ``<part>_contribution`` per part.

    ``df`` carries ``anomaly_score`` already. Ranks and medians come from the
    rows of ``df``: pass a subset, with scores attached to the whole table
    before, for the risk within that subset.
    """
    ranked, parts = risk_parts(df, fields, **limits)
    total = sum(V.RISK_WEIGHTS[p] for p in parts)
    out = ranked.withColumns({f"{p}_contribution": c * (V.RISK_WEIGHTS[p] / total) for p, c in parts.items()})
    score = sum((F.col(f"{p}_contribution") for p in parts), F.lit(0.0))
    out = out.withColumn("risk_score", clamp(score, 0, 100))
    return out.withColumn("risk_level", risk_level(F.col("risk_score"))).drop(
        *[f"_{f}_pct" for f in V.CLIMATE_FIELDS])


def risk_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))


def risk_report(scored: DataFrame) -> DataFrame:
    """One row: mean score, mean contribution of each part, rows per level, and the note; one scan."""
    parts = [c for c in scored.columns if c.endswith("_contribution")]
    levels = scored.agg(
        F.avg("risk_score").alias("average"),
        *[F.avg(c).alias(c.removesuffix("_contribution")) for c in parts],
        *[F.count_if(F.col("risk_level") == level).alias(f"rows_{level.lower()}") for level in V.RISK_LEVELS],
    )
    return levels.withColumn("disclaimer", F.lit(V.RISK_NOTE))
