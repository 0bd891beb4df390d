"""Flagged rows, and the tables offered for export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.operators.anomaly import flagged_rows
from fieldglass.operators.browse import page_after, page_of, sort_rows
from fieldglass.operators.findings import findings
from fieldglass.operators.regions import regional_profile
from fieldglass.operators.schema import resolve_fields

KINDS = V.REPORT_KINDS


def display_columns(scored: DataFrame, fields: Mapping[str, str] | None = None) -> list[str]:
    fields = fields or resolve_fields(scored.columns)
    wanted = ["_timestamp", fields.get("region"), "state", fields.get("latitude"), fields.get("longitude"),
              "severity", "anomaly_score", "ndvi", "ndwi", fields.get("temperature"), "risk_score"]
    return [c for c in wanted if c in scored.columns]


def flagged(scored: DataFrame, severity: str | None = None, page: int = 1, page_size: int = V.PAGE_SIZE,
            tiebreak: str = "row_id") -> DataFrame:
    """One page of the flagged rows, highest score first."""
    ordered = sort_rows(flagged_rows(scored, severity), "anomaly_score", "desc", (tiebreak,))
    return page_of(ordered, page, page_size).select(*display_columns(scored))


def flagged_total(scored: DataFrame, severity: str | None = None) -> DataFrame:
    """One row: flagged rows, of the given severity if any."""
    return flagged_rows(scored, severity).agg(F.count(F.lit(1)).alias("total"))


def flagged_after(scored: DataFrame, last_score: float, last_key, severity: str | None = None, page_size: int = V.PAGE_SIZE,
                  key: str = "row_id") -> DataFrame:
    """The page of flagged rows after the one with this score and key; every page costs the same."""
    rows = page_after(flagged_rows(scored, severity), "anomaly_score", last_score, page_size, "desc", key, last_key)
    return rows.select(*display_columns(scored))


def attach_scores(rows: DataFrame, scores: DataFrame, columns: Sequence[str], key: str = "row_id", missing: float | None = None) -> DataFrame:
    """Columns that were computed apart, joined to the rows by their unique key; they replace columns of the same name.

    A row without scores keeps its place, with ``missing`` in place of each score (of numbers) or with none.
    """
    own = scores.select(key, *columns)
    joined = rows.drop(*columns).join(own, key, "left")
    return joined if missing is None else joined.fillna(missing, list(columns))


def report(scored: DataFrame, kind: str, risks: DataFrame | None = None) -> DataFrame:
    """The table behind an export: anomaly with risk columns per row, regions, risk alone, or findings.

    ``risks`` holds the risk columns where they were computed apart; they are attached by ``row_id``.
    """
    if risks is not None:
        scored = attach_scores(scored, risks, [c for c in risks.columns if c != "row_id"])
    key = [c for c in ("row_id",) if c in scored.columns]
    risk = ["risk_score", "risk_level", *[c for c in scored.columns if c.endswith("_contribution")]]
    if kind == "anomalies":
        return scored.select(*key, "anomaly_score", "anomaly_flag", "severity", *risk)
    if kind == "risk":
        return scored.select(*key, *risk)
    if kind == "regions":
        return regional_profile(scored)
    if kind == "insights":
        return findings(scored)
    raise ValueError(f"kind must be one of {V.REPORT_KINDS}")
