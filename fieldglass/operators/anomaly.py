"""Anomaly scores: largest z-score, or an isolation forest scaled to [0, 1]."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.functions.scalar import clamp, label_right_closed
from fieldglass.operators.distribution import exact_quantiles
from fieldglass.operators.forest import fit_forest, forest_score
from fieldglass.operators.schema import candidate_features
from fieldglass.runtime import settle


def any_present(features: Sequence[str]) -> Column:
    return reduce(or_, [F.col(f).isNotNull() for f in features])


def eligible_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with at least one feature present."""
    return df.dropna("all", subset=list(features))


def severity_of(score: Column) -> Column:
    return label_right_closed(score, V.SEVERITY_EDGES, V.SEVERITY_LABELS)


def _labelled(df: DataFrame, score: Column) -> DataFrame:
    return df.withColumn("anomaly_score", score).withColumns({
        "anomaly_flag": F.col("anomaly_score") >= V.FLAG_FROM,
        "severity": severity_of(F.col("anomaly_score")),
    })


def feature_moments(df: DataFrame, features: Sequence[str]):
    """One row: per feature count, mean and population deviation, and the rows with any feature present."""
    return df.agg(
        F.count_if(any_present(features)).alias("eligible"),
        *[a for f in features for a in (F.count(f).alias(f"{f}_count"), F.avg(f).alias(f"{f}_mean"),
                                        F.stddev_pop(f).alias(f"{f}_std"))],
    ).first()


def z_score(features: Sequence[str], moments) -> Column:
    """Largest absolute z-score over 4, limited to [0, 1]; constant features are ignored, no feature gives 0."""
    parts = [F.abs((F.col(f).cast("double") - moments[f"{f}_mean"]) / moments[f"{f}_std"])
             for f in features if moments[f"{f}_std"]]
    if not parts:
        return F.lit(0.0)
    largest = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return clamp(F.coalesce(largest, F.lit(0.0)) / V.Z_FULL_SCALE, 0.0, 1.0)


def with_anomaly(df: DataFrame, features: Sequence[str] | None = None, method: str = "auto",
                 trees: int = V.FOREST_TREES, sample: int = V.FOREST_SAMPLE, seed: int = V.SEED,
                 row_key: Sequence[str] = ("row_id",)) -> DataFrame:
    """Add ``anomaly_score``, ``anomaly_flag`` and ``severity``.

    ``method`` is ``zscore``, ``forest``, or ``auto`` (forest from 8 eligible
    rows on). Both read the table once for statistics; the forest writes its raw
    scores beside the rows, so that the trees are walked once and the least and
    greatest score are read from one column. It draws rows by ``row_key``, which
    must be unique.
    """
    named = list(candidate_features(df) if features is None else features)
    if not named:
        return _labelled(df, F.lit(0.0))
    moments = feature_moments(df, named)
    features = [f for f in named if features is not None or moments[f"{f}_count"] >= 2]
    n = moments["eligible"]
    if features and len(features) < len(named):  # rows that had only a dropped feature are not eligible
        n = eligible_rows(df, features).count()
    if not features:
        return _labelled(df, F.lit(0.0))
    if method == "zscore" or n == 0 or (method == "auto" and n < V.MIN_FOREST_ROWS):
        return _labelled(df, z_score(features, moments))
    gaps = [f for f in features if moments[f"{f}_count"] < n]
    return _forest(df, features, gaps, n, trees, sample, seed, row_key)


def impute_median(df: DataFrame, features: Sequence[str]) -> dict[str, Column]:
    """Feature -> its value, or the feature's exact median where missing."""
    medians = exact_quantiles(df, {f: (F.col(f), [0.5]) for f in features})
    return {f: F.coalesce(F.col(f).cast("double"), F.lit(medians[f][0]).cast("double")) for f in features}


def min_max_scale(df: DataFrame, column: str, out: str) -> DataFrame:
    """``(x - min) / (max - min + 1e-9)``, missing as 0; one one-row aggregate."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    if ends["low"] is None:
        return df.withColumn(out, F.lit(0.0))
    scaled = (F.col(column) - ends["low"]) / (ends["high"] - ends["low"] + 1e-9)
    return df.withColumn(out, F.coalesce(scaled, F.lit(0.0)))


def scale_numbers(df: DataFrame, features: Sequence[str], gaps: Sequence[str] | None = None) -> dict[str, tuple[float, float, float]]:
    """Feature -> ``(fill, centre, width)``: its median, and median and IQR after filling, exact over the whole table.

    A feature without spread has width 1, one without values is all zero. ``gaps`` names the features with missing values
    where that is known; others need no median before they are filled.
    """
    gaps = list(features if gaps is None else gaps)
    medians = exact_quantiles(df, {f: (F.col(f), [0.5]) for f in gaps}) if gaps else {}
    fills = {f: medians[f][0] if medians.get(f, [None])[0] is not None else 0.0 for f in features}
    found = exact_quantiles(df, {f: (F.coalesce(F.col(f).cast("double"), F.lit(fills[f])), [0.25, 0.5, 0.75]) for f in features})
    out = {}
    for f in features:
        low, middle, high = found[f]
        out[f] = (0.0, 0.0, 1.0) if middle is None else (fills[f], middle, (high - low) or 1.0)
    return out


def robust_scale(df: DataFrame, features: Sequence[str]) -> dict[str, Column]:
    """Feature -> ``(filled - median) / IQR`` as a column."""
    numbers = scale_numbers(df, features)
    return {f: (F.coalesce(F.col(f).cast("double"), F.lit(fill)) - centre) / width for f, (fill, centre, width) in numbers.items()}


def _forest(df, features, gaps, n, trees, sample, seed, row_key) -> DataFrame:
    keys = [k for k in row_key if k in df.columns]
    if not keys:
        raise ValueError(f"the forest needs a unique key: none of {list(row_key)} is a column")
    plain = {f: F.col(f).cast("double") for f in features}
    filled = plain | (impute_median(df, gaps) if gaps else {})  # features that every eligible row has need no median
    rows = eligible_rows(df, features).select(
        *(F.col(k) for k in keys), *[filled[f].alias(f"_f{i}") for i, f in enumerate(features)])
    names = [f"_f{i}" for i in range(len(features))]
    packed, psi = fit_forest(rows, names, keys, n, trees, sample, seed)
    raw = forest_score(df.sparkSession, packed, psi, [filled[f] for f in features])
    scored = settle(df.withColumn("_raw", F.when(any_present(features), raw)), "forest-scores")  # the trees are walked once
    return _labelled(min_max_scale(scored, "_raw", "anomaly_score"), F.col("anomaly_score")).drop("_raw")


def severity_distribution(scored: DataFrame, severity: str | None = None) -> DataFrame:
    """Flagged rows per severity."""
    return flagged_rows(scored, severity).groupBy("severity").agg(F.count(F.lit(1)).alias("count"))


def flagged_rows(scored: DataFrame, severity: str | None = None) -> DataFrame:
    rows = scored.where("anomaly_flag")
    return rows.where(F.lower("severity") == severity.lower()) if severity else rows


def flag_top_fraction(scored: DataFrame, contamination: float) -> DataFrame:
    """Flag the rows above the ``1 - contamination`` quantile of the score, as ``contaminated``."""
    cut = exact_quantiles(scored, {"score": (F.col("anomaly_score"), [1.0 - contamination])})["score"][0]
    return scored.withColumn("contaminated", F.col("anomaly_score") > F.lit(cut))
