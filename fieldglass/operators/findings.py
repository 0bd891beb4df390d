"""Written findings and the recommendations they support."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.functions.scalar import fixed_text, literal_table, sql_literal
from fieldglass.operators.correlation import correlations
from fieldglass.operators.regions import extreme_regions, regional_profile
from fieldglass.operators.schema import resolve_fields
from fieldglass.operators.trends import bucket_of, change_percent

ORDER = {category: i + 1 for i, category in enumerate(V.FINDING_TEXT)}


def _number(column: str) -> str:
    return f"format_string('%.6f', CAST({column} AS DOUBLE))"


def _finding(category: str, arguments: list[str], evidence: Mapping[str, str], present: str) -> str:
    """SQL of one finding; its ordinal is missing when the rule has no result."""
    pairs = ", ".join(f"'{k}', CAST({v} AS STRING)" for k, v in evidence.items())
    text = ", ".join([sql_literal(V.FINDING_TEXT[category]), *arguments])
    return (f"named_struct('ordinal', IF({present}, {ORDER[category]}, NULL), 'category', {sql_literal(category)}, "
            f"'statement', format_string({text}), 'evidence', map({pairs}))")


def _rows(facts: DataFrame, found: list[str]) -> DataFrame:
    return facts.selectExpr(f"inline(array({', '.join(found)}))").where("ordinal IS NOT NULL")


def trend_finding(scored: DataFrame, index: str = "ndvi") -> DataFrame:
    months = scored.groupBy(bucket_of(F.col("_timestamp"), "monthly").alias("bucket")).agg(
        F.avg(index).alias("mean"), F.count(index).alias("count")).where(F.col("count") > 0)
    # the mean is that of all rows; only the change needs a time
    facts = months.withColumn("dated", F.expr("IF(bucket IS NULL, NULL, mean)")).agg(
        change_percent("dated", "bucket").alias("change"), F.expr("try_divide(sum(mean * count), sum(count)) AS overall"))
    return _rows(facts, [_finding(
        "VEGETATION HEALTH",
        [sql_literal(index.upper()), "IF(change >= 0, 'improved', 'declined')", fixed_text("abs(change)", 1)],
        {"indicator": sql_literal(index), "change_percent": _number("change"), "latest_mean": _number("overall")},
        "change IS NOT NULL",
    )])


def level_findings(scored: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Moisture, heat, rain, anomaly and risk findings: one aggregate over the table; without scores the first three."""
    def share(predicate):  # a missing value counts as false
        return f"avg(IF({predicate}, 1D, 0D)) * 100"

    facts = ["count(1) AS n"]
    found = []
    if "ndwi" in scored.columns:
        facts += ["avg(ndwi) AS ndwi_mean", f"{share(f'ndwi < {V.WATER_STRESS_BELOW}')} AS stress"]
        found.append(_finding("HYDROLOGY & MOISTURE", [fixed_text("ndwi_mean", 3), fixed_text("stress", 1)],
                              {"ndwi_mean": _number("ndwi_mean"), "stress_percentage": _number("stress")},
                              "ndwi_mean IS NOT NULL"))
    if "temperature" in fields:
        t = fields["temperature"]
        facts += [f"avg(`{t}`) AS t_mean", f"CAST(max(`{t}`) AS DOUBLE) AS t_max"]
        found.append(_finding("THERMAL REGIME", [fixed_text("t_mean", 1), fixed_text("t_max", 1)],
                              {"mean_temp": _number("t_mean"), "max_temp": _number("t_max")}, "t_mean IS NOT NULL"))
    if "rainfall" in fields:
        r = fields["rainfall"]
        facts += [f"avg(`{r}`) AS r_mean", f"CAST(max(`{r}`) AS DOUBLE) AS r_max"]
        found.append(_finding("PRECIPITATION DYNAMICS", [fixed_text("r_mean", 2), fixed_text("r_max", 1)],
                              {"mean_rainfall": _number("r_mean"), "peak_rainfall": _number("r_max")},
                              "r_mean IS NOT NULL"))
    if "anomaly_flag" in scored.columns:
        facts += ["count_if(anomaly_flag) AS flagged", f"{share('anomaly_flag')} AS flagged_share"]
        found.append(_finding("ML ANOMALY OUTLIERS", ["format_string('%,d', flagged)", fixed_text("flagged_share", 1)],
                              {"anomaly_count": "flagged", "share_percent": _number("flagged_share")}, "flagged > 0"))
    if "risk_score" in scored.columns:
        facts += ["avg(risk_score) AS risk", f"count_if(risk_score >= {V.FINDING_CRITICAL_FROM}) AS critical",
                  f"count_if(risk_score >= {V.FINDING_ELEVATED_FROM} AND risk_score < {V.FINDING_CRITICAL_FROM}) AS elevated"]
        found.append(_finding("RISK STRATIFICATION", ["CAST(critical AS STRING)", "CAST(elevated AS STRING)"],
                              {"critical": "critical", "elevated": "elevated", "avg_score": _number("risk")}, "n > 0"))
    return _rows(scored.agg(*map(F.expr, facts)), found)


def region_finding(scored: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    extremes = extreme_regions(regional_profile(scored, fields), fields["region"])
    return _rows(extremes, [_finding(
        "REGIONAL DISPARITY",
        ["CAST(highest AS STRING)", fixed_text("highest_risk", 1), "CAST(lowest AS STRING)", fixed_text("lowest_risk", 1)],
        {"highest_risk": "highest", "lowest_risk": "lowest"}, "highest IS NOT NULL")])


def correlation_finding(scored: DataFrame) -> DataFrame:
    # 28 pairs at most: the strongest is an aggregate over them
    best = correlations(scored, fewer_ok=True).agg(F.expr(
        "max_by(struct(a, b, correlation, observations), struct(abs(round(correlation, 6)), -pair)) AS p")).select("p.*")
    kind = "IF(correlation > 0, 'positive association', 'inverse relationship')"
    return _rows(best, [_finding(
        "INDICATOR CORRELATION", [kind, fixed_text("correlation", 2), "upper(a)", "upper(b)"],
        {"a": "a", "b": "b", "correlation": _number("correlation"), "observations": "observations"},
        f"abs(correlation) >= {V.STRONG_CORRELATION_FROM}")])


def union_findings(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of several tables of findings in rule order; each holds one row a rule at most."""
    return reduce(DataFrame.unionByName, parts).orderBy("ordinal")


def findings(scored: DataFrame, fields: Mapping[str, str] | None = None) -> DataFrame:
    """``(ordinal, category, statement, evidence)`` in rule order; rules without a result leave no row.

    Reads the scored table four times (by month, whole, by region, by pair):
    settle or store it first when it is expensive to compute.
    """
    fields = fields or resolve_fields(scored.columns)
    parts = [level_findings(scored, fields), correlation_finding(scored)]
    if "ndvi" in scored.columns:
        parts.append(trend_finding(scored))
    if "region" in fields:
        parts.append(region_finding(scored, fields))
    return union_findings(parts)


def first_findings(found: DataFrame, n: int = V.FIRST_FINDINGS) -> DataFrame:
    return found.orderBy("ordinal").limit(n)


def recommendations(found: DataFrame) -> DataFrame:
    """The fixed recommendations in order, each with the finding that supports it where there is one."""
    rows = [(i + 1, category, text) for i, (category, text) in enumerate(V.RECOMMENDATIONS)]
    rules = literal_table(found.sparkSession, ["ordinal", "category", "recommendation"], rows)
    support = found.select(F.col("category").alias("_category"), F.col("statement").alias("finding"))
    return (
        rules.join(F.broadcast(support), F.col("category") == F.col("_category"), "left").drop("_category")
        .withColumn("disclaimer", F.lit(V.RECOMMENDATION_NOTE)).orderBy("ordinal")
    )
