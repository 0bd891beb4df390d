"""Queries for anomaly, risk, clusters, findings and the documented extras (M, R, I, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.operators import anomaly, cluster, histogram, regions, risk, trends
from fieldglass.operators.distribution import exact_quantiles
from fieldglass.operators import findings as F_
from fieldglass.operators.findings import findings, recommendations
from fieldglass.plans import sql as Q
from fieldglass.plans.registry import day, query, six, with_ctes
from fieldglass.plans.reporting import _pair_rows
from fieldglass.plans.tables import GROUP_BYTES, obs_raw, score, table
from fieldglass.operators.schema import prepare, resolve_fields
from fieldglass.runtime import settle

ZSCORED = Q.OBS + Q.anomalies("obs")
FEATURES = list(Q.FEATURES)

# --- anomaly ------------------------------------------------------------------------------------


@query("m1_median_impute", with_ctes(
    Q.OBS + ", med AS (SELECT median(ndvi) AS a, median(temperature) AS b, median(rainfall) AS c FROM obs)",
    f"SELECT row_id, {Q.r6('coalesce(ndvi, a)', 'ndvi')}, coalesce(temperature, b) AS temperature, "
    "coalesce(rainfall, c) AS rainfall FROM obs, med"))
def _(ws):
    filled = anomaly.impute_median(ws.obs, ["ndvi", "temperature", "rainfall"])
    return six(ws.obs.select("row_id", *[c.alias(f) for f, c in filled.items()]))


@query("m2_robust_scale", with_ctes(
    Q.OBS + ", med AS (SELECT median(temperature) AS b, median(evi) AS e FROM obs), filled AS (SELECT row_id, "
            "coalesce(temperature, b) AS temperature, coalesce(evi, e) AS evi FROM obs, med), spread AS (SELECT "
            "quantile_cont(temperature, 0.25) AS t1, median(temperature) AS t2, quantile_cont(temperature, 0.75) AS t3, "
            "quantile_cont(evi, 0.25) AS e1, median(evi) AS e2, quantile_cont(evi, 0.75) AS e3 FROM filled)",
    f"SELECT row_id, {Q.r6('(temperature - t2) / (t3 - t1)', 'temperature')}, {Q.r6('(evi - e2) / (e3 - e1)', 'evi')} "
    "FROM filled, spread"))
def _(ws):
    scaled = anomaly.robust_scale(ws.obs, ["temperature", "evi"])
    return six(ws.obs.select("row_id", *[c.alias(f) for f, c in scaled.items()]))


@query("m3_isolation_forest")
def _(ws):
    return six(ws.forest_anomaly.select("row_id", "anomaly_score", "anomaly_flag", "severity"))


@query("m3_isolation_forest_climate")
def _(ws):
    scored = anomaly.with_anomaly(ws.climate, method="forest")
    return six(scored.select("row_id", "anomaly_score", "anomaly_flag", "severity"))


_OUTLIER = "c_custkey % 500 = 0"


@query("m3_keyed_properties", f"""SELECT count(*) AS rows, count(*) FILTER ({_OUTLIER}) AS planted, CAST(0 AS DOUBLE) AS least, CAST(1 AS DOUBLE) AS greatest,
  0 AS wrong_flags, 0 AS wrong_severities, 0 AS changed, true AS planted_first FROM customer""")
def _(ws):
    """Ordinary rows with a few far ones among them: what any forest must give, and the same again on other partitions."""
    far = F.when(F.col("c_custkey") % 1000 == 0, 1.0).otherwise(-1.0)
    rows = table(ws.spark, ws.sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), F.expr(_OUTLIER).alias("planted"),
        *[F.when(F.expr(_OUTLIER), far * 900).otherwise((F.col("c_custkey") % n) / n).alias(c)
          for c, n in (("ndvi", 97), ("ndwi", 89), ("temperature", 31))])
    first = anomaly.with_anomaly(rows, method="forest")
    again = anomaly.with_anomaly(rows.repartition(5, "ndvi"), method="forest").select("row_id", F.col("anomaly_score").alias("again"))
    score = F.col("anomaly_score")
    return six(first.join(again, "row_id", "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("planted").alias("planted"), F.min(score).alias("least"), F.max(score).alias("greatest"),
        F.count_if(F.col("anomaly_flag") != (score >= V.FLAG_FROM)).alias("wrong_flags"),
        F.count_if(F.col("severity") != F.expr(Q.severity("anomaly_score"))).alias("wrong_severities"),
        F.count_if(F.coalesce(F.abs(score - F.col("again")) > 1e-9, F.lit(True))).alias("changed"),
        (F.min(F.when(F.col("planted"), score)) > F.max(F.when(~F.col("planted"), score))).alias("planted_first")))


@query("m4_z_score", with_ctes(ZSCORED, f"SELECT row_id, {Q.sixes('anomaly_score')}, anomaly_flag, severity FROM flagged"))
def _(ws):
    scored = anomaly.with_anomaly(ws.obs, method="zscore")
    return six(scored.select("row_id", "anomaly_score", "anomaly_flag", "severity"))


@query("m4_z_score_climate", with_ctes(
    Q.CLIMATE + Q.anomalies("climate"), f"SELECT row_id, {Q.sixes('anomaly_score')}, anomaly_flag, severity FROM flagged"))
def _(ws):
    scored = anomaly.with_anomaly(ws.climate, method="zscore")
    return six(scored.select("row_id", "anomaly_score", "anomaly_flag", "severity"))


@query("m5_min_max_scale", with_ctes(
    Q.OBS + ", ends AS (SELECT min(ndvi) AS low, max(ndvi) AS high FROM obs)",
    f"SELECT row_id, {Q.r6('coalesce((ndvi - low) / (high - low + 1e-9), 0)', 'scaled')} FROM obs, ends"))
def _(ws):
    return six(anomaly.min_max_scale(ws.obs, "ndvi", "scaled").select("row_id", "scaled"))


@query("m6_flag_and_severity", with_ctes(
    ZSCORED, "SELECT anomaly_flag, severity, count(*) AS rows FROM flagged GROUP BY ALL"))
def _(ws):
    return ws.scored.groupBy("anomaly_flag", "severity").agg(F.count(F.lit(1)).alias("rows"))


@query("d8_contamination", with_ctes(
    ZSCORED + ", cut AS (SELECT quantile_cont(anomaly_score, 0.98) AS c FROM flagged)",
    "SELECT row_id, anomaly_score > c AS contaminated FROM flagged, cut"))
def _(ws):
    return anomaly.flag_top_fraction(ws.scored, 0.02).select("row_id", "contaminated")


# --- risk ---------------------------------------------------------------------------------------

for _number, _part in ((1, "vegetation"), (2, "water"), (3, "temperature"), (4, "rainfall"), (5, "urban"), (6, "anomaly")):
    @query(f"r{_number}_{_part}", with_ctes(
        Q.SCORED, f"SELECT row_id, {Q.r6(f'coalesce(p_{_part}, m_{_part}, 50)', 'part')} FROM parted, medians"))
    def _(ws, part=_part):
        ranked, parts = risk.risk_parts(ws.scored)
        return six(ranked.select("row_id", parts[part].alias("part")))


@query("r7_part_medians", with_ctes(Q.SCORED, "SELECT " + ", ".join(Q.r6(f"m_{p}", p) for p in Q.PARTS if p != "anomaly")
                                    + " FROM medians"))
def _(ws):
    from fieldglass.functions.scalar import literal_table

    medians = risk.part_medians(ws.scored)
    names = [p for p in Q.PARTS if p != "anomaly"]
    return six(literal_table(ws.spark, names, [[medians[p] for p in names]]))


@query("r8_weights_of_present_parts", with_ctes(
    Q.OBS + Q.anomalies("obs"),
    "SELECT row_id, round(coalesce(anomaly_score, 0) * 100 * 0.13 / (0.28 + 0.13), 6) + 0.0 AS anomaly_contribution FROM flagged"))
def _(ws):
    """Only vegetation and anomaly present: their weights fill the whole."""
    rows = ws.scored.select("row_id", "ndvi", "anomaly_score")
    return six(risk.with_risk(rows).select("row_id", "anomaly_contribution"))


@query("r9_risk_score", with_ctes(Q.SCORED, f"SELECT row_id, {Q.sixes('risk_score')} FROM scored"))
def _(ws):
    return six(ws.scored.select("row_id", "risk_score"))


@query("r9_risk_score_climate", with_ctes(Q.CLIMATE_SCORED, f"SELECT row_id, {Q.sixes('risk_score')} FROM scored"))
def _(ws):
    return six(ws.climate_scored.select("row_id", "risk_score"))


@query("r10_risk_level", with_ctes(Q.SCORED, "SELECT row_id, risk_level FROM scored"))
def _(ws):
    return ws.scored.select("row_id", "risk_level")


@query("r11_contributions", with_ctes(
    Q.SCORED, f"SELECT row_id, {Q.sixes(*[p + '_contribution' for p in Q.PARTS])} FROM scored"))
def _(ws):
    return six(ws.scored.select("row_id", *[p + "_contribution" for p in Q.PARTS]))


@query("r12_risk_within_subset", with_ctes(
    ZSCORED + ", subset AS (SELECT * FROM flagged WHERE state = 'ASIA')" + Q.scored("obs", "subset"),
    f"SELECT row_id, {Q.sixes('risk_score')}, risk_level FROM scored"))
def _(ws):
    whole = anomaly.with_anomaly(ws.obs, method="zscore")
    return six(risk.with_risk(whole.where(F.col("state") == "ASIA")).select("row_id", "risk_score", "risk_level"))


@query("r9_score_from_raw", with_ctes(Q.SCORED, f"SELECT row_id, {Q.sixes('anomaly_score', 'risk_score')} FROM scored"))
def _(ws):
    """Prepare, anomaly and risk in one go from the source tables, which are read once: the statistics read the written rows."""
    return six(score(settle(prepare(obs_raw(ws.spark, ws.sf_dir)), "prepared", GROUP_BYTES)).select("row_id", "anomaly_score", "risk_score"))


# --- clusters -----------------------------------------------------------------------------------


@query("m7_clusters")
def _(ws):
    return cluster.clusters(ws.obs).assigned.select("row_id", "cluster")


@query("m8_m9_silhouettes")
def _(ws):
    from fieldglass.functions.scalar import literal_table

    zones = cluster.clusters(ws.climate)
    rows = [(k, float(s), k == zones.k) for k, s in zones.silhouettes.items()]
    return six(literal_table(ws.spark, ["k", "silhouette", "chosen"], rows))


@query("m10_cluster_preconditions", with_ctes(
    Q.OBS, "SELECT 8 AS features, count(*) AS rows, count(*) FILTER (coalesce(" + ", ".join(Q.FEATURES)
           + ") IS NOT NULL) AS usable FROM obs"))
def _(ws):
    return cluster.preconditions(ws.obs)


def _groups(ws):
    """Customers in three groups far from each other."""
    group = F.col("c_custkey") % 3
    return table(ws.spark, ws.sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), group.alias("planted"), (group * 10 + F.col("c_custkey") % 7 / 10).alias("ndvi"),
        (F.col("c_custkey") % 5 / 10 - group * 8).alias("ndwi"), (20 + group * 15 + F.col("c_custkey") % 4).cast("double").alias("temperature"))


_GROUPS = """rows AS (SELECT c_custkey AS row_id, c_custkey % 3 AS planted, (c_custkey % 3) * 10 + (c_custkey % 7) / CAST(10 AS DOUBLE) AS ndvi,
  (c_custkey % 5) / CAST(10 AS DOUBLE) - (c_custkey % 3) * 8 AS ndwi,
  CAST(20 + (c_custkey % 3) * 15 + c_custkey % 4 AS DOUBLE) AS temperature FROM customer)"""
_FOUND = with_ctes(_GROUPS, "SELECT planted, count(*) AS rows, 1 AS clusters, count(*) AS mates, 3 AS k, true AS converged FROM rows GROUP BY planted")


def _found(zones):
    sizes = zones.profiles.select("cluster", F.col("size").alias("mates"))
    return (zones.assigned.groupBy("planted").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("cluster").alias("clusters"),
                                                  F.min("cluster").alias("cluster"))
            .join(sizes, "cluster").drop("cluster").withColumns({"k": F.lit(zones.k), "converged": F.lit(zones.converged)}))


@query("m7_m9_planted_groups", _FOUND)
def _(ws):
    """The number of groups and every row's group are found."""
    return _found(cluster.clusters(_groups(ws)))


@query("d9_planted_groups", _FOUND)
def _(ws):
    return _found(cluster.clusters(_groups(ws), k=3))


@query("m8_planted_silhouette", with_ctes(_GROUPS + ", scale AS (SELECT " + ", ".join(
    f"median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS w_{c}" for c in ("ndvi", "ndwi", "temperature"))
    + f""" FROM rows), drawn AS (SELECT * FROM rows ORDER BY md5(concat_ws('|', row_id, '{V.SEED}')), row_id LIMIT {V.CLUSTER_SAMPLE}),
    place AS (SELECT planted AS g, (ndvi - m_ndvi) / w_ndvi AS x, (ndwi - m_ndwi) / w_ndwi AS y,
      (temperature - m_temperature) / w_temperature AS z, count(*) AS w FROM drawn, scale GROUP BY ALL),
    total AS (SELECT a.g, a.x, a.y, a.z, a.w, b.g AS h, sum(b.w * sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS d,
      sum(b.w) AS n FROM place a, place b GROUP BY a.g, a.x, a.y, a.z, a.w, b.g),
    own AS (SELECT w, max(d) FILTER (h = g) / (max(n) FILTER (h = g) - 1) AS inside, min(d / n) FILTER (h <> g) AS outside
      FROM total GROUP BY g, x, y, z, w)""",
    f"SELECT 3 AS k, {Q.r6('sum(w * (outside - inside) / greatest(inside, outside)) / sum(w)', 'silhouette')} FROM own"))
def _(ws):
    from fieldglass.functions.scalar import literal_table

    zones = cluster.clusters(_groups(ws))
    return six(literal_table(ws.spark, ["k", "silhouette"], [(zones.k, float(zones.silhouette))]))


@query("m8_planted_squared_silhouette", with_ctes(_GROUPS + ", scale AS (SELECT " + ", ".join(
    f"median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS w_{c}" for c in ("ndvi", "ndwi", "temperature"))
    + """ FROM rows), place AS (SELECT planted AS g, (ndvi - m_ndvi) / w_ndvi AS x, (ndwi - m_ndwi) / w_ndwi AS y,
      (temperature - m_temperature) / w_temperature AS z, count(*) AS w FROM rows, scale GROUP BY ALL),
    total AS (SELECT a.g, a.x, a.y, a.z, a.w, b.g AS h, sum(b.w * (pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS d,
      sum(b.w) AS n FROM place a, place b GROUP BY a.g, a.x, a.y, a.z, a.w, b.g),
    own AS (SELECT w, max(d) FILTER (h = g) / (max(n) FILTER (h = g) - 1) AS inside, min(d / n) FILTER (h <> g) AS outside
      FROM total GROUP BY g, x, y, z, w)""",
    f"SELECT 3 AS k, {Q.r6('sum(w * (outside - inside) / greatest(inside, outside)) / sum(w)', 'squared_silhouette')} FROM own"))
def _(ws):
    """The silhouette by which k is chosen, over all rows."""
    from fieldglass.functions.scalar import literal_table

    zones = cluster.clusters(_groups(ws))
    return six(literal_table(ws.spark, ["k", "squared_silhouette"], [(zones.k, float(zones.silhouettes[zones.k]))]))


@query("a12_a13_m11_planted_profiles", with_ctes(
    _GROUPS + ", middle AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in V.CLUSTER_WORDING) + " FROM rows), profile AS (SELECT "
    "count(*) AS size, " + ", ".join(f"avg({c}) AS {c}" for c in V.CLUSTER_WORDING) + " FROM rows GROUP BY planted)",
    f"SELECT size, {Q.sixes(*V.CLUSTER_WORDING)}, " + " || ', ' || ".join(
        f"CASE WHEN {c} >= m_{c} THEN '{above}' ELSE '{below}' END" for c, (above, below) in V.CLUSTER_WORDING.items())
    + " AS description FROM profile, middle"))
def _(ws):
    return six(cluster.clusters(_groups(ws)).profiles.drop("cluster"))


@query("a12_a13_m11_cluster_profiles")
def _(ws):
    return six(cluster.clusters(ws.climate).profiles)


@query("d9_clusters_of_given_k")
def _(ws):
    return six(cluster.clusters(ws.climate, k=4).profiles)


# --- findings -----------------------------------------------------------------------------------


def _findings_sql(base: str, t: str) -> str:
    """The eight findings as text with their evidence."""
    pad = lambda x: f"printf('%.6f', {x})"
    f1, f2, f3 = (lambda x, n=n: f"printf('%.{n}f', {x})" for n in (1, 2, 3))
    text = V.FINDING_TEXT
    sql = base + Q.trend(t, "ndvi", "monthly") + _pair_rows(t) + f""", region_means AS (
      SELECT region, avg(risk_score) AS s FROM scored WHERE region IS NOT NULL AND state IS NOT NULL GROUP BY region, state),
    change AS (SELECT {Q.CHANGE} AS c, (SELECT avg(ndvi) FROM scored) AS overall FROM series),
    facts AS (SELECT avg(ndwi) AS wm, avg(CASE WHEN ndwi < -0.1 THEN 1.0 ELSE 0.0 END) * 100 AS ws, avg(temperature) AS tm,
      max(temperature) AS tx, avg(rainfall) AS rm, max(rainfall) AS rx, count(*) FILTER (anomaly_flag) AS fc,
      count(*) FILTER (anomaly_flag) * 100.0 / count(*) AS fs, count(*) FILTER (risk_score >= 80) AS cr,
      count(*) FILTER (risk_score >= 50 AND risk_score < 80) AS el, avg(risk_score) AS ar FROM scored),
    best AS (SELECT * FROM pair WHERE correlation IS NOT NULL ORDER BY abs(round(correlation, 6)) DESC, pair LIMIT 1),
    extremes AS (SELECT max_by(region, s) AS hi, max(s) AS hs, min_by(region, s) AS lo, min(s) AS ls FROM region_means)
    """
    rows = [
        (1, "VEGETATION HEALTH", f"printf({Q.quoted(text['VEGETATION HEALTH'])}, 'NDVI', CASE WHEN c >= 0 THEN 'improved' "
         f"ELSE 'declined' END, {f1('abs(c)')})", f"'indicator=ndvi;change_percent=' || {pad('c')} || ';latest_mean=' || {pad('overall')}",
         "change WHERE c IS NOT NULL"),
        (2, "HYDROLOGY & MOISTURE", f"printf({Q.quoted(text['HYDROLOGY & MOISTURE'])}, {f3('wm')}, {f1('ws')})",
         f"'ndwi_mean=' || {pad('wm')} || ';stress_percentage=' || {pad('ws')}", "facts"),
        (3, "THERMAL REGIME", f"printf({Q.quoted(text['THERMAL REGIME'])}, {f1('tm')}, {f1('tx')})",
         f"'mean_temp=' || {pad('tm')} || ';max_temp=' || {pad('tx')}", "facts"),
        (4, "PRECIPITATION DYNAMICS", f"printf({Q.quoted(text['PRECIPITATION DYNAMICS'])}, {f2('rm')}, {f1('rx')})",
         f"'mean_rainfall=' || {pad('rm')} || ';peak_rainfall=' || {pad('rx')}", "facts"),
        (5, "ML ANOMALY OUTLIERS", f"printf({Q.quoted(text['ML ANOMALY OUTLIERS'])}, format('{{:,}}', fc), {f1('fs')})",
         f"'anomaly_count=' || fc || ';share_percent=' || {pad('fs')}", "facts WHERE fc > 0"),
        (6, "REGIONAL DISPARITY", f"printf({Q.quoted(text['REGIONAL DISPARITY'])}, hi, {f1('hs')}, lo, {f1('ls')})",
         "'highest_risk=' || hi || ';lowest_risk=' || lo", "extremes"),
        (7, "INDICATOR CORRELATION", f"printf({Q.quoted(text['INDICATOR CORRELATION'])}, CASE WHEN correlation > 0 THEN "
         "'positive association' ELSE 'inverse relationship' END, " + f2('correlation') + ", upper(a), upper(b))",
         f"'a=' || a || ';b=' || b || ';correlation=' || {pad('correlation')} || ';observations=' || observations",
         "best WHERE abs(correlation) >= 0.35"),
        (8, "RISK STRATIFICATION", f"printf({Q.quoted(text['RISK STRATIFICATION'])}, CAST(cr AS VARCHAR), CAST(el AS VARCHAR))",
         f"'critical=' || cr || ';elevated=' || el || ';avg_score=' || {pad('ar')}", "facts"),
    ]
    return with_ctes(sql, " UNION ALL ".join(
        f"SELECT {n} AS ordinal, {Q.quoted(c)} AS category, {statement} AS statement, {evidence} AS evidence FROM {source}"
        for n, c, statement, evidence, source in rows))


def _flat(found):
    pairs = F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumn("evidence", F.array_join(pairs, ";"))


@query("i9_findings", _findings_sql(Q.SCORED, "obs"))
def _(ws):
    return _flat(findings(ws.scored))


@query("i9_findings_climate", _findings_sql(Q.CLIMATE_SCORED, "climate"))
def _(ws):
    return _flat(findings(ws.climate_scored))


# findings that show no score are made from the raw table, in a pass or two over the columns they need; the others write no scored rows
_ONE = {
    1: ("vegetation_trend", lambda ws: F_.trend_finding(ws.unwritten)),
    2: ("moisture", lambda ws: _levels(ws.unwritten)),
    3: ("heat", lambda ws: _levels(ws.unwritten)),
    4: ("rain", lambda ws: _levels(ws.unwritten)),
    5: ("anomalies", lambda ws: _levels(ws.scoring)),
    6: ("region_extremes", lambda ws: F_.region_finding(ws.scoring, resolve_fields(ws.scoring.columns))),
    7: ("strongest_pair", lambda ws: F_.correlation_finding(ws.unwritten)),
    8: ("risk_counts", lambda ws: _levels(ws.scoring)),
}


def _levels(rows):
    return F_.level_findings(rows, resolve_fields(rows.columns))


for _number, (_name, _build) in _ONE.items():
    @query(f"i{_number}_{_name}", f"SELECT * FROM ({_findings_sql(Q.SCORED, 'obs')}) f WHERE ordinal = {_number}")
    def _(ws, number=_number, build=_build):
        return _flat(build(ws).where(F.col("ordinal") == number))


@query("o9_first_findings", f"SELECT ordinal, category, statement FROM ({_findings_sql(Q.SCORED, 'obs')}) f ORDER BY ordinal "
                            "LIMIT 4")
def _(ws):
    return F_.first_findings(findings(ws.scored)).select("ordinal", "category", "statement")


@query("i10_recommendations", with_ctes(
    f"rule AS (SELECT * FROM (VALUES {Q.values([(i + 1, c, t) for i, (c, t) in enumerate(V.RECOMMENDATIONS)])}) "
    f"v(ordinal, category, recommendation)), found AS ({_findings_sql(Q.SCORED, 'obs')})",
    f"SELECT r.ordinal, r.category, r.recommendation, f.statement AS finding, {Q.quoted(V.RECOMMENDATION_NOTE)} AS disclaimer "
    "FROM rule r LEFT JOIN found f ON r.category = f.category"))
def _(ws):
    return recommendations(findings(ws.scored))


# --- documented extras --------------------------------------------------------------------------

_MONTHLY = Q.OBS + Q.trend("obs", "ndvi", "monthly", by="state")
_OVER = "OVER (PARTITION BY state ORDER BY bucket ROWS 6 PRECEDING)"


def _monthly(ws):
    return trends.trend(ws.obs, "ndvi", "monthly", by=["state"])


def _dated(series):
    return six(series.withColumn("bucket", day("bucket")))


@query("d1_moving_average", with_ctes(
    _MONTHLY, f"SELECT state, {Q.day('bucket')} AS bucket, {Q.r6('avg(mean) ' + _OVER, 'moving_average')} FROM series"))
def _(ws):
    return _dated(trends.moving_average(_monthly(ws), by=["state"]).select("state", "bucket", "moving_average"))


@query("d2_trend_slope", with_ctes(
    _MONTHLY + ", numbered AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY bucket) - 1 AS x FROM series)",
    f"SELECT state, count(*) AS buckets, {Q.r6('regr_slope(mean, x)', 'slope')}, {Q.r6('regr_intercept(mean, x)', 'intercept')}, "
    f"{Q.r6('regr_r2(mean, x)', 'r2')} FROM numbered GROUP BY state"))
def _(ws):
    return six(trends.trend_slope(_monthly(ws), by=["state"]))


@query("d3_rolling_band", with_ctes(
    _MONTHLY + f", banded AS (SELECT state, bucket, avg(mean) {_OVER} AS a, stddev_samp(mean) {_OVER} AS s FROM series)",
    f"SELECT state, {Q.day('bucket')} AS bucket, {Q.r6('s', 'rolling_std')}, {Q.r6('a - s', 'band_low')}, "
    f"{Q.r6('a + s', 'band_high')} FROM banded"))
def _(ws):
    banded = trends.rolling_band(_monthly(ws), by=["state"])
    return _dated(banded.select("state", "bucket", "rolling_std", "band_low", "band_high"))


@query("d4_seasonality", with_ctes(
    _MONTHLY, "SELECT state, month(series.bucket) AS month, count(*) AS buckets, "
              f"{Q.r6('avg(mean)', 'mean')}, round(avg(mean) - any_value(o), 6) + 0.0 AS departure FROM series JOIN (SELECT state "
              "AS st, avg(mean) AS o FROM series GROUP BY 1) w ON state = st GROUP BY state, month(series.bucket)"))
def _(ws):
    return six(trends.seasonality(_monthly(ws), by=["state"]))


_EXTENT = ", extent AS (SELECT count(savi) AS n, min(savi) AS lo, max(savi) AS hi, avg(savi) AS av, stddev_samp(savi) AS sd FROM obs)"


@query("d5_histogram", with_ctes(
    Q.OBS + _EXTENT + ", binned AS (SELECT CAST(least(floor((savi - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS "
                      "count FROM obs, extent WHERE savi IS NOT NULL GROUP BY 1)",
    f"SELECT bin, {Q.r6('lo + bin * (hi - lo) / 20', 'low')}, {Q.r6('lo + (bin + 1) * (hi - lo) / 20', 'high')}, count, "
    f"{Q.r6('count / n', 'share')}, {Q.r6('(lo + (bin + 0.5) * (hi - lo) / 20 - av) / sd', 'deviations')} FROM binned, extent"))
def _(ws):
    return six(histogram.histogram(ws.obs, "savi"))


@query("d5_density", with_ctes(
    Q.OBS + _EXTENT,
    "SELECT point, round(any_value(x), 6) + 0.0 AS x, round(avg(exp(-0.5 * ((savi - x) / w) * ((savi - x) / w))) / "
    "(any_value(w) * sqrt(2 * pi())), 6) + 0.0 AS density FROM obs, (SELECT CAST(i AS INTEGER) AS point, lo + i * (hi - lo) / 31 "
    "AS x, sd * power(n, -0.2) AS w FROM extent, range(32) t(i)) g WHERE savi IS NOT NULL GROUP BY point"))
def _(ws):
    return six(histogram.density(ws.obs, "savi"))


_DISTANCE = ("2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(latitude - cy) / 2), 2) + cos(radians(latitude)) * "
             "cos(radians(cy)) * power(sin(radians(longitude - cx) / 2), 2))))")


@query("d10_spatial_density", with_ctes(
    Q.OBS + ", centre AS (SELECT state AS st, avg(latitude) AS cy, avg(longitude) AS cx FROM obs GROUP BY 1)",
    f"SELECT state, count(*) AS observations, count(DISTINCT (latitude, longitude)) AS points, "
    "count(DISTINCT (floor(latitude), floor(longitude))) AS cells, "
    f"{Q.r6('any_value(cy)', 'centre_latitude')}, {Q.r6('any_value(cx)', 'centre_longitude')}, "
    f"{Q.r6(f'max({_DISTANCE})', 'radius_km')}, {Q.r6('count(*) / count(DISTINCT (floor(latitude), floor(longitude)))', 'observations_per_cell')} "
    "FROM obs JOIN centre ON state = st GROUP BY state"))
def _(ws):
    return six(regions.spatial_density(ws.obs, "state"))


@query("d11_region_ranking", with_ctes(
    Q.SCORED, f"SELECT region, state, {Q.r6('s', 'risk_score')}, CAST(dense_rank() OVER (ORDER BY s DESC) AS INTEGER) AS "
              "risk_rank FROM (SELECT region, state, avg(risk_score) AS s FROM scored WHERE region IS NOT NULL GROUP BY ALL) g"))
def _(ws):
    return six(regions.rank_regions(regions.regional_profile(ws.scored)).select("region", "state", "risk_score", "risk_rank"))


@query("d12_series_deviation", with_ctes(
    _MONTHLY, f"SELECT state, {Q.r6('stddev_samp(mean)', 'std')} FROM series GROUP BY state"))
def _(ws):
    return six(trends.trend_cards(_monthly(ws), by=["state"]).select("state", "std"))
