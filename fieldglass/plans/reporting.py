"""Queries for filters, joins, aggregates, ranks, sorting and set operations (F, J, A, W, O, U)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.operators import anomaly, browse, correlation, counts, pages, points, regions, risk, search_index, trends
from fieldglass.operators.browse import sort_rows
from fieldglass.operators.distribution import with_percent_rank, with_row_position
from fieldglass.operators.findings import level_findings, region_finding, union_findings
from fieldglass.operators.reports import attach_scores, flagged, flagged_after, flagged_total, report
from fieldglass.operators.schema import prepare, present, resolve_fields
from fieldglass.plans import sql as Q
from fieldglass.plans.registry import day, nine, query, six, with_ctes
from fieldglass.plans.tables import climate_feed, climate_raw, obs_raw, table
from fieldglass.runtime import scratch_path, settle
from fieldglass.sources.readers import normalise_climate_feed

SERIES = f"SELECT {Q.day('bucket')} AS bucket, {Q.sixes('mean', 'min', 'max')}, count FROM series"


def shown(series: DataFrame) -> DataFrame:
    return six(series.withColumn("bucket", day("bucket")))


# --- filters ------------------------------------------------------------------------------------


@query("f1_region_exact", with_ctes(Q.OBS + Q.trend("obs", "ndvi", "monthly", "region = 'NATION_3'"), SERIES))
def _(ws):
    return shown(trends.trend(prepare(obs_raw(ws.spark, ws.sf_dir)), "ndvi", "monthly", region="NATION_3"))


@query("f2_region_any_case", with_ctes(
    Q.SCORED, f"SELECT row_id, {Q.sixes('risk_score')} FROM scored WHERE lower(region) = lower('nation_4')"))
def _(ws):
    return six(points.matching(ws.scored, region="nation_4").select("row_id", "risk_score"))


@query("f3_state_any_case", with_ctes(
    Q.SCORED, f"SELECT row_id, state, {Q.sixes('risk_score')} FROM scored WHERE lower(state) = 'asia'"))
def _(ws):
    return six(points.matching(ws.scored, state="AsIa").select("row_id", "state", "risk_score"))


@query("f4_risk_level", with_ctes(
    Q.SCORED, f"SELECT row_id, {Q.sixes('risk_score')} FROM scored WHERE {Q.level('risk_score')} = 'Elevated'"))
def _(ws):
    return six(points.matching(ws.scored, risk="Elevated").select("row_id", "risk_score"))


@query("f5_flagged_only", with_ctes(
    Q.SCORED, f"SELECT row_id, {Q.sixes('anomaly_score')}, severity FROM scored WHERE anomaly_flag"))
def _(ws):
    return six(points.matching(ws.scored, anomalies_only=True).select("row_id", "anomaly_score", "severity"))


@query("f6_time_range", with_ctes(
    Q.OBS + Q.trend("obs", "ndvi", "monthly", "ts >= TIMESTAMP '1997-03-05' AND ts <= TIMESTAMP '1999-06-15'"), SERIES))
def _(ws):
    return shown(trends.trend(prepare(obs_raw(ws.spark, ws.sf_dir)), start="1997-03-05", end="1999-06-15"))


@query("f6_unreadable_bound_ignored", with_ctes(
    Q.OBS + Q.trend("obs", "ndvi", "yearly", "ts <= TIMESTAMP '1999-06-15'"), SERIES))
def _(ws):
    return shown(trends.trend(ws.obs, every="yearly", start="not a date", end="1999-06-15"))


@query("f7_drop_rows_missing_any", with_ctes(
    Q.OBS, "SELECT row_id FROM obs WHERE ts IS NOT NULL AND ndvi IS NOT NULL AND rainfall IS NOT NULL"))
def _(ws):
    return present(ws.obs, ["_timestamp", "ndvi", "rainfall"]).select("row_id")


@query("f8_drop_rows_missing_all", with_ctes(
    Q.OBS, "SELECT row_id FROM obs WHERE coalesce(ndvi, temperature, rainfall) IS NOT NULL"))
def _(ws):
    return anomaly.eligible_rows(ws.obs, ["ndvi", "temperature", "rainfall"]).select("row_id")


@query("f9_severity_any_case", with_ctes(
    Q.SCORED, f"SELECT row_id, {Q.sixes('anomaly_score')} FROM scored WHERE anomaly_flag AND lower(severity) = 'high'"))
def _(ws):
    return six(anomaly.flagged_rows(ws.scored, "HIGH").select("row_id", "anomaly_score"))


@query("f10_text_search",
       "SELECT event_id, event_type, props FROM events WHERE contains(lower(event_type), 'cli') OR "
       "contains(lower(props), 'cli') OR contains(CAST(event_id AS VARCHAR), 'cli') OR "
       "contains(CAST(user_id AS VARCHAR), 'cli')")
def _(ws):
    rows = table(ws.spark, ws.sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    return browse.search_rows(rows, "CLI").select("event_id", "event_type", "props")


@query("f10_search_by_dictionary",
       "SELECT event_id, event_type, props FROM events WHERE contains(lower(event_type), 'cli') OR "
       "contains(lower(props), 'cli') OR contains(CAST(event_id AS VARCHAR), 'cli') OR "
       "contains(CAST(user_id AS VARCHAR), 'cli')")
def _(ws):
    """The same search through an index of the text columns' values."""
    rows = table(ws.spark, ws.sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    index = scratch_path(ws.spark, "search-index")
    search_index.search_index(rows, index)
    return search_index.search_indexed(rows, index, "CLI").select("event_id", "event_type", "props")


@query("f10_urls_by_dictionary",
       "SELECT page_id, url FROM pages WHERE contains(lower(url), '.com/fr/8')")
def _(ws):
    """Nearly every value is distinct: matching ones are found by their rarest trigram, and named or scanned for by their number."""
    rows = table(ws.spark, ws.sf_dir, "pages").select("page_id", "url")
    index = scratch_path(ws.spark, "url-index")
    search_index.search_index(rows, index)
    return search_index.search_indexed(rows, index, ".com/FR/8")


@query("f11_threshold_counts", with_ctes(
    Q.SCORED, "SELECT count(*) FILTER (risk_score >= 61) AS high, count(*) FILTER (risk_score >= 80) AS critical, "
              "count(*) FILTER (risk_score >= 50 AND risk_score < 80) AS elevated, "
              "count(*) FILTER (ndwi < -0.1) AS stressed FROM scored"))
def _(ws):
    return counts.threshold_counts(ws.scored)


_POINT_MEANS = ", ".join(f"avg({c}) AS {c}" for c in V.POINT_MEANS)


def _points(where: str = "true", source: str = "scored") -> str:
    return (f", point AS (SELECT latitude, longitude, region, state, {_POINT_MEANS} FROM {source} WHERE {where} AND "
            "latitude IS NOT NULL AND longitude IS NOT NULL AND region IS NOT NULL AND state IS NOT NULL GROUP BY ALL)")


_POINT_ROWS = (f"SELECT latitude, longitude, region, state, region AS city, {Q.sixes(*V.POINT_MEANS)}, "
               f"{Q.level('risk_score')} AS severity, coalesce(risk_score >= 60, false) AS hot FROM point")


@query("f12_hot_points", with_ctes(
    Q.CLIMATE_SCORED, f"SELECT region, avg(risk_score) >= 60 AS hot, {Q.r9('avg(risk_score)', 'risk_score')} FROM scored "
                      "WHERE region IS NOT NULL AND region <> 'Atlantis' GROUP BY region"))
def _(ws):
    located = _with_station(ws.climate_scored)
    return nine(points.group_points(located).select("region", "hot", "risk_score"))


def _with_station(rows: DataFrame) -> DataFrame:
    """Climate rows with their station's coordinates, where the station is known."""
    from fieldglass.sources.readers import station_table

    return rows.join(F.broadcast(station_table(rows.sparkSession)), "region", "left")


# --- joins --------------------------------------------------------------------------------------


@query("j2_scores_attached", with_ctes(
    Q.SCORED, f"SELECT row_id, {Q.sixes('ndvi', 'anomaly_score', 'risk_score')} FROM scored"))
def _(ws):
    """Scores computed apart, joined back by row key."""
    return six(attach_scores(ws.obs.select("row_id", "ndvi"), ws.scored, ["anomaly_score", "risk_score"]))


@query("j3_anomaly_with_risk", with_ctes(
    Q.SCORED, f"SELECT row_id, {Q.sixes('anomaly_score', 'risk_score')}, severity, risk_level FROM scored"))
def _(ws):
    anomalies = ws.scored.select("row_id", "anomaly_score", "anomaly_flag", "severity")
    risks = ws.scored.select("row_id", "risk_score", "risk_level", *[f"{p}_contribution" for p in Q.PARTS])
    return six(report(anomalies, "anomalies", risks).select("row_id", "anomaly_score", "risk_score", "severity", "risk_level"))


_PROFILE = (f"SELECT region, state, {Q.nines(*Q.FEATURES, 'risk_score')}, observations FROM (SELECT region, state, "
            + ", ".join(f"avg({c}) AS {c}" for c in (*Q.FEATURES, "risk_score"))
            + ", any_value(n) AS observations FROM (SELECT *, count(*) OVER (PARTITION BY region) AS n FROM scored) s "
              "WHERE region IS NOT NULL AND state IS NOT NULL GROUP BY region, state) g")


@query("j4_counts_onto_means", with_ctes(
    Q.CLIMATE_SCORED, "SELECT region, state, count(*) AS observations FROM scored WHERE region IS NOT NULL GROUP BY ALL"))
def _(ws):
    return regions.regional_profile(ws.climate_scored).select("region", "state", "observations")


@query("j5_scalar_broadcast", with_ctes(
    Q.OBS + ", moments AS (SELECT avg(ndvi) AS a, stddev_pop(ndvi) AS s FROM obs)",
    f"SELECT row_id, {Q.r6('(ndvi - a) / s', 'z')} FROM obs, moments"))
def _(ws):
    """One-row statistics enter the row expressions as constants."""
    at = anomaly.feature_moments(ws.obs, ["ndvi"])
    return six(ws.obs.select("row_id", ((F.col("ndvi") - at["ndvi_mean"]) / at["ndvi_std"]).alias("z")))


@query("j6_score_realignment", with_ctes(
    Q.OBS + Q.anomalies("obs"),
    f"SELECT o.row_id, {Q.r6('coalesce(f.anomaly_score, 0)', 'anomaly_score')} FROM obs o LEFT JOIN (SELECT * FROM flagged "
    "WHERE anomaly_flag) f USING (row_id)"))
def _(ws):
    return six(attach_scores(ws.obs.select("row_id"), anomaly.flagged_rows(ws.scored), ["anomaly_score"], missing=0.0))


@query("j7_map_positions", with_ctes(
    Q.CLIMATE_RAW + ", " + Q.STATIONS + ", " + Q.POSITIONS,
    "SELECT DISTINCT region AS city, coalesce(map_lat, lat) AS map_latitude, coalesce(map_lon, lon) AS map_longitude "
    "FROM climate_raw JOIN station ON region = name LEFT JOIN position ON region = city_name"))
def _(ws):
    feed = normalise_climate_feed(climate_feed(ws.spark, ws.sf_dir))
    placed = points.map_positions(points.group_points(prepare(feed)))
    return placed.select("city", "map_latitude", "map_longitude")


# --- aggregates ---------------------------------------------------------------------------------

_SUMMARY = ("SELECT count(*) AS rows, {width} AS columns, count(DISTINCT region) AS regions, count(DISTINCT state) AS states, "
            + ", ".join(Q.r9(f"avg({i})", f"mean_{i}") for i in V.INDEX_NAMES)
            + f", {Q.r9('avg(risk_score)', 'average_risk')}, count(*) FILTER (risk_score >= 61) AS high_risk FROM scored")


@query("a1_summary", with_ctes(Q.SCORED, _SUMMARY.format(width=20)))
def _(ws):
    return nine(regions.summary(ws.scored))


@query("a1_summary_climate", with_ctes(Q.CLIMATE_SCORED, _SUMMARY.format(width=13)))
def _(ws):
    return nine(regions.summary(ws.climate_scored))


def _cards(t: str, where: str = "true", keys=None) -> str:
    parts = []
    for key, name, full, text, healthy, stressed in V.INDICATOR_CARDS:
        if keys and key not in keys:
            continue
        monthly = (f"(SELECT {Q.bucket('monthly')} AS bucket, avg({key}) AS mean FROM {t} WHERE {where} AND ts IS NOT NULL AND "
                   f"{key} IS NOT NULL GROUP BY 1)")
        parts.append(
            f"SELECT '{key}' AS key, '{name}' AS name, {Q.quoted(full)} AS full_name, {Q.quoted(text)} AS description, "
            f"'{healthy}' AS healthy_range, '{stressed}' AS stressed_range, {Q.r9(f'avg({key})', 'current_average')}, "
            f"{Q.r9(f'min({key})', 'minimum')}, {Q.r9(f'max({key})', 'maximum')}, {Q.r9(f'stddev_samp({key})', 'std')}, "
            f"(SELECT round({Q.CHANGE}, 9) + 0.0 FROM {monthly} x) AS trend FROM {t} WHERE {where}")
    return " UNION ALL ".join(parts)


@query("a2_index_cards", with_ctes(Q.OBS, _cards("obs")))
def _(ws):
    return nine(regions.index_cards(ws.obs).drop("ordinal"))


@query("a2_index_cards_climate", with_ctes(Q.CLIMATE, _cards("climate")))
def _(ws):
    return nine(regions.index_cards(ws.climate).drop("ordinal"))


@query("d6_index_card_of_region", with_ctes(Q.OBS, _cards("obs", "region = 'NATION_7'", ["ndwi"])))
def _(ws):
    return nine(regions.index_cards(ws.obs, region="NATION_7", index="ndwi").drop("ordinal"))


for _every in trends.UNITS:
    @query(f"a3_trend_{_every}", with_ctes(Q.OBS + Q.trend("obs", "ndvi", _every), SERIES))
    def _(ws, every=_every):
        return shown(trends.trend(prepare(obs_raw(ws.spark, ws.sf_dir)), "ndvi", every))


@query("a3_trend_weekly_climate", with_ctes(Q.CLIMATE + Q.trend("climate", "rainfall", "weekly"), SERIES))
def _(ws):
    return shown(trends.trend(ws.climate, "rainfall", "weekly"))


@query("a4_net_change", with_ctes(
    Q.OBS + Q.trend("obs", "ndvi", "monthly", by="region"),
    f"SELECT region, {Q.r6(Q.CHANGE, 'change_percent')} FROM series GROUP BY region"))
def _(ws):
    return six(trends.trend_change(trends.trend(ws.obs, "ndvi", "monthly", by=["region"]), by=["region"]))


@query("a5_series_cards", with_ctes(
    Q.OBS + Q.trend("obs", "temperature", "monthly", by="region"),
    f"SELECT region, {Q.r6('avg(mean)', 'mean')}, {Q.r6('min(mean)', 'min')}, {Q.r6('max(mean)', 'max')}, "
    f"{Q.r6('stddev_samp(mean)', 'std')}, CAST(sum(count) AS BIGINT) AS observations, {Q.r6(Q.CHANGE, 'change_percent')} "
    "FROM series GROUP BY region"))
def _(ws):
    return six(trends.trend_cards(trends.trend(ws.obs, "temperature", "monthly", by=["region"]), by=["region"]))


@query("a6_regional_profile", with_ctes(Q.SCORED, _PROFILE))
def _(ws):
    return nine(regions.regional_profile(ws.scored))


@query("a6_regional_profile_climate", with_ctes(Q.CLIMATE_SCORED, _PROFILE))
def _(ws):
    return nine(regions.regional_profile(ws.climate_scored))


def _pearson(a: str, b: str) -> str:
    ok = f"FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    return (f"CASE WHEN count(*) {ok} >= 3 THEN covar_pop({a}, {b}) / nullif(stddev_pop({a}) {ok} * stddev_pop({b}) {ok}, 0) "
            "END")


def _pair_rows(t: str) -> str:
    return ", pair AS (" + " UNION ALL ".join(
        f"SELECT {i} AS pair, '{a}' AS a, '{b}' AS b, {_pearson(a, b)} AS correlation, "
        f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS observations FROM {t}"
        for i, (a, b) in enumerate(combinations(Q.FEATURES, 2))) + ")"


@query("a7_correlation_matrix", with_ctes(
    Q.OBS + _pair_rows("obs"),
    "SELECT indicator, " + ", ".join(
        f"round(max(r) FILTER (other = '{f}'), 6) + 0.0 AS {f}" for f in Q.FEATURES)
    + " FROM (SELECT a AS indicator, b AS other, correlation AS r FROM pair UNION ALL SELECT b, a, correlation FROM pair "
      "UNION ALL SELECT DISTINCT a, a, 1.0 FROM (SELECT a FROM pair UNION ALL SELECT b FROM pair) n) m GROUP BY 1"))
def _(ws):
    return six(correlation.correlation_matrix(correlation.correlations(ws.obs), Q.FEATURES))


@query("a8_correlation_pairs", with_ctes(
    Q.OBS + _pair_rows("obs"), f"SELECT a, b, {Q.sixes('correlation')}, observations FROM pair WHERE correlation IS NOT NULL"))
def _(ws):
    return six(correlation.correlations(ws.obs).drop("pair"))


@query("a9_points", with_ctes(Q.SCORED + _points(), _POINT_ROWS))
def _(ws):
    return six(points.points(ws.scored))


@query("a9_points_filtered", with_ctes(
    Q.SCORED + _points("lower(state) = 'asia' AND anomaly_flag"), _POINT_ROWS))
def _(ws):
    return six(points.points(ws.scored, state="ASIA", anomalies_only=True))


@query("a9_matching_total", with_ctes(
    Q.SCORED, "SELECT count(*) AS total_matching FROM scored WHERE risk_level = 'Moderate' AND anomaly_flag"))
def _(ws):
    return points.matching_total(ws.scored, risk="Moderate", anomalies_only=True)


@query("a10_severity_distribution", with_ctes(
    Q.SCORED, "SELECT severity, count(*) AS count FROM scored WHERE anomaly_flag GROUP BY 1"))
def _(ws):
    return anomaly.severity_distribution(ws.scored)


@query("a11_risk_report", with_ctes(
    Q.SCORED, f"SELECT {Q.r6('avg(risk_score)', 'average')}, "
    + ", ".join(Q.r6(f"avg({p}_contribution)", p) for p in Q.PARTS) + ", "
    + ", ".join(f"count(*) FILTER (risk_level = '{v}') AS rows_{v.lower()}" for v in V.RISK_LEVELS) + " FROM scored"))
def _(ws):
    return six(risk.risk_report(ws.scored).drop("disclaimer"))


@query("a11_level_distribution", with_ctes(Q.SCORED, "SELECT risk_level, count(*) AS count FROM scored GROUP BY 1"))
def _(ws):
    return risk.risk_distribution(ws.scored)


@query("a15_distinct_counts", with_ctes(
    Q.CLIMATE_RAW, "SELECT count(DISTINCT region) AS regions, count(DISTINCT temperature) AS temperatures FROM climate_raw"))
def _(ws):
    found = counts.distinct_counts(climate_raw(ws.spark, ws.sf_dir), ["region", "temperature"])
    return found.select(F.col("region").alias("regions"), F.col("temperature").alias("temperatures"))


@query("a16_deviations", with_ctes(
    Q.OBS, f"SELECT state, {Q.r6('stddev_pop(ndvi)', 'population')}, {Q.r6('stddev_samp(ndvi)', 'sample')} FROM obs GROUP BY 1"))
def _(ws):
    return six(counts.deviations(ws.obs, "ndvi", ["state"]))


@query("a17_share_of_rows", with_ctes(
    Q.OBS, f"SELECT state, {Q.r6('avg(CASE WHEN ndwi < -0.1 THEN 1.0 ELSE 0.0 END) * 100', 'share')} FROM obs GROUP BY 1"))
def _(ws):
    return six(counts.share_of_rows(ws.obs, counts.short_of_water(), ["state"]))


# --- ranks and positions ------------------------------------------------------------------------


@query("w1_percent_rank", with_ctes(
    Q.OBS, f"SELECT row_id, {Q.r9(Q.percent_rank('temperature'), 'temperature_pct')}, "
           f"{Q.r9(Q.percent_rank('rainfall'), 'rainfall_pct')} FROM obs"))
def _(ws):
    ranked = with_percent_rank(ws.obs, {"temperature": "temperature_pct", "rainfall": "rainfall_pct"})
    return nine(ranked.select("row_id", "temperature_pct", "rainfall_pct"))


@query("w1_percent_rank_many_values", with_ctes(
    Q.OBS, f"SELECT row_id, {Q.r9(Q.percent_rank('swir'), 'swir_pct')} FROM obs"))
def _(ws):
    """The way for large inputs, forced: range partitions, hot values broadcast, cold values joined by shuffle."""
    ranked = with_percent_rank(ws.obs.select("row_id", "swir"), {"swir": "swir_pct"}, range_rows=2000)
    return nine(ranked.select("row_id", "swir_pct"))


@query("w2_first_and_last", with_ctes(
    Q.OBS + Q.trend("obs", "ndvi", "monthly", by="state"),
    f"SELECT state, {Q.r6('min_by(mean, bucket)', 'first_mean')}, {Q.r6('max_by(mean, bucket)', 'last_mean')} FROM series "
    "GROUP BY state"))
def _(ws):
    series = trends.trend(ws.obs, "ndvi", "monthly", by=["state"])
    return six(trends.first_and_last(series, ["state"]))


@query("w3_row_position", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events")
def _(ws):
    rows = table(ws.spark, ws.sf_dir, "events").select("event_id", "ts")
    return with_row_position(rows, ["ts", "event_id"]).select("event_id", "position")


@query("w3_row_position_ranges", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events")
def _(ws):
    """The way for large inputs, forced: range partitions and their offsets."""
    rows = table(ws.spark, ws.sf_dir, "events").select("event_id", "ts")
    return with_row_position(rows, ["ts", "event_id"], range_rows=1500).select("event_id", "position")


# --- sort, limit, sample ------------------------------------------------------------------------


@query("o1_sorted_page", with_ctes(
    Q.OBS, f"SELECT row_id, rainfall, {Q.sixes('ndvi')} FROM obs ORDER BY rainfall DESC NULLS LAST, row_id LIMIT 500"))
def _(ws):
    return six(browse.browse(ws.obs, sort="rainfall", order="desc", page_size=500).select("row_id", "rainfall", "ndvi"))


@query("o1_sorted_ascending_missing_last", with_ctes(
    Q.OBS, "SELECT row_id, temperature FROM obs ORDER BY temperature NULLS LAST, row_id LIMIT 50"))
def _(ws):
    return browse.browse(ws.obs, sort="temperature").select("row_id", "temperature")


@query("o2_second_page_of_search", with_ctes(
    Q.OBS, "SELECT row_id, region FROM obs WHERE contains(lower(region), 'nation_1') OR contains(row_id, 'nation_1') "
           "ORDER BY row_id LIMIT 50 OFFSET 50"))
def _(ws):
    return browse.browse(ws.obs, search="Nation_1", page=2).select("row_id", "region")


@query("o2_total_of_search", with_ctes(
    Q.OBS, "SELECT count(*) AS total FROM obs WHERE contains(lower(region), 'nation_1')"))
def _(ws):
    return browse.browse_total(ws.obs, "Nation_1")


@query("o2_keyset_page", with_ctes(
    Q.OBS, "SELECT row_id FROM obs WHERE row_id > '3' ORDER BY row_id LIMIT 50"))
def _(ws):
    return browse.page_after(ws.obs.select("row_id"), "row_id", "3")


@query("o2_deep_page_by_number", with_ctes(
    Q.OBS, f"SELECT row_id, rainfall, {Q.sixes('ndvi')} FROM obs ORDER BY rainfall DESC NULLS LAST, row_id LIMIT 50 OFFSET "
           "(SELECT count(*) // 100 * 50 FROM obs)"))
def _(ws):
    """The page in the middle of the table, through the index of every n-th row."""
    index = settle(pages.page_index(ws.obs, "rainfall", "desc"), "pages")
    middle = ws.obs.count() // 100 + 1
    return six(pages.page_at(ws.obs, index, middle).select("row_id", "rainfall", "ndvi"))


@query("o3_flagged_page_after", with_ctes(
    Q.SCORED, f"SELECT {Q.day('ts')} AS _timestamp, region, state, latitude, longitude, severity, temperature, "
              f"{Q.sixes('anomaly_score', 'ndvi', 'ndwi', 'risk_score')} FROM (SELECT * FROM scored WHERE anomaly_flag "
              "ORDER BY anomaly_score DESC, row_id LIMIT 50 OFFSET 50) p"))
def _(ws):
    """The second page, from the last row of the first one."""
    ends = sort_rows(anomaly.flagged_rows(ws.scored), "anomaly_score", "desc", ("row_id",)).limit(50).select("anomaly_score", "row_id").tail(1)
    after = flagged_after(ws.scored, ends[0]["anomaly_score"], ends[0]["row_id"]) if ends else ws.scored.limit(0)
    return six(after.withColumn("_timestamp", day("_timestamp")))


@query("o3_flagged_by_score", with_ctes(
    Q.SCORED, f"SELECT {Q.day('ts')} AS _timestamp, region, state, latitude, longitude, severity, temperature, "
              f"{Q.sixes('anomaly_score', 'ndvi', 'ndwi', 'risk_score')} FROM (SELECT * FROM scored WHERE anomaly_flag "
              "ORDER BY anomaly_score DESC, row_id LIMIT 50) p"))
def _(ws):
    return six(flagged(ws.scored).withColumn("_timestamp", day("_timestamp")))


@query("o3_flagged_total", with_ctes(Q.SCORED, "SELECT count(*) AS total FROM scored WHERE anomaly_flag"))
def _(ws):
    return flagged_total(ws.scored)


@query("o4_extreme_regions", with_ctes(
    Q.SCORED + ", g AS (SELECT region, avg(risk_score) AS s FROM scored WHERE region IS NOT NULL GROUP BY region, state)",
    f"SELECT max_by(region, s) AS highest, {Q.r6('max(s)', 'highest_risk')}, min_by(region, s) AS lowest, "
    f"{Q.r6('min(s)', 'lowest_risk')} FROM g"))
def _(ws):
    return six(regions.extreme_regions(regions.regional_profile(ws.scored)))


@query("o5_strongest_pairs", with_ctes(
    Q.OBS + _pair_rows("obs"),
    f"SELECT a, b, {Q.sixes('correlation')}, observations FROM (SELECT * FROM pair WHERE correlation IS NOT NULL ORDER BY "
    "abs(round(correlation, 6)) DESC, pair LIMIT 8) p"))
def _(ws):
    return six(correlation.strongest(correlation.correlations(ws.obs)).drop("pair"))


@query("o6_point_sample", with_ctes(
    "place AS (SELECT CAST(c_custkey % 90 AS DOUBLE) AS latitude, CAST(c_custkey % 179 AS DOUBLE) AS longitude, "
    f"CAST(c_nationkey AS VARCHAR) AS region, {Q.quoted(V.UNKNOWN_STATE)} AS state, avg(c_acctbal) AS ndvi FROM customer GROUP BY 1, 2, 3, 4)",
    f"SELECT latitude, longitude, region, region AS city, state, {Q.r6('ndvi')} FROM place "
    f"ORDER BY md5(concat_ws('|', latitude, longitude, region, state, '{V.SEED}')), latitude, longitude, region LIMIT {V.MAX_POINTS}"))
def _(ws):
    """A seeded choice of at most 500 places; here places are suppliers."""
    rows = table(ws.spark, ws.sf_dir, "customer").select(
        (F.col("c_custkey") % 90).cast("double").alias("latitude"), (F.col("c_custkey") % 179).cast("double").alias("longitude"),
        F.col("c_nationkey").cast("string").alias("region"), F.col("c_acctbal").alias("ndvi"))
    return six(points.cap_points(points.group_points(rows)))


@query("o7_cluster_sample", with_ctes(
    Q.OBS, f"SELECT row_id, {Q.r6('ndvi')} FROM (SELECT * FROM obs ORDER BY md5(concat_ws('|', row_id, '{V.SEED}')), row_id "
           f"LIMIT {V.CLUSTER_SAMPLE}) s"))
def _(ws):
    from fieldglass.operators.cluster import seeded_sample

    rows = ws.obs.select("row_id", "ndvi")
    return six(seeded_sample(rows, V.CLUSTER_SAMPLE, V.SEED, ["row_id"]))


@query("o8_last_buckets", with_ctes(
    Q.OBS + Q.trend("obs", "ndvi", "monthly"),
    f"SELECT {Q.day('bucket')} AS bucket, {Q.sixes('mean', 'min', 'max')}, count FROM (SELECT * FROM series ORDER BY series.bucket DESC "
    "LIMIT 60) s"))
def _(ws):
    return shown(trends.latest_buckets(trends.trend(ws.obs, "ndvi")))


# --- sets ---------------------------------------------------------------------------------------


@query("u2_distinct_places", with_ctes(
    Q.OBS_RAW, "SELECT DISTINCT latitude, longitude, region, state, region AS city FROM obs_raw"))
def _(ws):
    """Points of a table without any indicator."""
    return points.group_points(obs_raw(ws.spark, ws.sf_dir).select("latitude", "longitude", "region", "state"))


@query("u3_union_of_findings", with_ctes(
    Q.SCORED,
    "SELECT 2 AS ordinal, 'HYDROLOGY & MOISTURE' AS category FROM scored HAVING count(ndwi) > 0 UNION ALL "
    "SELECT 3, 'THERMAL REGIME' FROM scored HAVING count(temperature) > 0 UNION ALL "
    "SELECT 4, 'PRECIPITATION DYNAMICS' FROM scored HAVING count(rainfall) > 0 UNION ALL "
    "SELECT 5, 'ML ANOMALY OUTLIERS' FROM scored HAVING count(*) FILTER (anomaly_flag) > 0 UNION ALL "
    "SELECT 6, 'REGIONAL DISPARITY' FROM scored HAVING count(region) > 0 UNION ALL "
    "SELECT 8, 'RISK STRATIFICATION' FROM scored HAVING count(*) > 0"))
def _(ws):
    """Findings of two sources, the whole table's and the regions', as one list."""
    fields = resolve_fields(ws.scored.columns)
    found = union_findings([region_finding(ws.scored, fields), level_findings(ws.scored, fields)])
    return found.select("ordinal", "category")
