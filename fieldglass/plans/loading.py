"""Queries for sources, sinks, schema adaptation and index formulas (S, N, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.functions import scalar
from fieldglass.operators import browse, schema
from fieldglass.operators.distribution import exact_quantiles
from fieldglass.operators.points import in_box
from fieldglass.operators.reports import display_columns, report
from fieldglass.plans import sql as Q
from fieldglass.plans.registry import day, nine, query, six, with_ctes
from fieldglass.plans.tables import climate_feed, climate_raw, obs_raw, table
from fieldglass.runtime import scratch_path, settle
from fieldglass.sources import ledger, readers, totals, writers

# --- sources and sinks --------------------------------------------------------------------------


@query("s1_csv_scan", "SELECT event_id, event_type, value FROM events")
def _(ws):
    path = scratch_path(ws.spark, "events-csv")
    events = table(ws.spark, ws.sf_dir, "events").select(
        F.col("event_id").alias("Event ID"), F.col("event_type").alias("EVENT-TYPE"), F.col("value").alias("Value"))
    events.write.option("header", True).csv(path)
    return readers.read_observations(ws.spark, path, "csv", schema="a bigint, b string, c double")


@query("s1_csv_scan_inferred", "SELECT event_type, count(*) AS rows, round(avg(value), 6) + 0.0 AS value FROM events "
                               "GROUP BY 1")
def _(ws):
    path = scratch_path(ws.spark, "events-csv")
    table(ws.spark, ws.sf_dir, "events").select("event_id", "event_type", "value").write.option("header", True).csv(path)
    read = readers.read_observations(ws.spark, path, "csv")
    return six(read.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("value")))


@query("s2_parquet_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def _(ws):
    return readers.read_observations(ws.spark, f"{ws.sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity")


@query("s3_source_choice", "SELECT 'benchmark.parquet' AS source, count(*) AS rows FROM benchmark")
def _(ws):
    chosen = readers.choose_source(ws.spark, ws.sf_dir)
    rows = readers.read_observations(ws.spark, chosen)
    return rows.agg(F.lit(chosen.rsplit("/", 1)[1]).alias("source"), F.count(F.lit(1)).alias("rows"))


@query("s4_climate_feed", with_ctes(
    Q.CLIMATE_RAW + ", " + Q.STATIONS,
    f"SELECT {Q.day('ts')} AS timestamp, lat AS latitude, lon AS longitude, region, temperature, "
    f"{Q.r6('rainfall')} FROM climate_raw LEFT JOIN station ON region = name"))
def _(ws):
    feed = readers.normalise_climate_feed(climate_feed(ws.spark, ws.sf_dir))
    return six(feed.withColumn("timestamp", day("timestamp")))


@query("s4_climate_feed_files", with_ctes(
    Q.CLIMATE_RAW + ", " + Q.STATIONS,
    "SELECT region, lat AS latitude, lon AS longitude, count(*) AS rows, count(temperature) AS temperatures, "
    f"{Q.r6('sum(temperature)', 'temperature')}, {Q.r6('sum(rainfall)', 'rainfall')} FROM climate_raw LEFT JOIN station ON region = name "
    "WHERE region IS NOT NULL GROUP BY ALL"))
def _(ws):
    """One folder of CSV files per station, as the feed delivers them, with other columns in other files; all are read back."""
    feed = climate_feed(ws.spark, ws.sf_dir).withColumn("station", F.replace("region", F.lit(" "), F.lit("_")))
    path = scratch_path(ws.spark, "feed")
    old = F.col("YEAR") < 2024
    feed.where(old & F.col("region").isNotNull()).drop("region").write.partitionBy("station").option("header", True).csv(f"{path}/a")
    other = feed.where(~old & F.col("region").isNotNull()).select("PRECTOTCORR", "DOY", "T2M", F.lit("x").alias("note"), "YEAR", "station")
    other.write.partitionBy("station").option("header", True).csv(f"{path}/b")
    stations = readers.read_climate_feed(ws.spark, path, name_from=r"station=([^/]+)/", deep=True)
    return six(stations.groupBy("region", "latitude", "longitude").agg(
        F.count(F.lit(1)).alias("rows"), F.count("temperature").alias("temperatures"),
        F.sum("temperature").alias("temperature"), F.sum("rainfall").alias("rainfall")))


@query("s5_fingerprint")
def _(ws):
    return readers.fingerprint(ws.spark, f"{ws.sf_dir}/lineitem.parquet")


@query("s5_ledger",
       "SELECT event_id % 8 AS part, CASE WHEN event_id % 8 = 3 THEN 2 ELSE 1 END AS batch, count(*) AS rows, "
       "round(sum(CASE WHEN event_id % 8 = 3 THEN 2 * value ELSE value END), 6) + 0.0 AS value, 1 AS added, 1 AS removed, "
       "7 AS unchanged, 0 AS read_again FROM events GROUP BY ALL")
def _(ws):
    """Eight files; one is replaced, so its rows alone are read again; a third load of the unchanged folder reads nothing."""
    path, store = scratch_path(ws.spark, "ledger-source"), scratch_path(ws.spark, "ledger-store")
    events = table(ws.spark, ws.sf_dir, "events").select("event_id", "value", (F.col("event_id") % 8).alias("part"))
    folder = lambda rows, k: rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{k}")
    for k in range(8):
        folder(events.where(F.col("part") == k), k)
    ledger.load(ws.spark, path, store, "parquet")
    folder(events.where("part = 3").withColumn("value", 2 * F.col("value")), 3)
    second = ledger.load(ws.spark, path, store, "parquet")
    third = ledger.load(ws.spark, path, store, "parquet")
    rows = ledger.stored_rows(ws.spark, store)
    return six(rows.groupBy("part", "batch").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("value")).select(
        "*", F.lit(second.added).alias("added"), F.lit(second.removed).alias("removed"), F.lit(second.unchanged).alias("unchanged"),
        F.lit(third.version - second.version).alias("read_again")))


KEPT_VALUES = ("ndvi", "evi", "temperature", "rainfall")


def _kept_store(ws):
    """A store of yearly files with its totals: 1998 is added and 1993 replaced, after totals were made of the rest."""
    path, store = scratch_path(ws.spark, "kept-source"), scratch_path(ws.spark, "kept-store")
    rows = obs_raw(ws.spark, ws.sf_dir)
    year = F.coalesce(F.year("timestamp"), F.lit(0))
    rows.where(year != 1998).withColumn("nir", F.when(year == 1993, 1 - F.col("nir")).otherwise(F.col("nir"))).withColumn(
        "year", year).write.partitionBy("year").parquet(path)
    ledger.load(ws.spark, path, store, "parquet", prepare=schema.prepare)
    totals.refresh_totals(ws.spark, store, ["region", "state"], KEPT_VALUES)
    for y in (1993, 1998):
        rows.where(year == y).write.mode("overwrite").parquet(f"{path}/year={y}")
    ledger.load(ws.spark, path, store, "parquet", prepare=schema.prepare)
    return store, totals.refresh_totals(ws.spark, store)


@query("a3_kept_trend", with_ctes(
    Q.OBS + Q.trend("obs", "ndvi", "monthly", by="region"),
    f"SELECT region, {Q.day('bucket')} AS bucket, {Q.sixes('mean', 'min', 'max')}, count, '2' AS batches_read FROM series"))
def _(ws):
    """A trend brought up to date by a load: only the rows of that load were read again."""
    store, done = _kept_store(ws)
    series = totals.kept_trend(ws.spark, store, "ndvi", "monthly", by=["region"])
    return six(series.withColumn("bucket", day("bucket")).withColumn("batches_read", F.lit(",".join(map(str, done.read)))))


@query("a6_kept_profile", with_ctes(
    Q.OBS, f"SELECT region, state, {Q.nines(*KEPT_VALUES)}, observations FROM (SELECT region, state, "
           + ", ".join(f"avg({c}) AS {c}" for c in KEPT_VALUES)
           + ", any_value(n) AS observations FROM (SELECT *, count(*) OVER (PARTITION BY region) AS n FROM obs) s "
             "WHERE region IS NOT NULL AND state IS NOT NULL GROUP BY region, state) g"))
def _(ws):
    return nine(totals.kept_profile(ws.spark, _kept_store(ws)[0]))


@query("s6_materialised_table", with_ctes(
    Q.OBS, f"SELECT year(ts) AS obs_year, month(ts) AS obs_month, count(*) AS rows, {Q.r6('avg(ndvi)', 'ndvi')} FROM obs "
           "GROUP BY ALL"))
def _(ws):
    stored = writers.materialise(ws.obs, scratch_path(ws.spark, "observations"), by_month=True)
    return six(ws.spark.sql("SELECT obs_year, obs_month, count(*) AS rows, avg(ndvi) AS ndvi FROM observations "
                            "GROUP BY obs_year, obs_month") if stored is not None else stored)


@query("s6_layout_by_place", with_ctes(
    Q.OBS, f"SELECT region, count(*) AS rows, {Q.r6('avg(ndvi)', 'ndvi')} FROM obs WHERE latitude BETWEEN 10 AND 15 AND "
           "longitude BETWEEN 72 AND 90 GROUP BY region"))
def _(ws):
    stored = writers.materialise(ws.obs, scratch_path(ws.spark, "places"), view="places", by_place=True, group_bytes=1 << 20)
    return six(in_box(stored, 10, 72, 15, 90).groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.avg("ndvi").alias("ndvi")))


_EXPORT = with_ctes(Q.SCORED, f"SELECT row_id, {Q.sixes('anomaly_score')}, anomaly_flag, severity, "
                              f"{Q.sixes('risk_score', *[p + '_contribution' for p in Q.PARTS])}, risk_level FROM scored")


def _exported(ws, fmt, kind="anomalies"):
    table_ = report(ws.scored, kind)
    path = writers.export(table_, scratch_path(ws.spark, "export"), fmt)
    reader = ws.spark.read.schema(table_.schema)
    return six((reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path))


@query("s7_export_csv", _EXPORT)
def _(ws):
    return _exported(ws, "csv")


@query("s7_export_json", _EXPORT)
def _(ws):
    return _exported(ws, "json")


@query("d7_export_parquet", _EXPORT)
def _(ws):
    return _exported(ws, "parquet")


@query("s7_export_regions", with_ctes(
    Q.SCORED, f"SELECT region, state, {Q.r6('avg(risk_score)', 'risk_score')} FROM scored GROUP BY ALL"))
def _(ws):
    path = writers.export(report(ws.scored, "regions"), scratch_path(ws.spark, "export"), "csv")
    rows = readers.read_observations(ws.spark, path, "csv")
    return six(rows.select("region", "state", F.col("risk_score").cast("double").alias("risk_score")))


@query("s7_export_risk", with_ctes(
    Q.SCORED, f"SELECT row_id, {Q.sixes('risk_score', *[p + '_contribution' for p in Q.PARTS])}, risk_level FROM scored"))
def _(ws):
    return _exported(ws, "json", "risk")


@query("s8_json_rows", with_ctes(
    Q.OBS, "SELECT row_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp, "
           f"{Q.sixes('ndvi', 'evi')}, region FROM obs"))
def _(ws):
    rows = scalar.json_rows(ws.obs.select("row_id", "timestamp", "ndvi", "evi", "region"))
    parsed = F.from_json("json", "row_id string, timestamp string, ndvi double, evi double, region string")
    return rows.select(parsed.alias("r")).select("r.*")


@query("s9_metadata", with_ctes(
    Q.OBS, "SELECT count(*) AS rows, 'row_id,timestamp,latitude,longitude,region,state,red,green,blue,nir,swir,"
           "temperature,rainfall,_timestamp,ndvi,ndwi,ndbi,evi,savi,nbr' AS columns, "
           "'ndvi,ndwi,ndbi,evi,savi,nbr' AS derived, 'region' AS region_field, 18 AS fields FROM obs"))
def _(ws):
    found = browse.metadata(ws.obs)
    return found.select("rows", F.array_join("columns", ",").alias("columns"),
                        F.array_join("derived", ",").alias("derived"), F.col("fields")["region"].alias("region_field"),
                        F.size("fields").alias("fields"))


@query("s9_stored_metadata", with_ctes(
    Q.OBS, "SELECT 'lineitem.parquet' AS dataset, 20 AS fingerprint_length, count(*) AS rows, 18 AS fields, 'ndvi,ndwi,ndbi,evi,savi,nbr' AS derived, "
           "count(temperature) AS temperatures, count(region) AS regions, min(temperature) AS coldest, max(temperature) AS warmest, "
           f"{Q.r6('min(ndvi)', 'least_ndvi')}, {Q.r6('max(ndvi)', 'greatest_ndvi')}, {Q.day('min(ts)')} AS first, {Q.day('max(ts)')} AS last FROM obs"))
def _(ws):
    """What the write gathered, read back without a look at the table."""
    path = scratch_path(ws.spark, "observations")
    writers.materialise(ws.obs, path, view="metadata_source", source=f"{ws.sf_dir}/lineitem.parquet")
    about = writers.stored_metadata(ws.spark, path)
    of = lambda c, k: F.col(c)[k]
    return six(about.select(
        "dataset", F.length("fingerprint").alias("fingerprint_length"), "rows", F.size("fields").alias("fields"),
        F.array_join("derived", ",").alias("derived"), of("non_missing", "temperature").alias("temperatures"), of("non_missing", "region").alias("regions"),
        of("least", "temperature").alias("coldest"), of("greatest", "temperature").alias("warmest"), of("least", "ndvi").alias("least_ndvi"),
        of("greatest", "ndvi").alias("greatest_ndvi"), day("first"), day("last")))


@query("s10_health", "SELECT CASE WHEN count(*) > 0 THEN 'healthy' ELSE 'degraded' END AS status, count(*) > 0 AS "
                     "dataset_available, CAST(NULL AS VARCHAR) AS dataset_error FROM lineitem")
def _(ws):
    return browse.health(ws.obs)


# --- schema adaptation --------------------------------------------------------------------------


@query("n1_clean_name", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS name "
                        "FROM part")
def _(ws):
    return table(ws.spark, ws.sf_dir, "part").select("p_partkey", scalar.clean_text(F.col("p_name")).alias("name"))


@query("n2_first_of_equal_names", "SELECT l_orderkey AS order_key, l_quantity AS b4 FROM lineitem")
def _(ws):
    rows = table(ws.spark, ws.sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    return schema.adapt_names(rows, ["Order Key", "B4", "b4", "order--key!"])


@query("n3_alias_resolution", with_ctes(Q.OBS, f"SELECT row_id, {Q.sixes('ndvi', 'evi')}, temperature FROM obs"))
def _(ws):
    """The same table under other names gives the same indices."""
    raw = obs_raw(ws.spark, ws.sf_dir).withColumnsRenamed({
        "timestamp": "Acquisition Date", "latitude": "lat", "longitude": "lng", "region": "District",
        "state": "Province", "red": "B4", "green": "B3", "blue": "B2", "nir": "B8", "swir": "B11",
        "temperature": "LST", "rainfall": "precip"})
    prepared = schema.prepare(schema.adapt_names(raw))
    return six(prepared.select("row_id", "ndvi", "evi", F.col("lst").alias("temperature")))


@query("n4_numeric_coercion",
       "SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN "
       "CAST(user_id AS VARCHAR) END AS DOUBLE) AS temperature FROM events")
def _(ws):
    e = F.col("event_id") % 3
    text = F.when(e == 0, F.col("event_type")).when(e == 1, F.col("user_id").cast("string"))
    rows = table(ws.spark, ws.sf_dir, "events").select("event_id", F.col("ts"), text.alias("temperature"))
    return rows.select("event_id", scalar.as_number(F.col("temperature")).alias("temperature"))


@query("n5_timestamp_parse",
       "SELECT event_id, strftime(CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('second', ts) END, "
       "'%Y-%m-%d %H:%M:%S') AS moment FROM events")
def _(ws):
    text = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = table(ws.spark, ws.sf_dir, "events").select("event_id", text.alias("date"))
    stamped = schema.with_timestamp(rows, {"timestamp": "date"})
    return stamped.select("event_id", F.date_format("_timestamp", "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("n6_timestamp_search",
       f"SELECT {Q.day('ts')} AS bucket, count(*) AS rows FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def _(ws):
    moment = F.when(F.col("event_id") % 3 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = table(ws.spark, ws.sf_dir, "events").select("event_id", "event_type", moment.alias("seen"))
    stamped = schema.with_timestamp(rows, schema.resolve_fields(rows.columns))
    dated = stamped.where(F.col("_timestamp").isNotNull())
    return dated.groupBy(F.date_format("_timestamp", "yyyy-MM-dd").alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"))


@query("n7_synthetic_timeline",
       f"SELECT event_id, {Q.day('DATE ' + Q.quoted(V.TIMELINE_START) + ' + CAST(row_number() OVER (ORDER BY event_id) - 1 AS INTEGER)')}"
       " AS day FROM events")
def _(ws):
    rows = table(ws.spark, ws.sf_dir, "events").select("event_id", "value")
    stamped = schema.with_timestamp(rows, {}, order_key=["event_id"])
    # Spark puts a plus sign before years of more than four digits
    return stamped.select("event_id", F.ltrim(F.date_format("_timestamp", "yyyy-MM-dd"), F.lit("+")).alias("day"))


@query("n8_coordinate_validation",
       "SELECT c_custkey, CASE WHEN ok THEN lat END AS latitude, CASE WHEN ok THEN lon END AS longitude FROM (SELECT *, "
       "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS ok FROM (SELECT c_custkey, c_acctbal / 50 AS lat, "
       "CAST(c_custkey % 400 - 200 AS DOUBLE) AS lon FROM customer) a) b")
def _(ws):
    rows = table(ws.spark, ws.sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 50).alias("latitude"),
        (F.col("c_custkey") % 400 - 200).cast("double").alias("longitude"))
    return schema.valid_coordinates(rows, "latitude", "longitude")


_STATE = with_ctes(Q.CLIMATE_RAW + ", " + Q.CITY_STATES,
                   "SELECT row_id, region, coalesce(state_name, 'India') AS state FROM climate_raw LEFT JOIN city_state "
                   "ON region = city")


@query("n9_state_lookup", _STATE)
def _(ws):
    return ws.climate.select("row_id", "region", "state")


@query("j1_city_state_join", with_ctes(
    Q.CLIMATE_RAW + ", " + Q.CITY_STATES,
    "SELECT coalesce(state_name, 'India') AS state, count(*) AS rows FROM climate_raw LEFT JOIN city_state ON "
    "region = city GROUP BY 1"))
def _(ws):
    return schema.state_of_city(climate_raw(ws.spark, ws.sf_dir), "region").groupBy("state").agg(
        F.count(F.lit(1)).alias("rows"))


@query("n10_state_pass_through", "SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS state FROM supplier")
def _(ws):
    rows = table(ws.spark, ws.sf_dir, "supplier").join(
        table(ws.spark, ws.sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select("s_suppkey", F.lit("2024-01-01").alias("date"), F.col("s_nationkey").alias("province"),
                       F.lit(0.0).alias("ndvi"))
    return schema.prepare(rows).select("s_suppkey", "state")


@query("n11_numeric_features", with_ctes(
    Q.OBS, " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS non_missing FROM obs" for f in Q.FEATURES)))
def _(ws):
    counts = schema.feature_counts(ws.obs)
    return counts.where(F.col("feature").isin(schema.numeric_features(ws.obs)))


@query("n12_display_columns", with_ctes(
    Q.SCORED, f"SELECT {Q.day('ts')} AS _timestamp, region, state, latitude, longitude, severity, "
              f"{Q.sixes('anomaly_score', 'ndvi', 'ndwi', 'risk_score')}, temperature FROM scored"))
def _(ws):
    return six(ws.scored.select(*display_columns(ws.scored)).withColumn("_timestamp", day("_timestamp")))


# --- scalar expressions -------------------------------------------------------------------------


@query("x1_bounded_divide", "SELECT l_orderkey, l_linenumber, l_partkey, "
                            "round(l_tax / nullif(l_discount, 0), 6) + 0.0 AS ratio FROM lineitem")
def _(ws):
    rows = table(ws.spark, ws.sf_dir, "lineitem")
    return six(rows.select("l_orderkey", "l_linenumber", "l_partkey",
                           scalar.ratio(F.col("l_tax"), F.col("l_discount")).alias("ratio")))


for _number, _index in ((2, "ndvi"), (3, "ndwi"), (4, "ndbi"), (5, "evi"), (6, "savi"), (7, "nbr")):
    @query(f"x{_number}_{_index}", with_ctes(Q.OBS, f"SELECT row_id, {Q.r6(_index)} FROM obs"))
    def _(ws, index=_index):
        raw = obs_raw(ws.spark, ws.sf_dir)
        return six(schema.prepare(raw).select("row_id", index))


@query("x8_given_index_kept", with_ctes(
    Q.OBS, f"SELECT row_id, red AS ndvi, {Q.r6('evi')} FROM obs"))
def _(ws):
    raw = obs_raw(ws.spark, ws.sf_dir).withColumn("ndvi", F.col("red"))
    return six(schema.prepare(raw).select("row_id", "ndvi", "evi"))


for _name, _column in (("x9_season_term", "m"), ("x10_rain_term", "r"), ("x11_heat_term", "h")):
    @query(_name, with_ctes(Q.CLIMATE_RAW + Q.TERMS, f"SELECT row_id, {Q.r6(_column, 'term')} FROM terms"))
    def _(ws, which=_column):
        rows = schema.with_timestamp(climate_raw(ws.spark, ws.sf_dir), {"timestamp": "timestamp"})
        if which == "m":
            term = schema.season(F.col("_timestamp"))
        elif which == "r":
            term = schema.wetness(F.col("rainfall"), schema.rain_quantile(rows, "rainfall"))
        else:
            term = schema.heat(F.col("temperature"))
        return six(rows.select("row_id", term.alias("term")))


@query("x9_season_term_all_year", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
       + Q.r6(Q.clamp("sin((dayofyear(l_shipdate) - 110) * (2 * pi() / 365.25))", -0.4, 1.0), "term")
       + " FROM lineitem")
def _(ws):
    rows = table(ws.spark, ws.sf_dir, "lineitem")
    return six(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                           schema.season(F.col("l_shipdate")).alias("term")))


for _number, _index in ((12, "ndvi"), (13, "ndwi"), (14, "evi"), (15, "savi"), (16, "ndbi"), (17, "nbr")):
    @query(f"x{_number}_proxy_{_index}", with_ctes(Q.CLIMATE, f"SELECT row_id, {Q.r6(_index)} FROM climate"))
    def _(ws, index=_index):
        return six(ws.climate.select("row_id", index))


@query("x8_proxy_replaces_measured", with_ctes(
    Q.CLIMATE, f"SELECT row_id, {Q.sixes('ndvi', 'ndwi')} FROM climate"))
def _(ws):
    """Green and near infrared without red: the measured water index gives way to the stand-in."""
    rows = climate_raw(ws.spark, ws.sf_dir).withColumns({"green": F.lit(0.2), "nir": F.lit(0.4)})
    return six(schema.prepare(rows).select("row_id", "ndvi", "ndwi"))


@query("x8_proxy_keeps_measured", with_ctes(
    Q.CLIMATE, f"SELECT row_id, {Q.sixes('ndvi')}, round((temperature - rainfall) / nullif(temperature + rainfall, 0), 6)"
               " + 0.0 AS ndwi FROM climate"))
def _(ws):
    rows = climate_raw(ws.spark, ws.sf_dir).withColumns({"green": F.col("temperature"), "nir": F.col("rainfall")})
    return six(schema.prepare(rows, keep_measured=True).select("row_id", "ndvi", "ndwi"))


@query("x18_final_clean",
       "SELECT event_id, CASE WHEN event_id % 5 < 3 THEN round(value, 6) + 0.0 END AS ndvi FROM events")
def _(ws):
    kind = F.col("event_id") % 5
    odd = F.when(kind == 3, F.lit(float("nan"))).when(kind == 4, F.lit(float("-inf"))).otherwise(F.col("value"))
    rows = table(ws.spark, ws.sf_dir, "events").select("event_id", F.col("ts").alias("timestamp"), odd.alias("ndvi"))
    return six(schema.prepare(rows).select("event_id", "ndvi"))


@query("x19_severity_bucket",
       f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {Q.severity('l_discount * 10')} AS severity FROM lineitem")
def _(ws):
    rows = table(ws.spark, ws.sf_dir, "lineitem")
    label = scalar.label_right_closed(F.col("l_discount") * 10, V.SEVERITY_EDGES, V.SEVERITY_LABELS)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", label.alias("severity"))


@query("x20_risk_bucket",
       f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {Q.level('l_quantity * 2')} AS risk_level FROM lineitem")
def _(ws):
    rows = table(ws.spark, ws.sf_dir, "lineitem")
    label = scalar.label_right_closed(F.col("l_quantity") * 2, V.RISK_EDGES, V.RISK_LEVELS)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", label.alias("risk_level"))


@query("x21_constant_columns",
       "SELECT event_id, 0.0::DOUBLE AS anomaly_score, false AS anomaly_flag, 'Normal' AS severity FROM events")
def _(ws):
    """Without any indicator every row is normal."""
    from fieldglass.operators.anomaly import with_anomaly

    return with_anomaly(table(ws.spark, ws.sf_dir, "events").select("event_id"), [])


@query("x22_day_of_year_pad",
       "SELECT event_id, strftime(ts, '%Y') || lpad(CAST(dayofyear(ts) AS VARCHAR), 3, '0') AS day_text, "
       f"{Q.day('ts')} AS day FROM events")
def _(ws):
    rows = table(ws.spark, ws.sf_dir, "events")
    year, number = F.year("ts"), F.dayofyear("ts")
    return rows.select(
        "event_id", F.concat(year.cast("string"), F.lpad(number.cast("string"), 3, "0")).alias("day_text"),
        F.date_format(schema.day_of_year_timestamp(year, number), "yyyy-MM-dd").alias("day"))


@query("a14_exact_quantiles", with_ctes(
    Q.OBS, f"SELECT {Q.r6('quantile_cont(rainfall, 0.92)', 'rain_q92')}, {Q.r6('median(ndvi)', 'ndvi_median')}, "
           f"{Q.r6('quantile_cont(savi, 0.25)', 'savi_q25')}, {Q.r6('quantile_cont(savi, 0.75)', 'savi_q75')} FROM obs"))
def _(ws):
    found = exact_quantiles(ws.obs, {"rainfall": (F.col("rainfall"), [0.92]), "ndvi": (F.col("ndvi"), [0.5]),
                                     "savi": (F.col("savi"), [0.25, 0.75])})
    return six(scalar.literal_table(ws.spark, ["rain_q92", "ndvi_median", "savi_q25", "savi_q75"], [
        (found["rainfall"][0], found["ndvi"][0], *found["savi"])]))


@query("u1_union_of_stations", with_ctes(
    Q.CLIMATE_RAW, f"SELECT region, count(*) AS rows, {Q.r6('avg(temperature)', 'temperature')} FROM climate_raw GROUP BY 1"))
def _(ws):
    """One frame for each station's folder, put together again and read as a feed."""
    path = scratch_path(ws.spark, "stations")
    feed = climate_feed(ws.spark, ws.sf_dir)
    feed.withColumn("station", F.coalesce("region", F.lit(""))).write.partitionBy("station").parquet(path)
    names = [r["region"] for r in feed.select("region").distinct().collect()]  # station names, a few dozen
    folder = {name: f"{path}/station={name or '__HIVE_DEFAULT_PARTITION__'}" for name in names}
    frames = {name: ws.spark.read.schema(feed.schema).parquet(folder[name]).drop("region") for name in names}
    union = readers.normalise_climate_feed(readers.union_stations(frames))
    return six(union.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.avg("temperature").alias("temperature")))
