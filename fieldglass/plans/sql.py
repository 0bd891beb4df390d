"""SQL of the observation tables, for the checks in another engine."""

from __future__ import annotations

from fieldglass import vocabulary as V


def r6(expression: str, name: str | None = None) -> str:
    """Six places, negative zero as zero."""
    return f"round({expression}, 6) + 0.0 AS {name or expression}"


def r9(expression: str, name: str | None = None) -> str:
    """Nine places, for means of values that have few decimals: at six they often fall on exact halves."""
    return f"round({expression}, 9) + 0.0 AS {name or expression}"


def nines(*names: str) -> str:
    return ", ".join(r9(n) for n in names)


def sixes(*names: str) -> str:
    return ", ".join(r6(n) for n in names)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(quoted(v) if isinstance(v, str) else repr(v) for v in row) + ")" for row in rows)


def clamp(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"


def ratio(n: str, d: str) -> str:
    return f"(({n}) / nullif(({d}), 0))"


def label(x: str, edges, labels) -> str:
    arms = " ".join(f"WHEN {x} <= {e} THEN '{lab}'" for e, lab in zip(edges[1:], labels))
    return f"CASE {arms} END"


def severity(x: str) -> str:
    return label(x, V.SEVERITY_EDGES, V.SEVERITY_LABELS)


def level(x: str) -> str:
    return label(x, V.RISK_EDGES, V.RISK_LEVELS)


CITY_STATES = f"city_state AS (SELECT * FROM (VALUES {values(V.CITY_STATE)}) v(city, state_name))"
STATIONS = f"station AS (SELECT * FROM (VALUES {values(V.STATIONS)}) v(name, lat, lon))"
POSITIONS = f"position AS (SELECT * FROM (VALUES {values(V.MAP_POSITIONS)}) v(city_name, map_lat, map_lon))"

OBS_RAW = """obs_raw AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d%H%M%S')) AS row_id,
         l_shipdate AS ts, n_name AS region, r_name AS state,
         CAST(8 + n_nationkey AS DOUBLE) AS latitude, CAST(68 + n_nationkey AS DOUBLE) AS longitude,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS red, l_tax AS green,
         CAST(l_linenumber AS DOUBLE) / 100 AS blue,
         CASE WHEN l_quantity = 1 THEN -l_discount ELSE l_quantity / 100 END AS nir,
         l_extendedprice / 200000 AS swir,
         CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE CAST(10 + l_partkey % 30 AS DOUBLE) END AS temperature,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey % 40 AS DOUBLE) / 4 END AS rainfall
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

OBS = OBS_RAW + f""", obs AS (
  SELECT *, {ratio('nir - red', 'nir + red')} AS ndvi, {ratio('green - nir', 'green + nir')} AS ndwi,
         {ratio('swir - nir', 'swir + nir')} AS ndbi,
         2.5 * {ratio('nir - red', 'nir + 6 * red - 7.5 * blue + 1')} AS evi,
         1.5 * {ratio('nir - red', 'nir + red + 0.5')} AS savi, {ratio('nir - swir', 'nir + swir')} AS nbr
  FROM obs_raw)"""

_SLOTS = [(i, name) for i, (name, _, _) in enumerate(V.STATIONS)] + [(20, "Atlantis")]
CLIMATE_RAW = f"""climate_raw AS (
  SELECT event_id AS row_id, ts, region,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(15 + event_id % 25 AS DOUBLE) END AS temperature,
         CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 10 END AS rainfall
  FROM events LEFT JOIN (VALUES {values(_SLOTS)}) c(slot, region) ON user_id % 22 = slot)"""

TERMS = f""", terms AS (
  SELECT c.*, {clamp("sin((dayofyear(ts) - 110) * (2 * pi() / 365.25))", -0.4, 1.0)} AS m,
         least(greatest(coalesce(rainfall, 0) / (q92 + 0.0001), 0), 1.8) AS r,
         least(greatest(coalesce(temperature, 25) - 27, 0), 20) / 20.0 AS h
  FROM climate_raw c, (SELECT quantile_cont(rainfall, 0.92) AS q92 FROM climate_raw) q)"""

CLIMATE = CLIMATE_RAW + f", {CITY_STATES}" + TERMS + """, vegetated AS (
  SELECT *, round_even(least(greatest(0.28 + 0.36 * coalesce(m, 0.2) + 0.22 * r - 0.14 * h, 0.08), 0.88), 4) AS ndvi
  FROM terms), climate AS (
  SELECT v.*, coalesce(state_name, 'India') AS state,
         round_even(least(greatest(0.16 * r - 0.22 * h + 0.10 * coalesce(m, 0), -0.55), 0.65), 4) AS ndwi,
         round_even(least(greatest(-0.68 * ndvi + 0.12, -0.55), 0.45), 4) AS ndbi,
         round_even(least(greatest(ndvi * 0.84 + 0.04, 0.05), 0.85), 4) AS evi,
         round_even(least(greatest(ndvi * 0.72 + 0.08, 0.06), 0.78), 4) AS savi,
         round_even(least(greatest(0.52 * ndvi - 0.18 * h, -0.4), 0.75), 4) AS nbr
  FROM vegetated v LEFT JOIN city_state ON region = city)"""

FEATURES = ("ndvi", "ndwi", "ndbi", "evi", "savi", "nbr", "temperature", "rainfall")
PARTS = ("vegetation", "water", "temperature", "rainfall", "urban", "anomaly")


def anomalies(t: str) -> str:
    """CTEs ``moments`` and ``flagged``: largest z-score over four."""
    moments = ", ".join(f"avg({f}) AS a_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES)
    z = ", ".join(f"abs({f} - a_{f}) / nullif(s_{f}, 0)" for f in FEATURES)
    return f""", moments AS (SELECT {moments} FROM {t}), measured AS (
  SELECT o.*, least(coalesce(greatest({z}), 0) / 4, 1) AS anomaly_score FROM {t} o, moments), flagged AS (
  SELECT *, anomaly_score >= 0.55 AS anomaly_flag, {severity('anomaly_score')} AS severity FROM measured)"""


def percent_rank(x: str) -> str:
    return (f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (ORDER BY {x} NULLS LAST) + "
            f"(count(*) OVER (PARTITION BY {x}) - 1) / 2.0) / count({x}) OVER () END")


def scored(t: str, source: str = "flagged") -> str:
    """CTE ``scored`` on top of ``flagged``."""
    weights = V.RISK_WEIGHTS
    total = sum(weights.values())
    parts = f"""(1 - ({clamp('ndvi', -1, 1)} + 1) / 2) * 100 AS p_vegetation,
         (1 - ({clamp('ndwi', -1, 1)} + 1) / 2) * 100 AS p_water, {percent_rank('temperature')} * 100 AS p_temperature,
         (1 - {percent_rank('rainfall')}) * 100 AS p_rainfall, (({clamp('ndbi', -1, 1)} + 1) / 2) * 100 AS p_urban,
         coalesce(anomaly_score, 0) * 100 AS p_anomaly"""
    medians = ", ".join(f"median(p_{p}) AS m_{p}" for p in PARTS)
    filled = ", ".join(f"coalesce(p_{p}, m_{p}, 50) * {weights[p]} / {total!r} AS {p}_contribution" for p in PARTS)
    score = " + ".join(f"{p}_contribution" for p in PARTS)
    return f""", parted AS (SELECT *, {parts} FROM {source}), medians AS (SELECT {medians} FROM parted),
  contributed AS (SELECT p.*, {filled} FROM parted p, medians),
  summed AS (SELECT *, least(greatest({score}, 0), 100) AS risk_score FROM contributed),
  scored AS (SELECT *, {level('risk_score')} AS risk_level FROM summed)"""


SCORED = OBS + anomalies("obs") + scored("obs")
CLIMATE_SCORED = CLIMATE + anomalies("climate") + scored("climate")


def bucket(every: str, ts: str = "ts") -> str:
    unit = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}[every]
    start = f"date_trunc('{unit}', {ts})"
    return f"({start} + INTERVAL 6 DAY)" if unit == "week" else start


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def trend(t: str, index: str, every: str, where: str = "true", by: str = "") -> str:
    """CTE ``series``."""
    keys = f"{by}, " if by else ""
    return (f", series AS (SELECT {keys}{bucket(every)} AS bucket, avg({index}) AS mean, min({index}) AS min, "
            f"max({index}) AS max, count({index}) AS count FROM {t} WHERE ts IS NOT NULL AND {index} IS NOT NULL "
            f"AND {where} GROUP BY ALL)")


CHANGE = ("CASE WHEN count(mean) >= 2 AND min_by(mean, bucket) <> 0 "
          "THEN (max_by(mean, bucket) / min_by(mean, bucket) - 1) * 100 END")
