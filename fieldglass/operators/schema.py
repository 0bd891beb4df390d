"""Schema adaptation: column names, field meanings, types, timestamps, coordinates, states, indices."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass import vocabulary as V
from fieldglass.functions.indices import SPECTRAL, heat, proxy_ndvi, proxy_rest, season, wetness
from fieldglass.functions.scalar import as_number, literal_table
from fieldglass.operators.distribution import exact_quantiles, with_row_position

Fields = dict[str, str]


def clean_name(name: str) -> str:
    """Lower case with every run of other characters than ``a-z0-9`` as one underscore."""
    return "_".join(re.findall("[a-z0-9]+", str(name).lower()))


def adapt_names(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Clean the column names and keep the first of those that become equal (by position, so clashes are safe)."""
    cleaned = [clean_name(n) or f"unnamed_{i}" for i, n in enumerate(names or df.columns)]
    keep = [i for i, n in enumerate(cleaned) if n not in cleaned[:i]]
    by_position = df.toDF(*[f"_c{i}" for i in range(len(cleaned))])
    return by_position.select(*[F.col(f"_c{i}").alias(cleaned[i]) for i in keep])


def resolve_fields(columns: Sequence[str]) -> Fields:
    """Meaning -> column name, the first alias present winning."""
    present = set(columns)
    found = {}
    for field, aliases in V.FIELD_ALIASES.items():
        for alias in aliases:
            if alias in present:
                found[field] = alias
                break
    return found


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def parse_timestamp(column: Column, data_type: T.DataType, formats: Sequence[str] = ()) -> Column:
    """Timestamp of a text, date or timestamp column; unparseable text is missing."""
    if not isinstance(data_type, T.StringType):
        return column.cast("timestamp")
    return F.coalesce(F.try_to_timestamp(column), *[F.try_to_timestamp(column, F.lit(f)) for f in formats])


def day_of_year_timestamp(year: Column, day: Column) -> Column:
    """Midnight of a year and a day of the year (zero-padded to three digits)."""
    text = F.concat(year.cast("int").cast("string"), F.lpad(day.cast("int").cast("string"), 3, "0"))
    return F.try_to_timestamp(text, F.lit("yyyyDDD"))


def find_timestamp(df: DataFrame, formats: Sequence[str] = ()) -> str | None:
    """First text, date or timestamp column with at least max(2, 40 %) parseable rows; one aggregate job."""
    candidates = [
        f for f in df.schema.fields
        if not f.name.startswith("_")
        and isinstance(f.dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))
    ]
    if not candidates:
        return None
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(parse_timestamp(F.col(f.name), f.dataType, formats)).alias(f.name) for f in candidates],
    ).first()
    for f in candidates:
        if counts[f.name] >= max(2, counts["_rows"] * 0.4):
            return f.name
    return None


def state_of_city(df: DataFrame, region: str, out: str = "state") -> DataFrame:
    """State of a known city, by a broadcast lookup of 20 rows; other or missing cities get the default."""
    dim = literal_table(df.sparkSession, ["_city", "_state"], V.CITY_STATE)
    joined = df.join(F.broadcast(dim), F.col(region) == F.col("_city"), "left")
    return joined.withColumn(out, F.coalesce("_state", F.lit(V.UNKNOWN_STATE))).drop("_city", "_state")


def valid_coordinates(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    """Both coordinates missing where either is missing or out of range."""
    valid = F.col(latitude).between(-90, 90) & F.col(longitude).between(-180, 180)
    return df.withColumns({latitude: F.when(valid, F.col(latitude)), longitude: F.when(valid, F.col(longitude))})


def with_timestamp(df: DataFrame, fields: Fields, order_key: Sequence[str] | None = None,
                   formats: Sequence[str] = ()) -> DataFrame:
    """Add ``_timestamp``: the named column, else year and day of year, else a found column, else one day per row."""
    named = fields.get("timestamp")
    if named and not is_numeric(df, named):
        parsed = parse_timestamp(F.col(named), df.schema[named].dataType, formats)
        return df.withColumn(named, parsed).withColumn("_timestamp", F.col(named))
    if "year" in df.columns and "doy" in df.columns:
        return df.withColumn("_timestamp", day_of_year_timestamp(F.col("year"), F.col("doy")))
    found = find_timestamp(df, formats)
    if found:
        return df.withColumn("_timestamp", parse_timestamp(F.col(found), df.schema[found].dataType, formats))
    if not order_key:
        raise ValueError("no timestamp found: name order_key columns to lay rows out one day apart")
    days = with_row_position(df, order_key, "_position")
    start = F.lit(V.TIMELINE_START).cast("date")
    # a row beyond the last timestamp has no day
    day = F.when(F.col("_position") < V.TIMELINE_DAYS, F.date_add(start, F.col("_position").try_cast("int")).cast("timestamp"))
    return days.withColumn("_timestamp", day).drop("_position")


def spectral_indices(df: DataFrame, fields: Fields) -> DataFrame:
    """Add each index that the table lacks and whose bands it has."""
    made = {}
    for index, (bands, formula) in SPECTRAL.items():
        if index not in fields and all(b in fields for b in bands):
            made[index] = formula({b: F.col(fields[b]) for b in bands})
    return df.withColumns(made) if made else df


def rain_quantile(df: DataFrame, rainfall: str, q: float = 0.92) -> float | None:
    return exact_quantiles(df, {"rain": (F.col(rainfall), [q])})["rain"][0]


def climate_indices(df: DataFrame, fields: Fields, high_rain: float | None, keep_measured: bool = False) -> DataFrame:
    """Stand-ins for all six indices from season, rain and heat; replaces measured ones unless told to keep them."""
    rain = F.col(fields["rainfall"]) if "rainfall" in fields else F.lit(2.0)
    temperature = F.col(fields["temperature"]) if "temperature" in fields else F.lit(25.0)
    # Each term is a column of its own, so that it is computed once for all six formulas.
    terms = df.withColumns({"_season": season(F.col("_timestamp")), "_wet": wetness(rain, high_rain),
                            "_heat": heat(temperature)})
    m, r, h = F.col("_season"), F.col("_wet"), F.col("_heat")
    rest = proxy_rest(F.col("ndvi"), m, r, h)
    if keep_measured:
        rest = {k: v for k, v in rest.items() if k not in df.columns}
    return terms.withColumn("ndvi", proxy_ndvi(m, r, h)).withColumns(rest).drop("_season", "_wet", "_heat")


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with all of the columns present, as plain conditions that reach the file scan."""
    return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))


def prepare(df: DataFrame, fields: Mapping[str, str] | None = None, order_key: Sequence[str] | None = None,
            keep_measured: bool = False, formats: Sequence[str] = (), high_rain: float | None = None,
            row_key: Sequence[str] = ()) -> DataFrame:
    """The observation table every analysis reads.

    Lazy, except for one aggregate when no timestamp column is named, and the
    rain quantile (``high_rain`` skips it) when vegetation must be estimated
    from climate. A table without ``row_id`` gets one from the columns named by
    ``row_key``, which must be unique together.
    """
    if row_key and "row_id" not in df.columns:
        df = df.withColumn("row_id", F.to_json(F.struct(*row_key)))
    fields = dict(fields or resolve_fields(df.columns))
    numbers = {fields[f]: as_number(F.col(fields[f])) for f in V.NUMERIC_FIELDS if f in fields}
    out = df.withColumns(numbers) if numbers else df
    out = with_timestamp(out, fields, order_key, formats)
    if "latitude" in fields and "longitude" in fields:
        out = valid_coordinates(out, fields["latitude"], fields["longitude"])
    if "state" in fields:
        out = out.withColumn("state", F.col(fields["state"]).cast("string"))
    elif "region" in fields:
        out = state_of_city(out, fields["region"])
    out = spectral_indices(out, fields)
    if "ndvi" not in out.columns:
        if high_rain is None:
            high_rain = rain_quantile(out, fields["rainfall"]) if "rainfall" in fields else 2.0
        out = climate_indices(out, fields, high_rain, keep_measured)
    given = {i: as_number(F.col(i)) for i in V.INDEX_NAMES if i in fields}  # computed ones are finite by construction
    return out.withColumns(given) if given else out


def candidate_features(df: DataFrame, fields: Mapping[str, str] | None = None) -> list[str]:
    """Numeric index and climate columns, in report order (schema only, no job)."""
    fields = fields or resolve_fields(df.columns)
    names = [i for i in V.INDEX_NAMES if i in df.columns]
    names += [fields[f] for f in V.CLIMATE_FIELDS if f in fields and fields[f] not in names]
    return [n for n in names if is_numeric(df, n)]


def feature_counts(df: DataFrame, fields: Mapping[str, str] | None = None) -> DataFrame:
    """``(feature, non_missing)`` of each candidate, one scan."""
    names = candidate_features(df, fields)
    counts = df.agg(*[F.count(n).alias(n) for n in names])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).alias("non_missing")) for n in names])))


def numeric_features(df: DataFrame, fields: Mapping[str, str] | None = None) -> list[str]:
    """Candidates with at least two values (one aggregate job)."""
    names = candidate_features(df, fields)
    if not names:
        return []
    counts = df.agg(*[F.count(n).alias(n) for n in names]).first()
    return [n for n in names if counts[n] >= 2]
