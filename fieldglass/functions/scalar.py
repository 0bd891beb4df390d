"""Null-safe scalar expressions.

Missing values are NULL everywhere in this library. NaN and infinities are
turned into NULL where data enters and after each division, because Spark
orders NaN above every number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")


def finite(value: Column) -> Column:
    """The value, or NULL when it is NaN or infinite (NaN sorts above infinity, so one test covers both)."""
    return F.when(F.abs(value) < F.lit(INFINITY), value)


def seeded_digest(keys: Sequence[str], seed: int) -> Column:
    """MD5 of the key columns' texts and the seed, joined by ``|``: an order that any engine can repeat."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """``scale * numerator / denominator``; NULL for a zero denominator or an overflowing result."""
    quotient = F.try_divide(numerator, denominator)
    return finite(quotient if scale == 1.0 else F.lit(scale) * quotient)


def clamp(value: Column, low: float, high: float) -> Column:
    """Limit to ``[low, high]``; a missing value stays missing (``least``/``greatest`` skip NULL)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def label_right_closed(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edges[i], edges[i+1]]`` holding the value; NULL outside all of them."""
    chain = F.when(value <= F.lit(float(edges[0])), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        chain = chain.when(value <= F.lit(float(upper)), F.lit(label))
    return chain


def _every_second_bit(value: Column) -> Column:
    """The 16 bits of a whole number, a zero before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return value


def place_code(latitude: Column, longitude: Column) -> Column:
    """Place on a Z-order curve over 65,536 x 65,536 cells: neighbours on it are neighbours on the map; NULL without a position."""
    def cell(degrees: Column, span: float) -> Column:
        return clamp(F.floor((degrees + span / 2) / span * 65536.0), 0, 65535).cast("long")

    rows, columns = _every_second_bit(cell(latitude, 180.0)), _every_second_bit(cell(longitude, 360.0))
    return F.shiftleft(rows, 1).bitwiseOR(columns)


def sql_literal(value) -> str:
    """A Python text, number, flag or None as a Spark SQL literal (doubles keep every digit)."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, bool):
        return str(value).lower()
    return f"({value!r}D)" if isinstance(value, float) else str(value)


def fixed_text(value: str, places: int) -> str:
    """SQL for the text of a column with 1 to 3 decimals, rounding the binary value itself (exact halves to even).

    ``format_string`` rounds the shortest decimal text half up, which differs
    for values such as 2.25 or 38.55. Here twice the scaled value, kept as a
    sum and what that sum lost, is compared with the odd number next to it.
    The scale is summed from powers of two, so each term is exact.
    """
    powers = {1: (16, 4), 2: (256, -64, 8), 3: (2048, -32, -16)}[places]  # they sum to 2 * 10 ** places
    steps = [f"named_struct('t', x * {powers[0]}D, 'lost', 0D)"]
    for power in powers[1:]:
        steps.append(
            f"transform(array({steps[-1]}), s -> named_struct('t', s.t + x * {power}D, 'lost', s.lost + "
            f"(s.t - ((s.t + x * {power}D) - ((s.t + x * {power}D) - s.t))) + "
            f"(x * {power}D - ((s.t + x * {power}D) - s.t))))[0]")
    steps.append(f"transform(array({steps[-1]}), s -> named_struct('t', s.t, 'k', CAST(floor(s.t / 2) AS DOUBLE), "
                 "'gap', (s.t - (2 * CAST(floor(s.t / 2) AS DOUBLE) + 1)) + s.lost))[0]")
    digits = "CASE WHEN p.gap < 0 THEN p.k WHEN p.gap > 0 THEN p.k + 1 ELSE p.k + abs(p.k % 2) END"
    return (f"transform(array({value}), x -> format_string('%.{places}f', transform(array({steps[-1]}), p -> "
            f"IF(abs(p.t) < 1e15D, IF(x < 0, -abs({digits}), {digits}) / {10 ** places}D, x))[0]))[0]")


def as_number(column: Column) -> Column:
    """Double value of anything; unparseable text, NaN and infinities become NULL."""
    return finite(column.try_cast("double"))


def clean_text(column: Column) -> Column:
    """Lower case, runs of other characters than ``a-z0-9`` to one ``_``, no ``_`` at the ends."""
    return F.btrim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "_"), F.lit("_"))


def iso_utc(column: Column) -> Column:
    """ISO 8601 text of a timestamp with its UTC offset; microseconds only where there are any."""
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fraction = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.date_format(column, "SSSSSS") == "000000", whole).otherwise(fraction)


def json_safe(df: DataFrame) -> DataFrame:
    """Floats rounded to 6 places (non-finite to NULL) and timestamps as ISO 8601 text."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(finite(column.cast("double")), 6)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = iso_utc(column)
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        out.append(column.alias(field.name))
    return df.select(*out)


def json_rows(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON object per row, missing values written as ``null``."""
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias(out))


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A small constant table that lives in the plan (no parallelised Python rows)."""
    body = ", ".join("(" + ", ".join(map(sql_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")
