"""Deep pages by number: an index of every n-th row turns any page into a short range of the table.

Sorting and skipping costs more the deeper the page. The index is made once, from the offsets of range partitions, and kept;
a page then reads two of its rows and the rows of the table between them, which a stored table's statistics find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.operators.browse import sort_rows
from fieldglass.operators.distribution import RANGE_ROWS, with_row_position

#: rows between two entries of an index; a page never sorts more than this and one page
STRIDE = 10_000


def page_index(df: DataFrame, sort: str | None = None, order: str = "asc", key: str = "row_id", stride: int = STRIDE,
               range_rows: int = RANGE_ROWS) -> DataFrame:
    """(entry, value, key_value, sort, descending, key, stride): sort value and key of every ``stride``-th row.

    ``key`` is present and unique; it orders rows of equal value, so a value that fills the table is still split. Missing
    values come last either way. An unknown ``sort`` leaves the order by key. An empty table has an empty index. Write the
    result beside the table; it holds for these rows only.
    """
    if stride < V.MAX_PAGE_SIZE:
        raise ValueError(f"stride must be at least {V.MAX_PAGE_SIZE}")
    sort = sort if sort in df.columns else key
    narrow = df.select(F.col(f"`{sort}`").alias("value"), F.col(f"`{key}`").alias("key_value"))
    first = F.col("value").desc_nulls_last() if order == "desc" else F.col("value").asc_nulls_last()
    placed = with_row_position(narrow, [first, F.col("key_value").asc()], range_rows=range_rows)
    return placed.where(F.col("position") % stride == 0).select(
        (F.col("position") / stride).cast("long").alias("entry"), "value", "key_value", F.lit(sort).alias("sort"),
        F.lit(order == "desc").alias("descending"), F.lit(key).alias("key"), F.lit(stride).cast("long").alias("stride"))


def _beyond(value: Column, mark: Row) -> Column:
    return value < F.lit(mark["value"]) if mark["descending"] else value > F.lit(mark["value"])


def _short_of(value: Column, mark: Row) -> Column:
    return value > F.lit(mark["value"]) if mark["descending"] else value < F.lit(mark["value"])


def _from(mark: Row) -> Column:
    """Rows at an entry or after it."""
    value, later = F.col(f"`{mark['sort']}`"), F.col(f"`{mark['key']}`") >= F.lit(mark["key_value"])
    if mark["value"] is None:
        return value.isNull() & later
    return _beyond(value, mark) | value.isNull() | ((value == F.lit(mark["value"])) & later)


def _before(mark: Row) -> Column:
    """Rows before an entry."""
    value, earlier = F.col(f"`{mark['sort']}`"), F.col(f"`{mark['key']}`") < F.lit(mark["key_value"])
    if mark["value"] is None:
        return value.isNotNull() | earlier
    return _short_of(value, mark) | ((value == F.lit(mark["value"])) & earlier)


def page_at(df: DataFrame, index: DataFrame, page: int, page_size: int = V.PAGE_SIZE) -> DataFrame:
    """Page number ``page`` of the table in its index's order; beyond the last page no row.

    Two entries at most come to the driver. They bound the page's rows by plain comparisons, which reach the file scan.
    """
    if page < 1 or not 1 <= page_size <= V.MAX_PAGE_SIZE:
        raise ValueError(f"page must be >= 1 and page_size within 1..{V.MAX_PAGE_SIZE}")
    known = index.select("stride").first()
    if known is None:
        return df.limit(0)
    first, stride = (page - 1) * page_size, known["stride"]
    start, stop = first // stride, (first + page_size - 1) // stride + 1
    marks = {row["entry"]: row for row in index.where(F.col("entry").isin(start, stop)).collect()}
    if start not in marks:
        return df.limit(0)
    rows = df.where(_from(marks[start]))
    if stop in marks:
        rows = rows.where(_before(marks[stop]))
    order = "desc" if marks[start]["descending"] else "asc"
    return sort_rows(rows, marks[start]["sort"], order, (marks[start]["key"],)).offset(first - start * stride).limit(page_size)
