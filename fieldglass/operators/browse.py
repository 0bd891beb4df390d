"""Searching, sorting, paging and describing a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass import vocabulary as V
from fieldglass.operators.schema import resolve_fields


#: characters that the text of a value can hold, in lower case; a column whose values cannot spell the term is skipped
_NUMBER_TEXT = set("0123456789.-+einfatyn")
_TIME_TEXT = set("0123456789-:. +")
_FLAG_TEXT = set("truefals")


def can_hold(data_type: T.DataType, term: str) -> bool:
    if isinstance(data_type, T.NumericType):
        return set(term) <= _NUMBER_TEXT
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return set(term) <= _TIME_TEXT
    return not isinstance(data_type, T.BooleanType) or set(term) <= _FLAG_TEXT


def holds(column: str, term: str) -> Column:
    """Whether the text of a column's value holds a term in lower case; a missing value does not."""
    return F.coalesce(F.lower(F.col(f"`{column}`").cast("string")).contains(term), F.lit(False))


def search_rows(df: DataFrame, term: str | None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with the literal text, in any case, in any column (or one of the given ones)."""
    if not term:
        return df
    term = term.lower()
    searched = [c for c in columns or df.columns if can_hold(df.schema[c].dataType, term)]
    if not searched:
        return df.where(F.lit(False))
    return df.where(reduce(or_, [holds(c, term) for c in searched]))


def sort_rows(df: DataFrame, sort: str | None, order: str = "asc", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Ordered by a column with missing values last either way; an unknown column only leaves the tie-break.

    Pages of one table only fit together in a total order, so one of the tie-break columns must be there.
    """
    if not any(c in df.columns for c in tiebreak):
        raise ValueError(f"paging needs a unique key: none of {list(tiebreak)} is a column")
    keys = []
    if sort in df.columns:
        keys.append(F.col(sort).asc_nulls_last() if order == "asc" else F.col(sort).desc_nulls_last())
    keys += [F.col(c) for c in tiebreak if c in df.columns and c != sort]
    return df.orderBy(*keys)


def page_of(df: DataFrame, page: int = 1, page_size: int = V.PAGE_SIZE) -> DataFrame:
    """One page of an ordered table; with the order this plans as a top-k, not a full sort."""
    if page < 1 or not 1 <= page_size <= V.MAX_PAGE_SIZE:
        raise ValueError(f"page must be >= 1 and page_size within 1..{V.MAX_PAGE_SIZE}")
    return df.offset((page - 1) * page_size).limit(page_size) if page > 1 else df.limit(page_size)


def page_after(df: DataFrame, sort: str, last_value, page_size: int = V.PAGE_SIZE, order: str = "asc",
               key: str | None = None, last_key=None) -> DataFrame:
    """The page after a row, by the row's sort value and key: the cost does not grow with the depth of the page.

    Missing values come last in either direction; ``last_value`` None means that the row had none. Without ``key`` the
    sort column itself must be unique and present.
    """
    keys = [F.col(sort).asc_nulls_last() if order == "asc" else F.col(sort).desc_nulls_last()]
    if key is None or key == sort:
        further = F.col(sort) > F.lit(last_value) if order == "asc" else F.col(sort) < F.lit(last_value)
        return page_of(df.where(further).orderBy(*keys), 1, page_size)
    tied = F.col(key) > F.lit(last_key)
    if last_value is None:
        further = F.col(sort).isNull() & tied
    else:
        beyond = F.col(sort) > F.lit(last_value) if order == "asc" else F.col(sort) < F.lit(last_value)
        further = beyond | F.col(sort).isNull() | ((F.col(sort) == F.lit(last_value)) & tied)
    return page_of(df.where(further).orderBy(*keys, key), 1, page_size)


def browse(df: DataFrame, search: str | None = None, sort: str | None = None, order: str = "asc", page: int = 1,
           page_size: int = V.PAGE_SIZE, tiebreak: Sequence[str] = ("row_id",)) -> DataFrame:
    return page_of(sort_rows(search_rows(df, search), sort, order, tiebreak), page, page_size)


def browse_total(df: DataFrame, search: str | None = None) -> DataFrame:
    return search_rows(df, search).agg(F.count(F.lit(1)).alias("total"))


def metadata(df: DataFrame, source: str | None = None) -> DataFrame:
    """One row: row count, column names, resolved fields, derived indices, and the name and fingerprint of the ``source``.

    It counts the rows; of a table that ``materialise`` wrote, ``stored_metadata`` knows all this without reading it.
    """
    from fieldglass.sources.readers import fingerprint

    mark = fingerprint(df.sparkSession, source).first()["fingerprint"] if source else None
    fields = resolve_fields(df.columns)
    pairs = [x for k, v in fields.items() for x in (F.lit(k), F.lit(v))]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("fields"),
        F.array(*[F.lit(i) for i in V.INDEX_NAMES if i in df.columns]).cast("array<string>").alias("derived"),
        F.lit(source.rstrip("/").rsplit("/", 1)[-1] if source else None).cast("string").alias("dataset"),
        F.lit(mark).cast("string").alias("fingerprint"),
    )


def health(df: DataFrame | None, error: str | None = None) -> DataFrame:
    """One row: is there data, and the first load error if not. Reads at most one row."""
    if df is None:
        from pyspark.sql import SparkSession

        found = SparkSession.getActiveSession().sql("SELECT 0 AS n")
    else:
        found = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
    available = F.col("n") > 0
    return found.select(
        F.when(available, "healthy").otherwise("degraded").alias("status"),
        available.alias("dataset_available"),
        F.when(~available, F.lit(error or "no observations")).alias("dataset_error"),
    )
