"""Named queries: a Spark function over a workspace, and where one exists the SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.plans.tables import Workspace, workspace


class Query(NamedTuple):
    run: Callable[[Workspace], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[Workspace], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def with_ctes(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


def rounded(df: DataFrame, places: int) -> DataFrame:
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), places) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema.fields
    ])


def six(df: DataFrame) -> DataFrame:
    """All floating-point columns at six places."""
    return rounded(df, 6)


def nine(df: DataFrame) -> DataFrame:
    """All floating-point columns at nine places."""
    return rounded(df, 9)


def day(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def callables() -> dict[str, Callable]:
    def bound(run):
        return lambda spark, sf_dir: run(workspace(spark, sf_dir))

    return {name: bound(q.run) for name, q in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
