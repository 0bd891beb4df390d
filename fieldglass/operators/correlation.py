"""Pairwise-complete Pearson correlations of all indicators.

Rows are grouped by which indicators they have (one bit each), so that inside
a group every present indicator is complete. One sum per product then serves
all pairs, and a pair adds up the groups that hold both of its members.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.functions.scalar import literal_table, sql_literal
from fieldglass.operators.schema import candidate_features


def correlations(df: DataFrame, features: Sequence[str] | None = None, min_pairs: int = 3,
                 fewer_ok: bool = False) -> DataFrame:
    """``(pair, a, b, correlation, observations)`` for each unordered pair, missing correlations left out.

    ``pair`` numbers the pairs in feature order and settles ties. One eager
    aggregate finds the usable features and their means; values are centred
    on those means before they are multiplied, which keeps the sums accurate.
    With fewer than two usable features there is no pair: an error, or an empty
    table if ``fewer_ok``.
    """
    named = list(features or candidate_features(df))
    numbers = df.select(*[F.col(f).cast("double").alias(f) for f in named])
    at = numbers.agg(*[a for f in named for a in (F.count(f).alias(f"n_{f}"), F.avg(f).alias(f"m_{f}"))]).first()
    used = named if features else [f for f in named if at[f"n_{f}"] >= 2]
    if len(used) < 2:
        if fewer_ok:
            return df.sparkSession.createDataFrame([], "pair int, a string, b string, correlation double, observations bigint")
        raise ValueError("at least two compatible numerical indicators are required")

    # Written as SQL text: a column object per term would cost more than the query.
    bits = " + ".join(f"IF(`{f}` IS NULL, 0, {1 << i})" for i, f in enumerate(used))
    centred = [f"coalesce(`{f}` - {sql_literal(float(at[f'm_{f}'] or 0))}, 0D) AS d{i}" for i, f in enumerate(used)]
    size, pairs = len(used), list(combinations(range(len(used)), 2))
    sums = ["count(1) AS n"]
    for i in range(size):
        sums += [f"sum(d{i}) AS s{i}", f"min(d{i}) AS low{i}", f"max(d{i}) AS high{i}"]
        sums += [f"sum(d{i} * d{j}) AS s{i}_{j}" for j in range(i, size)]
    groups = numbers.selectExpr(f"{bits} AS mask", *centred).groupBy("mask").agg(*map(F.expr, sums))  # one row per set
    rows = ", ".join(
        f"named_struct('pair', {p}, 'a', '{used[i]}', 'b', '{used[j]}', 'both', mask & {1 << i | 1 << j} = "
        f"{1 << i | 1 << j}, 'n', n, 'sa', s{i}, 'sb', s{j}, 'saa', s{i}_{i}, 'sbb', s{j}_{j}, 'sab', s{i}_{j}, "
        f"'la', low{i}, 'ha', high{i}, 'lb', low{j}, 'hb', high{j})" for p, (i, j) in enumerate(pairs))
    both = groups.selectExpr(f"inline(array({rows}))").where("both").groupBy("pair", "a", "b").agg(*map(F.expr, [
        *[f"sum({x}) AS {x}" for x in ("n", "sa", "sb", "saa", "sbb", "sab")],
        "min(la) < max(ha) AS a_varies", "min(lb) < max(hb) AS b_varies"]))
    spread = "greatest(saa - sa * sa / n, 0D) * greatest(sbb - sb * sb / n, 0D)"
    r = f"greatest(least((sab - sa * sb / n) / sqrt({spread}), 1D), -1D)"
    return both.where(f"n >= {min_pairs} AND a_varies AND b_varies AND {spread} > 0").selectExpr(
        "pair", "a", "b", f"{r} AS correlation", "n AS observations")


def strongest(pairs: DataFrame, n: int = V.TOP_PAIRS) -> DataFrame:
    """Pairs by absolute correlation to six places, feature order settling ties."""
    return pairs.orderBy(F.abs(F.round("correlation", 6)).desc(), "pair").limit(n)


def correlation_matrix(pairs: DataFrame, features: Sequence[str]) -> DataFrame:
    """Square form: one row per indicator, one column per indicator (1 on the diagonal where it varies)."""
    cells = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("indicator"), F.col("b").alias("other"), F.col("correlation").alias("r")),
        F.struct(F.col("b").alias("indicator"), F.col("a").alias("other"), F.col("correlation").alias("r")),
        F.struct(F.col("a").alias("indicator"), F.col("a").alias("other"), F.lit(1.0).alias("r")),
        F.struct(F.col("b").alias("indicator"), F.col("b").alias("other"), F.lit(1.0).alias("r")),
    )))
    square = cells.groupBy(F.col("indicator").alias("_i")).pivot("other", list(features)).agg(F.max("r"))
    rows = literal_table(pairs.sparkSession, ["indicator"], [(f,) for f in features])  # a row even without any pair
    return rows.join(F.broadcast(square), F.col("indicator") == F.col("_i"), "left").drop("_i")
