"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

Spark draws each tree's sample and groups it; each tree grows in its own task
from at most 256 rows. The finished trees, a fixed number of small node
tables, are broadcast, and rows are scored where they are, in Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from math import ceil, exp, lgamma, log, log1p, log2

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Functions sent to executors travel with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def unit_hash(*parts: Column) -> Column:
    """Uniform number in [0, 1) decided by the given values alone, whatever the partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * 2.0 ** -53


#: draws made for each row that a tree takes; the least draws of a tree are taken
MARGIN = 1.75


def draw_counts(trees: int, chance: float) -> list[float]:
    """P(at most k of ``trees`` draw a row), k from 0 on, as far as it is below 1: thresholds for a uniform number."""
    out, total = [], 0.0
    for k in range(trees):
        if chance >= 1.0:
            mass = 0.0
        else:
            mass = exp(lgamma(trees + 1) - lgamma(k + 1) - lgamma(trees - k + 1) + k * log(chance) + (trees - k) * log1p(-chance))
        total += mass
        if total >= 1.0 - 2.0 ** -53:
            break
        out.append(total)
    return out


def tree_samples(rows: DataFrame, keys: Sequence[str], n: int, trees: int, psi: int, seed: int) -> DataFrame:
    """Exactly ``psi`` rows for each tree, drawn without replacement by hash of the row key.

    Every tree draws every row with the same chance. One hash of a row says how many trees draw it, by inversion of
    the binomial distribution, and only if some do, further hashes say which; so a table of any size costs one hash a row
    and makes about ``MARGIN * trees * psi`` rows, of which each tree takes those with the least hashes.
    """
    key = [F.col(k) for k in keys]
    uniform = unit_hash(*key, F.lit(seed), F.lit(0))
    thresholds = draw_counts(trees, min(MARGIN * psi / n, 1.0))
    if not thresholds:
        return rows.where(F.lit(False)).withColumn("tree", F.lit(0))
    count = F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("_u") >= t))
    one = F.array(F.pmod(F.xxhash64(*key, F.lit(seed), F.lit(1)), F.lit(trees)).cast("int"))
    mixed = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64(*key, t, F.lit(seed)).alias("h"), t.alias("tree"))))
    which = F.when(F.col("_k") == 1, one).otherwise(F.transform(F.slice(mixed, 1, F.greatest("_k", F.lit(1))), lambda x: x["tree"]))
    drawn = rows.withColumn("_u", uniform).where(F.col("_u") >= thresholds[0]).withColumn("_k", count)
    drawn = drawn.withColumn("tree", F.explode(which)).withColumn("_u", unit_hash(*key, F.col("tree"), F.lit(seed), F.lit(2)))
    order = Window.partitionBy("tree").orderBy("_u", *key)
    return drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= psi).drop("_u", "_k", "_n")


def _grow(features: Sequence[str], psi: int, seed: int):
    depth_limit = ceil(log2(max(psi, 2)))

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        values = sample.sort_values(list(features))[list(features)].to_numpy(dtype="float64")
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = []
        todo = [(np.arange(len(values)), 0, -1, 0)]  # rows, depth, parent, which child slot of the parent
        while todo:
            rows, depth, parent, slot = todo.pop()
            number = len(nodes)
            nodes.append([tree, number, 0, 0.0, number, number, depth + expected_path(len(rows))])
            if parent >= 0:
                nodes[parent][slot] = number
            low, high = values[rows].min(axis=0), values[rows].max(axis=0)
            splittable = np.flatnonzero(high > low)
            if depth >= depth_limit or len(rows) < 2 or not len(splittable):
                continue
            feature = int(rng.choice(splittable))
            threshold = float(rng.uniform(low[feature], high[feature]))
            if threshold >= high[feature]:  # rounding of a very narrow range: keep both sides non-empty
                threshold = float(low[feature])
            goes_left = values[rows, feature] <= threshold
            nodes[number][2:4] = feature, threshold
            todo.append((rows[~goes_left], depth + 1, number, 5))
            todo.append((rows[goes_left], depth + 1, number, 4))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])

    return grow, depth_limit


def fit_forest(rows: DataFrame, features: Sequence[str], keys: Sequence[str], n: int, trees: int, sample: int,
               seed: int) -> tuple[dict, int]:
    """Grow the trees; the result holds at most ``trees * (2 * sample - 1)`` nodes and is kept on the driver."""
    psi = min(sample, n)
    drawn = tree_samples(rows.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]),
                         keys, n, trees, psi, seed).select("tree", *features)
    grow, depth = _grow(features, psi, seed)
    nodes = drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    return pack(nodes, depth), psi


def pack(nodes: pd.DataFrame, depth: int) -> dict[str, np.ndarray]:
    """Trees as full binary trees of ``depth`` levels, a row each: the children of i are 2i + 1 and 2i + 2.

    Below a leaf every row goes left, and the leaf's path length stands at the bottom.
    """
    size = (2 << depth) - 1
    packed = {"feature": np.zeros((nodes["tree"].nunique(), size), np.int64), "threshold": np.full((nodes["tree"].nunique(), size), np.inf),
              "path": np.zeros((nodes["tree"].nunique(), size))}
    for row, (_, tree) in enumerate(nodes.groupby("tree", sort=True)):
        feature, threshold, left, right, length = (tree[c].tolist() for c in ("feature", "threshold", "left", "right", "path"))  # by node
        todo = [(0, 0, 0)]  # node, place, level
        while todo:
            number, place, level = todo.pop()
            if left[number] == number:
                packed["path"][row, ((place + 1) << (depth - level)) - 1] = length[number]
                continue
            packed["feature"][row, place], packed["threshold"][row, place] = feature[number], threshold[number]
            todo += [(left[number], 2 * place + 1, level + 1), (right[number], 2 * place + 2, level + 1)]
    return packed


def mean_paths(values: np.ndarray, forest: dict[str, np.ndarray], rows: int = 4096) -> np.ndarray:
    """Mean path length of each row of ``values`` over all trees; a few thousand rows walk a tree level by level."""
    n, width = values.shape
    depth = (forest["feature"].shape[1] + 1).bit_length() - 2
    out = np.zeros(n)
    for a in range(0, n, rows):
        flat = np.ascontiguousarray(values[a: a + rows], dtype="float64").reshape(-1)
        m = len(flat) // width
        base, at, cell = np.arange(m) * width, np.zeros(m, np.int64), np.empty(m, np.int64)
        value, cut, right = np.empty(m), np.empty(m), np.empty(m, bool)
        for feature, threshold, path in zip(forest["feature"], forest["threshold"], forest["path"]):
            at[:] = 0
            for _ in range(depth):
                np.take(feature, at, out=cell, mode="clip")
                cell += base
                np.take(flat, cell, out=value, mode="clip")
                np.take(threshold, at, out=cut, mode="clip")
                np.greater(value, cut, out=right)
                at += at
                at += 1
                at += right
            out[a: a + m] += path.take(at)
    return out / len(forest["path"])


def forest_score(spark, packed: dict, psi: int, features: Sequence[Column]) -> Column:
    """``2 ** (-mean path / expected path)``: near 1 is isolated early, about 0.5 is ordinary."""
    shared = spark.sparkContext.broadcast(packed)
    usual = expected_path(psi) or 1.0

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        values = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
        return pd.Series(2.0 ** (-mean_paths(values, shared.value) / usual))

    return score(*features)
