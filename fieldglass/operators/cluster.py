"""Environmental zones: K-means on robustly scaled indicators, the number of zones chosen by silhouette.

Rows are scaled by exact quantiles of all rows and written once. Starts come from all rows (k-means||): a few scans draw
rows with chances in proportion to their squared distance from those drawn so far, a further one counts the rows nearest
to each, and the restarts of every number of clusters compete on these few hundred weighted points. From there every
number of clusters goes on over all rows, in step: a round is one scan in which tasks add up the members of all clusters,
so only sums of a handful of clusters are shuffled. The number of clusters is chosen over all rows by the silhouette of
squared distances, which needs sums per cluster alone. The Euclidean silhouette of the chosen clustering, where every
pair counts, is reported for a sample.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass import vocabulary as V
from fieldglass.functions.scalar import seeded_digest, sql_literal
from fieldglass.operators.anomaly import any_present, eligible_rows, scale_numbers
from fieldglass.operators.distribution import exact_quantiles
from fieldglass.operators.schema import candidate_features, numeric_features, resolve_fields
from fieldglass.runtime import settle

# Functions sent to executors travel with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Centres = list[list[float]]

#: scans that draw starts, and rows that each draws in expectation
START_ROUNDS, START_DRAWS = 4, 64.0
#: points in a packed row: every round reads all of them, and Spark hands bytes to Python at less cost than numbers
PACKED = 64


@dataclass
class Zones:
    """Result of clustering: rows with ``cluster``, one profile row per cluster, and how the number was chosen.

    ``silhouettes`` are means over all rows, of squared distances; ``silhouette`` is the Euclidean mean over a sample.
    """

    assigned: DataFrame
    profiles: DataFrame
    k: int
    silhouette: float
    silhouettes: dict[int, float]
    centres: Centres
    converged: bool


def seeded_sample(rows: DataFrame, cap: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """The first ``cap`` rows (or all) by digest of their key: every task keeps its own first ``cap``."""
    return rows.orderBy(seeded_digest(keys, seed), *keys).limit(cap)


def scaled_columns(scale: Mapping[str, tuple[float, float, float]], names: Sequence[str]) -> dict[str, Column]:
    return {
        x: F.expr(f"(coalesce(CAST(`{f}` AS DOUBLE), {sql_literal(fill)}) - {sql_literal(centre)}) / {sql_literal(width)}")
        for x, (f, (fill, centre, width)) in zip(names, scale.items())
    }


def nearest(names: Sequence[str], centres: Centres) -> Column:
    """Number of the closest centre by Euclidean distance; the lower number wins a tie."""
    if len(centres) < 2:
        return F.lit(0)
    distances = ", ".join(
        "struct(" + " + ".join(f"pow(`{n}` - {sql_literal(float(v))}, 2)" for n, v in zip(names, centre)) + f" AS d, {i} AS i)"
        for i, centre in enumerate(centres))
    return F.expr(f"least({distances}).i")


def lloyd(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, max_iter: int = 100) -> tuple[np.ndarray, float]:
    """Centres and cost of one K-means run on a bounded number of weighted points, started by squared-distance seeding."""
    def pick(mass: np.ndarray) -> int:
        return int(rng.choice(len(points), p=mass / mass.sum())) if mass.sum() > 0 else int(rng.integers(len(points)))

    centres = points[pick(weights)][None, :]
    gap = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        centres = np.vstack([centres, points[pick(gap * weights)]])
        gap = np.minimum(gap, ((points - centres[-1]) ** 2).sum(axis=1))
    for _ in range(max_iter):
        member = np.eye(k)[squared_distances(points, centres).argmin(axis=1)] * weights[:, None]
        size = member.sum(axis=0)
        moved = np.where(size[:, None] > 0, (member.T @ points) / np.maximum(size, 1e-300)[:, None], centres)
        shift = ((moved - centres) ** 2).sum()
        centres = moved
        if shift <= 1e-8:
            break
    return centres, float((squared_distances(points, centres).min(axis=1) * weights).sum())


def uniform(keys: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in [0, 1) decided by row keys and a round."""
    h = keys.astype(np.int64).view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def far_points(matrix: DataFrame, width: int, drawn: np.ndarray, cost: float, turn: int, wanted: float) -> tuple[np.ndarray, float]:
    """(different points drawn, summed squared distance of all rows from ``drawn``), in one scan.

    A row is drawn with the chance ``wanted`` * its squared distance / ``cost``; ``cost`` being that of an earlier round,
    no more than ``wanted`` rows are drawn in expectation.
    """
    schema = "q double, " + ", ".join(f"x{i} double" for i in range(width))

    def draw(batches):
        total, found = 0.0, [np.zeros((0, width))]
        for batch in batches:
            at = 0
            keys = keys_of(batch, width)
            for points in points_of(batch, width):
                gap = squared_distances(points, drawn).min(axis=1)
                total += float(gap.sum())
                found.append(points[uniform(keys[at: at + len(points)], turn) * cost < wanted * gap])
                at += len(points)
        rows = np.unique(np.vstack(found), axis=0)
        out = np.vstack([np.zeros((1, width)), rows])
        q = np.full(len(out), np.nan)
        q[0] = total
        yield pa.RecordBatch.from_arrays([pa.array(q, from_pandas=True), *[pa.array(v) for v in out.T]], names=["q", *[f"x{i}" for i in range(width)]])

    names = [f"x{i}" for i in range(width)]
    rows = matrix.mapInArrow(draw, schema).groupBy(F.col("q").isNotNull().alias("cost"), *[F.when(F.col("q").isNull(), F.col(n)).alias(n) for n in names])
    rows = rows.agg(F.sum("q").alias("q")).orderBy(*names).collect()  # a row for each point drawn, and one for the cost
    points = np.array([[r[n] for n in names] for r in rows if not r["cost"]]).reshape(-1, width)
    return points, next((r["q"] for r in rows if r["cost"]), 0.0)


def weighted_starts(matrix: DataFrame, width: int, first: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray]:
    """(points, weights): k-means|| over all rows, each point with the mean and the number of the rows nearest to it."""
    drawn = first[None, :]
    for turn in range(START_ROUNDS):
        if cost <= 0:
            break
        points, cost = far_points(matrix, width, drawn, cost, turn, START_DRAWS)
        drawn = np.unique(np.vstack([drawn, points]), axis=0)
    sums = cluster_sums(matrix, width, [drawn])[0]
    used = sums[:, 0] > 0
    return sums[used, 2:] / sums[used, :1], sums[used, 0]


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    cross = (left ** 2).sum(axis=1)[:, None] + (right ** 2).sum(axis=1)[None, :] - 2.0 * (left @ right.T)
    return np.maximum(cross, 0.0)


def pack_points(width: int, per: int = PACKED):
    """For ``mapInArrow``: rows of ``width`` numbers and a key to rows of ``per`` points and their keys as bytes."""
    def pack(batches):
        for batch in batches:
            points = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]).astype("float64")
            keys = batch.column(width).to_numpy().astype("int64")
            cuts = range(0, len(points), per)
            yield pa.RecordBatch.from_arrays([pa.array([points[a:a + per].tobytes() for a in cuts], pa.binary()),
                                              pa.array([keys[a:a + per].tobytes() for a in cuts], pa.binary())], names=["points", "keys"])

    return pack


def numbers_of(column: pa.Array, dtype: str) -> np.ndarray:
    """The numbers of packed rows, one row after the other, as they lie in the column's buffer."""
    size = np.dtype(dtype).itemsize
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, dtype)
    ends = np.frombuffer(column.buffers()[1], "int64" if pa.types.is_large_binary(column.type) else "int32")
    first, last = int(ends[column.offset]), int(ends[column.offset + len(column)])
    return np.frombuffer(column.buffers()[2], dtype, (last - first) // size, first)


def is_packed(batch: pa.RecordBatch) -> bool:
    kind = batch.schema.field(0).type
    return pa.types.is_binary(kind) or pa.types.is_large_binary(kind)


def keys_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return numbers_of(batch.column(1), "int64") if is_packed(batch) else batch.column(width).to_numpy()


def points_of(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """Rows of points, some thousand at a time: packed ones (``pack_points``), or the first ``width`` columns."""
    if is_packed(batch):
        columns = numbers_of(batch.column(0), "float64").reshape(-1, width)
    else:
        columns = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
    for at in range(0, len(columns), 4096):
        yield columns[at:at + 4096]


def cluster_sums(matrix: DataFrame, width: int, models: Sequence[np.ndarray]) -> list[np.ndarray]:
    """For each model one row per cluster: members, sum of their squared lengths, and sum of their points; one scan."""
    every = np.vstack(models)
    edges = np.cumsum([0, *[len(m) for m in models]])
    schema = "c int, n double, q double, " + ", ".join(f"x{i} double" for i in range(width))

    def add(batches):
        total = np.zeros((len(every), width + 2))
        for batch in batches:
            for points in points_of(batch, width):
                near = (every ** 2).sum(axis=1)[None, :] - 2.0 * (points @ every.T)
                member, at = np.zeros(near.shape), np.arange(len(points))
                for a, b in zip(edges, edges[1:]):
                    member[at, a + near[:, a:b].argmin(axis=1)] = 1.0
                total += member.T @ np.column_stack([np.ones(len(points)), (points ** 2).sum(axis=1), points])
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(v) for v in total[used].T]],
                                         names=["c", "n", "q", *[f"x{i}" for i in range(width)]])

    out = np.zeros((len(every), width + 2))
    names = ["n", "q", *[f"x{i}" for i in range(width)]]
    for row in matrix.mapInArrow(add, schema).groupBy("c").agg(*[F.sum(n).alias(n) for n in names]).collect():  # a row per cluster
        out[row["c"]] = [row[n] for n in names]
    return [out[a:b] for a, b in zip(edges, edges[1:])]


def refine(matrix: DataFrame, width: int, models: Mapping[int, np.ndarray], max_iter: int,
           least_move: float) -> tuple[dict[int, np.ndarray], set[int]]:
    """Lloyd rounds of all models in step over all rows, each until its centres' squared moves sum to ``least_move`` at most.

    Returns the centres and the models that came to rest within ``max_iter`` rounds. Empty clusters stay put.
    """
    models, active = dict(models), list(models)
    for _ in range(max_iter):
        found = dict(zip(active, cluster_sums(matrix, width, [models[k] for k in active])))
        for k, sums in found.items():
            n, before = sums[:, :1], models[k]
            models[k] = np.where(n > 0, sums[:, 2:] / np.maximum(n, 1.0), before)
            if ((models[k] - before) ** 2).sum() <= least_move:
                active.remove(k)
        if not active:
            break
    return models, set(models) - set(active)


def squared_silhouettes(matrix: DataFrame, width: int, models: Mapping[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette of squared Euclidean distances over all rows: two scans, by sums of each cluster.

    The mean squared distance of a point to a cluster follows from the cluster's size, summed squares and summed points.
    A row alone in its cluster counts 0; a clustering with fewer than two clusters in use has -1.
    """
    sums = dict(zip(models, cluster_sums(matrix, width, list(models.values()))))

    def add(batches):
        total, n = dict.fromkeys(models, 0.0), 0
        for batch in batches:
            for points in points_of(batch, width):
                n += len(points)
                at = np.arange(len(points))
                for k, centres in models.items():
                    size, squares, summed = sums[k][:, 0], sums[k][:, 1], sums[k][:, 2:]
                    used = np.maximum(size, 1.0)
                    mine = ((centres ** 2).sum(axis=1)[None, :] - 2.0 * (points @ centres.T)).argmin(axis=1)
                    gap = (points ** 2).sum(axis=1)[:, None] + (squares / used)[None, :] - 2.0 * (points @ (summed / used[:, None]).T)
                    gap = np.where(size > 0, np.maximum(gap, 0.0), np.inf)
                    inside = gap[at, mine] * size[mine] / np.maximum(size[mine] - 1.0, 1.0)
                    gap[at, mine] = np.inf
                    outside = gap.min(axis=1)
                    larger = np.maximum(inside, outside)
                    fair = (size[mine] > 1) & np.isfinite(outside) & (larger > 0)
                    total[k] += float(np.where(fair, (outside - inside) / np.where(fair, larger, 1.0), 0.0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values())),
                                          pa.array([float(n)] * len(total))], names=["k", "s", "n"])

    means = matrix.mapInArrow(add, "k int, s double, n double").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("mean")).collect()
    return {row["k"]: row["mean"] if (sums[row["k"]][:, 0] > 0).sum() > 1 else -1.0 for row in means}


def best_of_restarts(points: np.ndarray, weights: np.ndarray, ks: Sequence[int], restarts: int, seed: int) -> dict[int, np.ndarray]:
    """For each k the centres with the least cost among seeded restarts over weighted points, some hundreds at most."""
    runs = {k: [lloyd(points, weights, k, np.random.default_rng([seed, k, run])) for run in range(restarts)] for k in ks}
    return {k: min(found, key=lambda r: r[1])[0] for k, found in runs.items()}


def mean_silhouettes(spark: SparkSession, shared, size: int, models: Mapping[int, Centres]) -> dict[int, float]:
    """Mean Euclidean silhouette of each clustering of a bounded sample; -1 where the whole sample lies in one cluster.

    The sample (at most a few hundred kilobytes) is broadcast; each row sums
    its distances to every cluster in its own task, so no pair is ever emitted.
    """
    schema = ", ".join(f"s{k} double, c{k} int" for k in models)

    def score(batches):
        points = shared.value
        assigned = {k: squared_distances(points, np.asarray(c)).argmin(axis=1) for k, c in models.items()}
        members = {k: np.eye(len(models[k]))[label] for k, label in assigned.items()}
        for batch in batches:
            for start in range(0, len(batch), 512):
                rows = batch["id"].to_numpy()[start:start + 512]
                distance = np.sqrt(squared_distances(points[rows], points))
                at, out = np.arange(len(rows)), {}
                distance[at, rows] = 0.0
                for k, member in members.items():
                    mine, count = assigned[k][rows], member.sum(axis=0)
                    total = distance @ member
                    inside = total[at, mine] / np.maximum(count[mine] - 1, 1)
                    other = np.where(count > 0, total / np.maximum(count, 1), np.inf)
                    other[at, mine] = np.inf
                    outside = other.min(axis=1)
                    width = np.maximum(inside, outside)
                    fair = (count[mine] > 1) & np.isfinite(outside) & (width > 0)
                    out[f"s{k}"] = np.where(fair, (outside - inside) / np.where(fair, width, 1.0), 0.0)
                    out[f"c{k}"] = mine
                yield pd.DataFrame(out)

    rows = spark.range(0, size, 1, max(1, min(size // 256, 64))).mapInPandas(score, schema)
    means = rows.agg(*[F.avg(f"s{k}").alias(f"s{k}") for k in models],
                     *[F.countDistinct(f"c{k}").alias(f"c{k}") for k in models]).first()
    return {k: means[f"s{k}"] if means[f"c{k}"] > 1 else -1.0 for k in models}


def describe(profiles: DataFrame, table: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Add a description of each cluster by comparing its means with the table's medians."""
    wording = {fields.get(c, c): w for c, w in V.CLUSTER_WORDING.items()}
    used = {c: w for c, w in wording.items() if c in profiles.columns}
    if not used:
        return profiles.withColumn("description", F.lit(V.CLUSTER_TEXT))
    medians = exact_quantiles(table, {c: (F.col(c), [0.5]) for c in used})
    texts = [F.when(F.col(c) >= F.lit(medians[c][0]), above).otherwise(below) for c, (above, below) in used.items()]
    return profiles.withColumn("description", F.concat_ws(", ", *texts))


def preconditions(df: DataFrame) -> DataFrame:
    """One row: usable features, rows, and rows with at least one feature."""
    features = numeric_features(df)
    return df.agg(F.lit(len(features)).alias("features"), F.count(F.lit(1)).alias("rows"),
                  F.count_if(any_present(features)).alias("usable"))


def clusters(df: DataFrame, features: Sequence[str] | None = None, k: int | None = None, seed: int = V.SEED,
             restarts: int = V.CLUSTER_RESTARTS, sample_cap: int = V.CLUSTER_SAMPLE, max_iter: int = 100,
             tolerance: float = 1e-4, row_key: Sequence[str] = ("row_id",)) -> Zones:
    """Cluster the rows with at least one feature; ``k`` fixes the number of clusters, else 2..6 are compared.

    All rows decide on scales, starts, centres and the number of clusters. Rounds end when the centres' squared moves sum to
    ``tolerance`` times the columns' mean variance at most. ``sample_cap`` bounds the sample of the reported Euclidean silhouette.
    """
    fields = resolve_fields(df.columns)
    named = list(candidate_features(df, fields) if features is None else features)
    counts = df.agg(F.count_if(any_present(named)).alias("_n"), *[F.count(f).alias(f) for f in named]).first()
    features = [f for f in named if features is not None or counts[f] >= 2]
    if len(features) < 2:
        raise ValueError("clustering needs at least two compatible numerical indicators")
    rows = eligible_rows(df, features)
    keys = [c for c in row_key if c in df.columns]
    if not keys:
        raise ValueError(f"clustering needs a unique key: none of {list(row_key)} is a column")
    n = counts["_n"] if features == named else rows.count()
    if n < V.CLUSTER_MIN_ROWS:
        raise ValueError(f"clustering needs at least {V.CLUSTER_MIN_ROWS} rows with an indicator")

    scale = scale_numbers(rows, features, [f for f in features if counts[f] < n])
    names = [f"_x{i}" for i in range(len(features))]
    drawn = seeded_sample(rows.select(*dict.fromkeys([*keys, *features])), sample_cap, seed, keys)
    sample = drawn.toPandas()[features].astype("float64")  # at most sample_cap rows
    points = np.column_stack([(sample[f].fillna(fill) - centre) / width for f, (fill, centre, width) in scale.items()])
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(points)
    tried = [k] if k else list(range(2, min(V.CLUSTER_MAX_K, n - 1) + 1))

    scaled = rows.select(*[c.alias(x) for x, c in scaled_columns(scale, names).items()], F.xxhash64(F.lit(seed), *keys).alias("_h"))
    matrix = settle(scaled.mapInArrow(pack_points(len(names)), "points binary, keys binary"), "matrix")
    spread = scaled.agg(*[F.var_pop(x).alias(f"v{x}") for x in names], *[F.avg(x).alias(f"m{x}") for x in names], F.min_by(F.array(*names), "_h").alias("first")).first()
    first = np.array(spread["first"])
    variances, means = (np.array([spread[f"{p}{x}"] for x in names]) for p in "vm")
    starts = weighted_starts(matrix, len(names), first, n * float((variances + (means - first) ** 2).sum()))
    models, rested = refine(matrix, len(names), best_of_restarts(*starts, tried, restarts, seed), max_iter, tolerance * float(variances.mean()))
    scores = squared_silhouettes(matrix, len(names), models)
    chosen = max(tried, key=lambda c: (scores[c], -c))
    centres, converged = models[chosen].tolist(), chosen in rested
    silhouette = mean_silhouettes(spark, shared, len(points), {chosen: centres})[chosen]
    centres = sorted(centres)
    assigned = rows.withColumns(scaled_columns(scale, names)).withColumn("cluster", nearest(names, centres)).drop(*names)
    profiles = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(f).alias(f) for f in features])
    return Zones(assigned, describe(profiles, df, fields), chosen, silhouette, scores, centres, converged)
