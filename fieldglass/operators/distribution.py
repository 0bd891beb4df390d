"""Exact order statistics without a global sort: value tables, ranks, positions, quantiles.

All of it rests on one idea. ``groupBy(value).count()`` combines on the map
side, so a value holding a third of all rows costs one row per task. What is
left, one row per distinct value, is ordered by range partitions whose totals
give each partition its starting offset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.scalar import sql_literal
from fieldglass.runtime import settle

#: rows per range partition of a value table, and the most partitions made
RANGE_ROWS = 250_000
MAX_RANGES = 20_000
#: a value holding more than 1/HOT_SHARE of the rows is hot; there are at most HOT_SHARE of them
HOT_SHARE = 10_000
#: salts that spread rows which must not meet in a shuffled lookup
SALTS = 4096
#: sketches are merged in this many groups instead of in one task
SKETCH_SHARDS = 64
SKETCH_ACCURACY = 1000


def value_table(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``(feature, value, ties)``: one row per distinct non-missing value of each column, in one scan."""
    cells = [F.struct(F.lit(name).alias("feature"), c.cast("double").alias("value")) for name, c in columns.items()]
    return (
        df.select(F.inline(F.array(*cells)))
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("ties"))
    )


def running_before(df: DataFrame, group: str | None, order: Sequence[str | Column], weight: Column, rows: int,
                   range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``before``: the weight of all rows ahead of this one in ``order``, within ``group`` if given.

    ``rows`` is the known row count of ``df``, which is range partitioned and
    settled; that pins each row to its partition number. The partition totals,
    one row each, then give every partition its offset.
    """
    weighted = df.withColumn("_w", weight.cast("long"))
    full_order = [group, *order] if group else list(order)
    ranged = settle(
        weighted.repartitionByRange(min(MAX_RANGES, max(1, ceil(rows / range_rows))), *full_order)
        .withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    totals = ranged.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    # one row per range partition: at most MAX_RANGES of them
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*full_order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("_ahead", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn("before", F.col("_offset") + F.col("_ahead"))
    )
    if group:  # few groups: what lies ahead of each one
        sizes = ranged.groupBy(group).agg(F.sum("_w").alias("_sum"))
        starts = sizes.select(group, F.coalesce(F.sum("_sum").over(
            Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
        placed = placed.join(F.broadcast(starts), group).withColumn("before", F.col("before") - F.col("_start"))
    return placed.drop("_w", "_part", "_offset", "_ahead", "_start")


def with_row_position(df: DataFrame, order: Sequence[str | Column], out: str = "position", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Zero-based position of each row in a declared unique order (counts the rows first)."""
    rows = df.count()
    return running_before(df, None, order, F.lit(1), rows, range_rows).withColumnRenamed("before", out)


class RankTable:
    """Average percent ranks of several columns, computed once and then attached or queried.

    ``counts`` and ``distinct`` hold the non-missing rows and distinct values of
    each column, ``medians`` the median over the rows of its percent rank.
    """

    def __init__(self, df: DataFrame, columns: Mapping[str, Column], range_rows: int = RANGE_ROWS) -> None:
        self.range_rows = range_rows
        values = settle(value_table(df, columns), "values")
        rows = values.count()
        totals = values.groupBy("feature").agg(F.sum("ties").alias("n"), F.count(F.lit(1)).alias("d"))
        ordered = running_before(values, "feature", ["value"], F.col("ties"), rows, range_rows)
        self.table = settle(ordered.join(F.broadcast(totals), "feature").withColumn(
            "pct", F.expr("(before + (ties + 1) / 2) / n")), "ranks")
        self.counts = dict.fromkeys(columns, 0)
        self.distinct = dict.fromkeys(columns, 0)
        self.medians: dict[str, float | None] = dict.fromkeys(columns)
        middle = self.table.where(
            "(before <= (n - 1) div 2 AND before + ties > (n - 1) div 2) OR (before <= n div 2 AND before + ties > n div 2)")
        middles: dict[str, list[float]] = {}
        for row in middle.orderBy("feature", "value").collect():  # one or two rows per column
            self.counts[row["feature"]], self.distinct[row["feature"]] = row["n"], row["d"]
            middles.setdefault(row["feature"], []).append(row["pct"])
        for feature, found in middles.items():
            self.medians[feature] = (found[0] + found[-1]) / 2

    def attach(self, df: DataFrame, feature: str, column: Column, out: str,
               row_key: Sequence[str] = ("row_id",)) -> DataFrame:
        """Left join of the feature's percent rank onto the rows as column ``out``.

        Up to ``range_rows`` distinct values are broadcast; with more, the hot ones are and the cold ones are joined.
        ``row_key`` only spreads rows evenly in a shuffled lookup; all columns serve if it is absent.
        """
        lookup = self.table.where(F.col("feature") == feature).select(
            F.col("value").alias("_value"), F.col("ties").alias("_ties"), F.col("pct").alias(out)
        )
        keyed = df.withColumn("_key", column.cast("double"))
        if self.distinct[feature] <= self.range_rows:  # no more values than one range partition holds: the rows stay where they are
            few = F.broadcast(lookup.drop("_ties"))
            return keyed.join(few, F.col("_key") == F.col("_value"), "left").drop("_key", "_value")
        # Hot values: at most HOT_SHARE rows by arithmetic, so they are broadcast. The cold values are
        # joined as their size asks for; rows already answered (or missing) take a salt that matches nothing.
        limit = self.counts[feature] / HOT_SHARE
        spread_by = [c for c in row_key if c in df.columns] or df.columns
        hot = lookup.where(F.col("_ties") > limit).select(F.col("_value").alias("_hot"), F.col(out).alias("_hot_pct"))
        cold = lookup.where(F.col("_ties") <= limit).drop("_ties").withColumn("_lane", F.lit(0))
        first = keyed.join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
        settled_here = F.col("_hot_pct").isNotNull() | F.col("_key").isNull()
        salt = 1 + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread_by]), F.lit(SALTS))
        first = first.withColumn("_row_lane", F.when(settled_here, salt).otherwise(F.lit(0)).cast("int"))
        first = first.withColumn("_cold_key", F.coalesce("_key", F.lit(0.0)))
        joined = first.join(
            cold, (F.col("_cold_key") == F.col("_value")) & (F.col("_row_lane") == F.col("_lane")), "left"
        )
        return joined.withColumn(out, F.coalesce(F.col("_hot_pct"), F.col(out))).drop(
            "_key", "_hot", "_hot_pct", "_row_lane", "_cold_key", "_value", "_lane"
        )


def with_percent_rank(df: DataFrame, columns: Mapping[str, str], **limits) -> DataFrame:
    """Add, for each ``column -> out``, the average-tie rank divided by the non-missing count."""
    ranks = RankTable(df, {c: F.col(c) for c in columns}, **limits)
    for column, out in columns.items():
        df = ranks.attach(df, column, F.col(column), out)
    return df


def exact_quantiles(df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[float]]],
                    range_rows: int = RANGE_ROWS) -> dict[str, list[float | None]]:
    """Interpolated quantiles of several columns, exact at any size, in two scans.

    Scan one sketches each column in ``SKETCH_SHARDS`` groups; whatever the
    split, the true quantile lies between the smallest and the largest group
    answer. Scan two shuffles only the values inside those brackets, already
    counted per distinct value, plus one count of everything below. The counts
    prove the bracket holds the wanted ranks; if one does not, it is widened to
    the column's whole range, so the answer never rests on the sketch.
    """
    plain = df.select(*[c.cast("double").alias(f"q{i}") for i, (c, _) in enumerate(wanted.values())])
    column = {name: f"q{i}" for i, name in enumerate(wanted)}
    margin = 4.0 / SKETCH_ACCURACY
    sketches = []
    for name, (_, qs) in wanted.items():
        ends = ", ".join(f"{p}D" for q in qs for p in (max(q - margin, 0.0), min(q + margin, 1.0)))
        c = column[name]
        sketches += [f"count({c}) AS {c}_n", f"min({c}) AS {c}_min", f"max({c}) AS {c}_max",
                     f"percentile_approx({c}, array({ends}), {SKETCH_ACCURACY}) AS {c}_ends"]
    sharded = plain.withColumn("_shard", F.spark_partition_id() % SKETCH_SHARDS)
    shards = sharded.groupBy("_shard").agg(*map(F.expr, sketches)).collect()  # at most SKETCH_SHARDS rows

    answers: dict[str, list[float | None]] = {name: [None] * len(qs) for name, (_, qs) in wanted.items()}
    brackets, whole, counts = {}, {}, {}
    for name, (_, qs) in wanted.items():
        c = column[name]
        seen = [row for row in shards if row[f"{c}_n"]]
        counts[name] = sum(row[f"{c}_n"] for row in seen)
        for i in range(len(qs)) if seen else ():
            whole[name, i] = (c, min(row[f"{c}_min"] for row in seen), max(row[f"{c}_max"] for row in seen))
            brackets[name, i] = (c, min(row[f"{c}_ends"][2 * i] for row in seen),
                                 max(row[f"{c}_ends"][2 * i + 1] for row in seen))
    while brackets:
        ranks = {}
        for name, i in brackets:
            position = (counts[name] - 1) * wanted[name][1][i]
            ranks[name, i] = (floor(position), min(floor(position) + 1, counts[name] - 1), position - floor(position))
        found = _locate(plain, brackets, {slot: r[:2] for slot, r in ranks.items()},
                        range_rows)
        retry = {}
        for slot, (lower, upper, share) in ranks.items():
            low, high = found.get((slot, lower)), found.get((slot, upper))
            if low is None or high is None:
                retry[slot] = whole[slot]
            else:
                answers[slot[0]][slot[1]] = low + (high - low) * share
        brackets = retry
    return answers


def _locate(plain: DataFrame, brackets: Mapping[tuple, tuple[str, float, float]], ranks: Mapping[tuple, tuple[int, int]],
            range_rows: int) -> dict[tuple, float]:
    """``(slot, rank) -> value`` for the slots whose bracket holds their ranks."""
    spans: dict[tuple[str, float, float], list] = {}
    for slot, bracket in brackets.items():
        spans.setdefault(bracket, []).append(slot)
    cells = ", ".join(
        f"struct({number} AS span, {c} <= {sql_literal(high)} AS kept, IF({c} >= {sql_literal(low)}, {c}, NULL) AS value)"
        for number, (c, low, high) in enumerate(spans))
    # everything below a bracket becomes one row (missing value, sorts first); everything above is dropped
    table = plain.selectExpr(f"inline(array({cells}))").where("kept").groupBy("span", "value").agg(
        F.count(F.lit(1)).alias("ties"))
    wanted = [(number, slot, rank) for number, slots in enumerate(spans.values()) for slot in slots
              for rank in set(ranks[slot])]
    table = settle(table, "brackets")
    placed = running_before(table, "span", ["value"], F.col("ties"), table.count(), range_rows)
    hit = " OR ".join(f"(span = {number} AND before <= {rank} AND before + ties > {rank})" for number, _, rank in wanted)
    ordered = placed.where(hit).select("span", "value", "before", "ties").collect()  # two rows a quantile at most
    out = {}
    for span, value, before, ties in ordered:
        for number, slot, rank in wanted:
            if number == span and value is not None and before <= rank < before + ties:
                out[slot, rank] = value
    return out
