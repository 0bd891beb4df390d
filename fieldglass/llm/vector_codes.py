"""Vector code compression: product codes, each part's nearest codebook entry found by Orchard's search.

Every codebook entry has a list of the other entries in order of their distance to it. A search walks the list of its
best entry so far and jumps to the list of a better one as soon as it meets it; entries that were looked at are marked,
and the walk ends at an entry farther from the best one than twice the best one's distance, as none beyond can win.

Codebooks are trained by rounds over all vectors. A task adds up its own parts by entry, so a round shuffles sums only.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.frames import if_small, same, settle, unused

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: scaled components beyond this are set to it
LARGEST = 1 << 60
LONG = (1 << 63) - 1


class Codebook:
    """The entries of one part position, with the list of neighbours of each by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = entries[:, None] - entries[None]
        self.between = (gaps * gaps).sum(-1)
        self.lists = np.stack([np.array(sorted(range(len(entries)), key=lambda e: (row[e], e))) for row in self.between.tolist()])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row, of equals the first; all rows search at once."""
        n, k = len(parts), len(self.entries)
        gap = parts - self.entries[0]
        best, distance = np.zeros(n, np.int64), (gap * gap).sum(1)
        marked = np.zeros((n, k), bool)
        marked[:, 0] = True
        place = np.zeros(n, np.int64)  # in the list of the best entry
        rows = np.arange(n)
        while len(rows):
            rows = rows[place[rows] < k]
            entry = self.lists[best[rows], place[rows]]
            near = (self.between[best[rows], entry] <= 4 * distance[rows]).astype(bool)  # squares: twice the distance
            rows, entry = rows[near], entry[near]
            place[rows] += 1
            fresh = ~marked[rows, entry]
            looked, entry = rows[fresh], entry[fresh]
            marked[looked, entry] = True
            gap = parts[looked] - self.entries[entry]
            found = (gap * gap).sum(1)
            better = ((found < distance[looked]) | ((found == distance[looked]) & (entry < best[looked]))).astype(bool)
            looked = looked[better]
            best[looked], distance[looked], place[looked] = entry[better], found[better], 0
        return best, distance


def part_edges(dimensions: int, parts: int) -> list[int]:
    """Where consecutive parts begin and end; without an equal cut the first parts are one longer."""
    return [dimensions * i // parts if dimensions % parts == 0 else -(-dimensions * i // parts) for i in range(parts + 1)]


def _exact(rows: np.ndarray, books: list[np.ndarray]) -> bool:
    """Whether all distances fit 64 bits."""
    most = max([int(np.abs(rows).max(initial=0)), *(int(abs(b).max(initial=0)) for b in books)])
    return 4 * (2 * most) ** 2 * max(rows.shape[1], 1) < LONG


def _searched(rows: np.ndarray, books: list[np.ndarray], edges: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per part: each row's entry and squared distance; in Python's integers where 64 bits don't hold them."""
    kind = np.int64 if _exact(rows, books) else object
    rows = rows.astype(kind)
    return [Codebook(b.astype(kind)).nearest(rows[:, lo:hi]) for b, lo, hi in zip(books, edges, edges[1:])]


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimensions)


def _sums(books: list[np.ndarray], dimensions: int):
    """(part, entry, n, sums) of a task's parts by their nearest entry."""
    edges = part_edges(dimensions, len(books))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            rows = _matrix(batch.column(0), dimensions)
            wide = int(np.abs(rows).max(initial=0)) * max(len(rows), 1) > LONG
            for p, (entry, _) in enumerate(_searched(rows, books, edges)):
                own = rows[:, edges[p]: edges[p + 1]]
                for e in np.unique(entry).tolist():
                    mine = own[entry == e]
                    counts[p][e] += len(mine)
                    totals[p][e] += (mine.astype(object) if wide else mine).sum(0)
        used = [(p, e) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist()]
        kind = pa.list_(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
             pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
             pa.array([[int(x) for x in totals[p][e]] for p, e in used], kind)], names=["part", "entry", "n", "sums"])

    return sums


def _moved(vectors: DataFrame, books: list[np.ndarray], dimensions: int) -> list[np.ndarray]:
    """One round: every entry moves to the mean of its parts, rounded down; unused ones stay. The driver gets the sums only."""
    parts = vectors.select("ints").mapInArrow(_sums(books, dimensions), "part int, entry int, n bigint, sums array<decimal(38,0)>")
    rows = (
        parts.select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
        .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    )
    books = [b.copy() for b in books]
    for r in rows:
        books[r["part"]][r["entry"], r["at"]] = int(r["x"]) // int(r["n"])
    return books


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """Components times ``scale`` as integers, rounded down, within +-``LARGEST``."""
    x = lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * scale)))
    return F.transform(vector, x)


def is_whole(vector: Column) -> Column:
    """Not null, with neither null nor non-finite components."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def first_entries(vectors: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the vectors with the ``entries`` smallest keys, nulls last; of several vectors of a key the smallest."""
    rows = vectors.select(F.col(f"`{key}`").alias("id"), "ints")
    keys = rows.select(F.col("id").alias("key")).distinct().orderBy(F.col("key").asc_nulls_last()).limit(entries)
    found = (
        rows.join(F.broadcast(keys), same(F.col("id"), F.col("key")))
        .groupBy("id").agg(F.min("ints").alias("ints")).orderBy(F.col("id").asc_nulls_last()).collect()
    )
    rows = np.array([r["ints"] for r in found], np.int64)
    edges = part_edges(rows.shape[1], parts) if len(rows) else []
    return [rows[:, lo:hi] for lo, hi in zip(edges, edges[1:])]


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(x)) for b in books for x in b.reshape(-1))


def train_codebooks(vectors: DataFrame, key: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of a table with integer vectors ``ints`` of one length after ``rounds`` rounds over all of it."""
    books = first_entries(vectors, key, parts, entries)
    dimensions = sum(b.shape[1] for b in books)
    for _ in range(rounds if books else 0):
        books = _moved(vectors, books, dimensions)
    return books


def vector_codes(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(table, codebooks): rows with a whole vector and their ``code``, ``error`` and ``label_error``; such columns are replaced.

    Components become integers floor(``scale`` * x). Codebooks start with the vectors of the smallest keys and move
    ``rounds`` times; ``code`` has two hex digits for each part, ``error`` is the squared distance to the coded vector,
    ``label_error`` its sum over equal labels.

    Null vectors and vectors with null or non-finite components are left out, as are empty ones and those of another
    length than the vector of the smallest key. Null keys come last, null labels are one label. Components beyond
    2**60 are cut there, errors beyond 64 bits count as the largest long. Of equal distances the first entry wins;
    repeated rows get the same code and count each in the means; with fewer keys than ``entries`` the codebooks are
    smaller. Very long vectors cost memory of one Arrow batch of them. An empty table gives an empty one. Other
    columns are kept, whatever their names but ``ints``, which is replaced and dropped.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 1 to 256 entries")
    names = [c for c in vectors.columns if c not in ("code", "error", "label_error", "ints")]
    mine = [F.col(f"`{c}`") for c in names]
    whole, own, total_of = unused(vectors, "coded", "own_label", "sum")
    kept = settle(vectors.where(is_whole(F.col(vector))).select(*mine, scaled(F.col(vector), scale).alias("ints")), "vectors")
    first = kept.orderBy(F.col(key).asc_nulls_last(), "ints").select(F.size("ints")).first()
    if first is None:
        none = F.lit(None).cast("long")
        return kept.select(*mine, F.lit(None).cast("string").alias("code"), none.alias("error"), none.alias("label_error")), []
    dimensions = first[0]
    kept = kept.where(F.size("ints") == dimensions)
    books = train_codebooks(kept, key, parts, entries, rounds)
    edges = part_edges(dimensions, parts)

    @F.arrow_udf("code string, error bigint")
    def coded(ints: pa.Array) -> pa.Array:
        rows = _matrix(ints, dimensions)
        found = _searched(rows, books, edges)
        width, raw = 2 * parts, np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
        error = sum(d.astype(object) for _, d in found) if len(rows) else []
        return pa.StructArray.from_arrays(
            [pa.array([raw[i: i + width] for i in range(0, len(raw), width)], pa.string()),
             pa.array([min(int(e), LONG) for e in error], pa.int64())], names=["code", "error"])

    done = settle(kept.withColumn(whole, coded(F.col("ints"))).select(
        *mine, F.col(whole)["code"].alias("code"), F.col(whole)["error"].alias("error")), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    sums = settle(done.groupBy(F.col(f"`{label}`").alias(own)).agg(total.alias(total_of)), "label-errors")
    joined = done.join(if_small(sums), same(F.col(f"`{label}`"), F.col(own)), "left")
    return joined.select(*mine, "code", "error", F.col(total_of).alias("label_error")), books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place."""
    return hashlib.sha256(codebooks_text(books).encode()).hexdigest()
