"""Vector codes against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm.vector_codes import LONG, Codebook, codebooks_digest, part_edges, vector_codes

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain integers and loops; rows with one length and distinct ids."""
    kept = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    edges = part_edges(len(kept[0][1]), parts)
    first = sorted(kept, key=lambda r: (r[0] is None, r[0]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in zip(edges, edges[1:])]

    def near(p, x):
        return min((sum((u - w) ** 2 for u, w in zip(x[edges[p]: edges[p + 1]], y)), e) for e, y in enumerate(books[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x, _ in kept:
            for p in range(parts):
                groups[p, near(p, x)[1]].append(x[edges[p]: edges[p + 1]])
        for (p, e), own in groups.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, y, [near(p, x) for p in range(parts)]) for i, x, y in kept]
    errors = defaultdict(int)
    for _, y, own in found:
        errors[y] += sum(d for d, _ in own)
    text = ",".join(str(c) for b in books for e in b for c in e)
    return sorted(((i, "".join(f"{e:02x}" for _, e in own), min(sum(d for d, _ in own), LONG), min(errors[y], LONG)) for i, y, own in found),
                  key=str), hashlib.sha256(text.encode()).hexdigest()


def coded(table, **more):
    done, books = vector_codes(table, **more)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in done.collect()), key=str), codebooks_digest(books)


def vectors(n, dimensions, seed=0, labels=(0, 1, None), step=None):
    r = random.Random(seed)
    one = lambda: r.uniform(-1, 1) if step is None else r.randrange(-3, 4) * step
    return [(i, [one() for _ in range(dimensions)], r.choice(labels)) for i in r.sample(range(10 * n), n)]


@pytest.mark.parametrize("rows", [vectors(150, 24), vectors(120, 16, 1, step=1 / 4096), vectors(9, 8, 2), vectors(60, 21, 3)])
def test_against_brute_force(spark, rows):
    assert coded(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_search_equals_all_distances():
    rng = np.random.default_rng(3)
    for _ in range(30):
        k, d = rng.integers(1, 20), rng.integers(1, 6)
        entries, rows = rng.integers(-4, 5, (k, d)), rng.integers(-5, 6, (50, d))  # small numbers: many ties and equal entries
        index, distance = Codebook(entries).nearest(rows)
        every = ((rows[:, None] - entries[None]) ** 2).sum(-1)
        assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_huge_components(spark):
    rows = [(i, [1e7 * (i % 5) + i, -3e7, 2.5, 1e8 * i, 0.0, 1.0, 2.0, 3.0], 1) for i in range(40)]
    assert coded(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_odd_rows(spark):
    """Nulls, non-finite components, other lengths, empty vectors, null ids and labels, repeated rows, clashing names, an empty table."""
    good = vectors(30, 16, 4)
    bad = [(1000, None, 1), (1001, [], 1), (1002, [None] + [0.0] * 15, 1), (1003, [math.nan] + [0.0] * 15, 2), (1004, [math.inf] + [0.0] * 15, 2),
           (1005, [1.0] * 8, 1)]
    table = spark.createDataFrame(good + bad, SCHEMA)
    assert coded(table) == brute(good)
    clash = table.withColumns({c: F.lit("mine") for c in ("coded", "own_label", "sum", "error", "key", "id", "n")})
    assert coded(clash) == brute(good)
    done, _ = vector_codes(clash)
    assert {(r.coded, r.own_label, r.sum, r.key) for r in done.collect()} == {("mine",) * 4}
    twice = [(None, [0.5] * 16, None), (3, [0.25] * 16, None), (3, [0.25] * 16, None)]
    got, _ = coded(spark.createDataFrame(twice, SCHEMA))
    assert [r[0] for r in got] == [3, 3, None] and got[0] == got[1]
    none, books = vector_codes(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and books == [] and {"code", "error", "label_error"} <= set(none.columns)
