"""N-gram Jaccard join: an LSH forest of MinHash signatures, prefixes shortened until the recall is reached, exact check.

Equal texts are one node. Each tree of the forest is the signatures' sorted prefix trie; nodes that share a prefix are
candidates. Candidate groups are compared exactly, block against block inside tasks: pairs are counted, never emitted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.blocks import Prefix, blocks, grams, mix, words
from fieldglass.llm.frames import same, settle, text_key, unused
from fieldglass.llm.graphs import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 7
BITS = 9
TARGET_RECALL = 0.9995
SEED = 17

#: bits of the fixed-size filter that keeps most texts without candidates from being shuffled
MARK_BITS = 1 << 24

#: nodes of a block that are compared at once, and the bytes of their shingles
BLOCK_NODES = 1024
BLOCK_BYTES = 4 << 20


def shingles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, each row's first hash): the distinct shingles of each text, sorted.

    A text of fewer words than a shingle has one of all its words; a text without words has none.
    """
    for row, data, offsets in blocks(texts):
        starts, ends, first = words(data, offsets)
        own = mix(Prefix(data).ranges(starts, ends))
        n = len(offsets) - 1
        word_row = np.repeat(np.arange(n), np.diff(first))
        found = grams(own, SHINGLE)
        whole = np.flatnonzero(np.arange(len(found)) + SHINGLE <= first[word_row[: len(found)] + 1])
        few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
        short = np.array([grams(own[first[r]: first[r + 1]], int(first[r + 1] - first[r]))[0] for r in few], np.uint64)
        hashes, rows = np.concatenate([found[whole], short]), np.concatenate([word_row[whole], few])
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[new], rows[new]
        yield row, hashes, np.searchsorted(rows, np.arange(n + 1))


def signature_keys(texts: pa.Array) -> pa.StructArray:
    """Each text's number of shingles and its key in each tree: DEPTH MinHash values of BITS bits, first one on top."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1 << 62, 1 << 63, (TREES, DEPTH), np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 1 << 64, (TREES, DEPTH), np.uint64)
    keys = np.zeros((len(texts), TREES), np.int64)
    sizes = np.zeros(len(texts), np.int64)
    for row, hashes, first in shingles(texts):
        n = np.diff(first)
        sizes[row: row + len(n)] = n
        at = np.flatnonzero(n)
        if not len(at):
            continue
        for t in range(TREES):
            key = np.zeros(len(at), np.uint64)
            for d in range(DEPTH):
                least = np.minimum.reduceat((hashes + shifts[t, d]) * factors[t, d], first[at])
                key = (key << np.uint64(BITS)) | (mix(least) >> np.uint64(64 - BITS))
            keys[row + at, t] = key.astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * TREES, pa.int32()), pa.array(keys.reshape(-1)))
    return pa.StructArray.from_arrays([pa.array(sizes), lists], names=["size", "keys"])


def _signature(text: Column) -> Column:
    @F.arrow_udf("size bigint, keys array<bigint>")
    def sign(texts: pa.Array) -> pa.Array:
        return signature_keys(texts)

    return sign(text)


def chance(similarity, depth: int):
    """The probability that two texts share a prefix of ``depth`` in some tree."""
    return 1.0 - (1.0 - similarity ** depth) ** TREES


def _nodes(docs: DataFrame, text: str, key: str) -> DataFrame:
    """One row for each distinct text: node (128 bits), rep (least id), copies, size and keys."""
    t1, t2 = text_key(F.col(text))
    rows = docs.select(F.col(key).alias("id"), t1.alias("t1"), t2.alias("t2"), _signature(F.col(text)).alias("s"))
    return settle(rows.groupBy("t1", "t2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("s").alias("s"))
                  .select(F.struct("t1", "t2").alias("node"), "rep", "copies", "s.size", "s.keys"), "nodes")


def _candidates(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, component): groups of nodes that chains of shared prefixes connect."""
    prefix = F.shiftright("key", BITS * (DEPTH - depth))
    tries = (nodes.where("size > 0").select("node", F.posexplode("keys").alias("tree", "key"))
             .select("node", "tree", prefix.alias("prefix")))
    heads = tries.groupBy("tree", "prefix").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last")
    stars = tries.join(heads.select("tree", "prefix", "head"), ["tree", "prefix"]).where("node <> head")
    return components(stars.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct())


def _blocks_of(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, rep, component, i, j, side): each pair of blocks of a component is compared by one task."""
    members = found.join(nodes.select("node", "rep", "size"), "node")
    sums = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    wide = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("long")
    return (
        members.join(sums.select(F.col("component").alias("_c"), wide.alias("wide")), F.col("component") == F.col("_c"))
        .withColumn("side", F.pmod(F.xxhash64(F.lit(SEED), "node"), F.col("wide")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)))
        .select("node", "rep", "component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")
    )


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share, by a product of 0/1 matrices, some columns at a time."""
    m = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    kinds, kind, n = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1
    keep = n[kind] > 1
    owner, kind = owner[keep], rank[kind[keep]]
    order = np.argsort(kind, kind="stable")
    owner, kind = owner[order], kind[order]
    out = np.zeros((m, m), np.float32)
    width = 2048
    edges = np.searchsorted(kind, np.arange(0, (int(kind[-1]) if len(kind) else 0) + width + 1, width))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            part = np.zeros((m, width), np.float32)
            part[owner[a:b], kind[a:b] - k * width] = 1.0
            out += part @ part.T
    return out


def _compare(sets: list[np.ndarray], side: np.ndarray, depth: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per set: links (between the two sides if there are two), their weights for the recall, least linked set."""
    size = np.array([len(s) for s in sets], np.float64)
    shared = _common(sets).astype(np.float64)
    alike = shared / np.maximum(size[:, None] + size[None, :] - shared, 1.0)
    linked = alike >= threshold - 1e-12
    np.fill_diagonal(linked, False)
    group = linked.copy()
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    weight = np.where(linked, 1.0 / chance(np.maximum(alike, threshold), depth), 0.0).sum(1)
    least = np.arange(len(sets))
    while True:
        new = np.minimum(least, np.where(group, least[None, :], len(sets)).min(1))
        if (new == least).all():
            return linked.sum(1), weight, least
        least = new


def _verify(depth: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # (node, side, shingles) of the pair of blocks that goes on
        pair = None

        def done() -> pa.RecordBatch:
            nodes = {}
            for node, side, own in kept:
                nodes[node] = (side, own)
            names = sorted(nodes)
            links, weight, least = _compare([nodes[x][1] for x in names], np.array([nodes[x][0] for x in names]), depth, threshold)
            columns = [[x[0] for x in names], [x[1] for x in names], [names[k][0] for k in least], [names[k][1] for k in least]]
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(links.astype(np.int64)), pa.array(weight)],
                                              names=["t1", "t2", "l1", "l2", "links", "weight"])

        for batch in batches:
            c1, c2, i, j, side, t1, t2 = (batch.column(k).to_pylist() for k in range(7))
            for row, hashes, first in shingles(batch.column(7)):
                for r in range(len(first) - 1):
                    k = row + r
                    now = (c1[k], c2[k], i[k], j[k])
                    if now != pair and kept:
                        yield done()
                        kept = []
                    pair = now
                    kept.append(((t1[k], t2[k]), side[k], hashes[first[r]: first[r + 1]].copy()))
        if kept:
            yield done()

    return verify


def _marks(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of MARK_BITS with the hashed keys' bits set; at most MARK_BITS / 32 numbers reach the driver."""
    bit = F.pmod(F.col(key), F.lit(MARK_BITS))
    one = F.expr(f"shiftleft(1L, CAST(pmod({key}, 32) AS INT))")
    parts = keys.select(F.floor(bit / 32).alias("word"), one.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    marks = np.zeros(MARK_BITS // 32, np.uint32)
    marks[parts.column("word").to_numpy()] = parts.column("mask").to_numpy().astype(np.uint32)
    return marks


def _marked(key: Column, marks: np.ndarray) -> Column:
    """Whether a key's bit is set: always for keys of the bitmap, seldom for others while it is sparse."""

    @F.arrow_udf("boolean")
    def marked(keys: pa.Array) -> pa.Array:
        bit = keys.to_numpy(zero_copy_only=False) % MARK_BITS
        return pa.array((marks[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1) > 0)

    return marked(key)


def _links(docs: DataFrame, nodes: DataFrame, text: str, key: str, depth: int, threshold: float) -> DataFrame:
    """(t1, t2, l1, l2, links, weight) of the candidates at ``depth``: exact links within and between blocks."""
    work = settle(_blocks_of(_candidates(nodes, depth), nodes), "blocks")
    wanted = work.select("node", "rep").distinct().select(F.col("node.t1").alias("n1"), F.col("node.t2").alias("n2"), "rep")
    marks = _marks(wanted, "n2")
    t1, t2 = text_key(F.col(text))
    texts = (
        docs.select(F.col(key).alias("id"), F.col(text).alias("text"), t1.alias("t1"), t2.alias("t2"))
        .where(_marked(F.col("t2"), marks))
        .join(wanted, (F.col("t1") == F.col("n1")) & (F.col("t2") == F.col("n2")) & same(F.col("id"), F.col("rep")))
        .groupBy("t1", "t2").agg(F.first("text").alias("text"))
    )
    tasks = work.join(texts, (F.col("node.t1") == F.col("t1")) & (F.col("node.t2") == F.col("t2")))
    rows = tasks.select(F.col("component.t1").alias("c1"), F.col("component.t2").alias("c2"), "i", "j", "side", "t1", "t2", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(
        rows.repartition(parts, "c1", "c2", "i", "j").sortWithinPartitions("c1", "c2", "i", "j")
        .mapInArrow(_verify(depth, threshold), "t1 bigint, t2 bigint, l1 bigint, l2 bigint, links bigint, weight double"), "links")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD,
                    target: float = TARGET_RECALL) -> DataFrame:
    """(key, t1, t2, class_id, class_t1, class_t2, text_id, n_copies, n_links): one row per document.

    ``text_id`` is the least id with the same text and ``n_copies`` counts those rows, ``n_links`` counts the other
    texts whose five-word shingle sets have a Jaccard similarity of ``threshold`` or more, and ``class_id`` is the least
    id of the texts that chains of links connect. Classes may share that id; ``class_t1`` and ``class_t2``, the key of
    the class's least text, tell them apart.

    Matched prefixes are shortened, beginning at the longest that finds 99.9 % of the pairs at the threshold, until the
    links found (each weighted by its chance to be found) say that the recall is ``target``. Links are exact.

    Null and empty texts are equal texts without shingles: one class, no links. Null ids count as the largest; a class of
    nothing else has a null id. Repeated rows are copies; an empty table gives an empty one. Very long texts count with all their
    shingles. Other columns are not returned, whatever their names.
    """
    nodes = _nodes(docs, text, key)
    depth = max(d for d in range(1, DEPTH + 1) if d == 1 or chance(threshold, d) >= 0.999)
    while True:
        found = _links(docs, nodes, text, key, depth, threshold)
        sums = found.agg(F.sum("links").alias("links"), F.sum("weight").alias("weight")).first()
        if not sums["links"] or sums["links"] / sums["weight"] >= target or depth == 1:
            break
        depth -= 1
    chains = components(found.where("t1 <> l1 OR t2 <> l2").select(F.struct("t1", "t2").alias("a"), F.struct(F.col("l1").alias("t1"), F.col("l2").alias("t2")).alias("b")))
    links = found.groupBy(F.struct("t1", "t2").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.select("node", "rep", "copies").join(chains, "node", "left").join(links, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = settle(named.join(least, "component").select(
        F.col("node.t1").alias("n1"), F.col("node.t2").alias("n2"), "class_id",
        F.col("component.t1").alias("class_t1"), F.col("component.t2").alias("class_t2"), F.col("rep").alias("text_id"),
        F.col("copies").alias("n_copies"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links")), "classes")
    t1, t2 = text_key(F.col(text))
    rows = docs.select(F.col(key), t1.alias("t1"), t2.alias("t2"))
    return rows.join(classes, (F.col("t1") == F.col("n1")) & (F.col("t2") == F.col("n2")), "left").drop("n1", "n2")


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: the least id (of rows that share it, the least text).

    Each class without any id keeps one row, and so does each of the classes that have the same least id. Of rows with the same
    id and text one stays, whichever: they are one document. Nulls, empty and very long texts and empty tables as in
    ``near_duplicates``. Other columns are kept, whatever their names.
    """
    classes = near_duplicates(docs, text, key, threshold)
    own_1, own_2, found_id, found_1, found_2 = unused(docs, "_t1", "_t2", "_id", "_f1", "_f2")
    stay = classes.groupBy("class_t1", "class_t2").agg(F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("id"), "t1", "t2")).alias("f"))
    stay = stay.select(F.col("f.id").alias(found_id), F.col("f.t1").alias(found_1), F.col("f.t2").alias(found_2)).distinct()
    t1, t2 = text_key(F.col(text))
    kept = docs.withColumns({own_1: t1, own_2: t2}).join(
        stay, same(F.col(key), F.col(found_id)) & (F.col(own_1) == F.col(found_1)) & (F.col(own_2) == F.col(found_2)), "left_semi")
    return kept.dropDuplicates([key, own_1, own_2]).drop(own_1, own_2)
