"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output, numpy SGD."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.blocks import MODEL_BLOCK, Prefix, blocks, mix, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET_BITS = 14
DIMENSIONS = 8
CHAR_GRAMS = (3, 4, 5)
EPOCHS = 12
RATE = 0.2
#: the classifier is fitted on at most so many labelled documents, drawn by a hash of their id
SAMPLE = 4000
SEED = 5

_TO_BUCKET = np.uint64(64 - BUCKET_BITS)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of ranges one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def _char_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams (of bytes) of words with their borders, and the word of each."""
    sizes = ends - starts + 2
    total = int(sizes.sum())
    last = np.cumsum(sizes)
    flat = np.full(total, ord("<"), np.uint8)
    inner = _spread(last - sizes + 1, sizes - 2)
    flat[inner] = data[_spread(starts, ends - starts)]
    flat[last - 1] = ord(">")
    word = np.repeat(np.arange(len(sizes)), sizes)
    hashed = Prefix(flat, seed=3)
    buckets, owners = [], []
    for n in CHAR_GRAMS:
        h = hashed.windows(n)
        own = np.flatnonzero(word[: len(h)] == word[n - 1: n - 1 + len(h)])
        buckets.append((mix(h[own] + np.uint64(n)) >> _TO_BUCKET).astype(np.int64))
        owners.append(word[own])
    return np.concatenate(buckets), np.concatenate(owners)


def _parts(data: np.ndarray, offsets: np.ndarray):
    """Of a block: each word's kind, the kinds' grams and owners, kinds' own buckets, word pairs' buckets, first words."""
    starts, ends, first = words(data, offsets)
    hashes = mix(Prefix(data).ranges(starts, ends))
    kinds, example, kind = np.unique(hashes, return_index=True, return_inverse=True)
    grams, owner = _char_grams(data, starts[example], ends[example]) if len(kinds) else (np.zeros(0, np.int64),) * 2
    pairs = (mix(hashes[:-1] * np.uint64(3) + hashes[1:]) >> _TO_BUCKET).astype(np.int64)
    return kind, grams, owner, (kinds >> _TO_BUCKET).astype(np.int64), pairs, first


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def _pair_values(pairs: np.ndarray, table: np.ndarray, first: np.ndarray, n_words: int) -> np.ndarray:
    """By word: the value of the pair that begins there, 0 at a document's last word."""
    out = np.zeros(n_words)
    out[: len(pairs)] = table[pairs]
    ends = first[1:] - 1
    out[ends[(ends >= first[:-1])]] = 0.0
    return out


def logits(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """The log-odds of label 1: the mean over a text's features of what each bucket adds, and the bias."""
    out = np.full(len(texts), bias)
    ones = np.ones(len(table))
    for row, data, offsets in blocks(texts, MODEL_BLOCK):
        kind, grams, owner, own, pairs, first = _parts(data, offsets)
        if not len(kind):
            continue
        worth = np.bincount(owner, table[grams], len(own)) + table[own]
        count = np.bincount(owner, minlength=len(own)) + 1.0
        total = _row_sums(worth[kind] + _pair_values(pairs, table, first, len(kind)), first)
        n = _row_sums(count[kind] + _pair_values(pairs, ones, first, len(kind)), first)
        out[row: row + len(total)] += total / np.maximum(n, 1.0)
    return out


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text's features."""
    size = 1 << BUCKET_BITS
    for _, data, offsets in blocks(texts, MODEL_BLOCK):
        kind, grams, owner, own, pairs, first = _parts(data, offsets)
        order = np.argsort(owner, kind="stable")
        grams, n_grams = grams[order], np.bincount(owner, minlength=len(own))
        at = np.cumsum(n_grams) - n_grams
        for a, b in zip(first, first[1:]):
            mine = kind[a:b]
            bag = np.bincount(grams[_spread(at[mine], n_grams[mine])], minlength=size) + np.bincount(own[mine], minlength=size)
            bag = bag + np.bincount(pairs[a: max(a, b - 1)], minlength=size)
            used = np.flatnonzero(bag)
            yield used.astype(np.int16), (bag[used] / max(bag.sum(), 1)).astype(np.float32)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = SEED) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent over (label, buckets, shares); what each bucket adds to the log-odds, and the bias."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (size, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    seen, out_seen = np.full((size, 1), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            label, buckets, shares = rows[i]
            if not len(buckets):
                continue
            hidden = shares @ vectors[buckets]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1.0
            back = out @ p
            out_seen += float(p @ p)
            out -= RATE / np.sqrt(out_seen) * np.outer(hidden, p) * 10
            bias -= RATE / np.sqrt(out_seen) * p
            step = shares[:, None] * back[None, :]
            seen[buckets, 0] += (step * step).sum(1)
            vectors[buckets] -= RATE * step / np.sqrt(seen[buckets])
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        label = batch.column("label").to_pylist()
        rows += [(y, b, s) for y, (b, s) in zip(label, bags(batch.column("text")))]
    table, bias = fit(rows)
    yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias]), pa.array([len(rows)])],
                                     names=["weights", "bias", "n"])


def is_held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
          sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample`` labelled documents that are not held out, the first by a hash of their id.

    Labels other than 0 and 1 and null ids don't count; an id with several labels counts with the smallest. Without
    any label every text scores 0.5.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~is_held_out(F.col(key)))
        .groupBy(F.col(key).alias("_id")).agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(sample)
    )
    rows = (
        docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
        .groupBy("_id").agg(F.min("label").alias("label"), F.max("text").alias("text"))
        .repartitionByRange(1, "_id").sortWithinPartitions("_id")
    )
    model = rows.select("label", "text").mapInArrow(_train, "weights binary, bias double, n long").agg(
        F.max_by("weights", "n").alias("weights"), F.max_by("bias", "n").alias("bias"), F.max("n").alias("n")).first()
    if not model["n"]:
        return np.zeros(1 << BUCKET_BITS), 0.0
    return np.frombuffer(model["weights"], np.float64), model["bias"]


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
                   sample: int = SAMPLE, cut: float = 0.7) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (probability of label 1) and ``predicted``; such columns are replaced.

    Every whole text is scored in one pass without a shuffle. Null and empty texts have no features and get the score
    of the bias alone. Repeated rows get the same score; an empty table gives an empty one. Very long
    texts are scored whole. Other columns are kept, whatever their names.
    """
    docs = docs.drop("held_out", "score", "predicted")
    table, bias = train(docs, labels, text, key, label, sample)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(logits(texts, table, bias), -60, 60))))

    return (
        docs.withColumn("held_out", is_held_out(F.col(key))).withColumn("score", probability(F.col(text)))
        .withColumn("predicted", (F.col("score") >= cut).cast("int"))
    )
