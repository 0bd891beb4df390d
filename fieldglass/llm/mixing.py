"""Mixing sources to target weights: fixed-length word blocks, dealt to output shards and joined by index.

Every source is one long stream of words, cut into blocks of equal length. A source's quota of blocks is dealt to the
output shards by a multinomial draw; its slots, numbered over all shards, go through a pseudorandom permutation of the
source's block indices (a new one each time the source has been gone through), and the blocks are joined by index.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldglass.llm.blocks import blocks, mix, words
from fieldglass.llm.frames import if_small, same, settle, text_key
from fieldglass.operators.distribution import with_row_position

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_WORDS = 1024
SHARD_BLOCKS = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = 11

#: documents of a source are laid out in chunks of about so many, each ordered by one task
CHUNK_DOCS = 4000

WORD = r"[^\x20\x09-\x0D]+"


# --- targets -------------------------------------------------------------------------------------------------------

def source_targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """(source, sid, docs, source_size, target) from rows of (source, size).

    Sources by code point, null last, get ``weights`` in turn and share ``share`` times all words by weight. A target
    stops at ``cap`` times its source's size; what is above is shared again by weight until none is above. The level
    is found by one-row aggregates over the sources, a few rounds whatever their number.
    """
    totals = settle(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "sources")
    ranked = with_row_position(totals.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "sid").drop("_last")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    table = settle(ranked.withColumn("weight", F.get(turn, (F.col("sid") % len(weights)).cast("int"))), "sources")
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    most = F.lit(float(cap)) * F.col("source_size")
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= most
        row = table.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, most)).alias("words"),
                        F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if row["n"] == stopped or not row["open"]:
            break
        stopped, level = row["n"], (budget - (row["words"] or 0.0)) / row["open"]
    return table.withColumn("target", F.least(most, F.col("weight") * F.lit(level)) if row["open"] else most).drop("weight")


# --- permutations --------------------------------------------------------------------------------------------------

def _halves(n: np.ndarray) -> np.ndarray:
    """Bits of half a Feistel word whose domain holds n values."""
    bits = np.ceil(np.log2(np.maximum(n.astype(np.float64), 2.0)) + 1e-9).astype(np.uint64)
    return (bits + np.uint64(1)) // np.uint64(2)


def _feistel(x: np.ndarray, key: np.ndarray, half: np.ndarray, back: bool = False) -> np.ndarray:
    mask = (np.uint64(1) << half) - np.uint64(1)
    left, right = x >> half, x & mask
    for r in (3, 2, 1, 0) if back else (0, 1, 2, 3):
        salt = key + np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        if back:
            left, right = right ^ (mix(left + salt) & mask), left
        else:
            left, right = right, left ^ (mix(right + salt) & mask)
    return (left << half) | right


def permuted(index: np.ndarray, key: np.ndarray, n: np.ndarray, back: bool = False) -> np.ndarray:
    """A bijection of 0..n-1 chosen by ``key``, by walking a Feistel network's cycles back into the range."""
    index, key, n = index.astype(np.uint64), key.astype(np.uint64), n.astype(np.uint64)
    half = _halves(n)
    out = _feistel(index, key, half, back)
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = _feistel(out[far], key[far], half[far], back)
    return out.astype(np.int64)


def _epoch_key(source_key: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    return mix(source_key.astype(np.int64).view(np.uint64) + mix(epoch.astype(np.uint64) + np.uint64(1)))


# --- the draw ------------------------------------------------------------------------------------------------------

def slots_of(size: int, want: int, length: int, source_key: int) -> tuple[int, int]:
    """(slots, words of the last slot) with which a source of ``size`` words gives exactly ``want`` words."""
    n, short = -(-size // length), (size - 1) % length + 1
    epochs, rest = divmod(want, size)
    if not rest:
        return epochs * n, -1
    one = lambda x: np.array([x])
    key = _epoch_key(one(source_key), one(epochs))
    at = int(permuted(one(n - 1), key, one(n), back=True)[0])  # when the short last block has its turn
    if rest <= at * length:
        more = -(-rest // length)
        return epochs * n + more, rest - (more - 1) * length
    rest -= at * length
    if rest <= short:
        return epochs * n + at + 1, rest
    more = -(-(rest - short) // length)
    return epochs * n + at + 1 + more, rest - short - (more - 1) * length


def _deal(sources: DataFrame, shards: int, length: int, seed: int, cap: float) -> DataFrame:
    """Multinomial counts: (sid, source_key, blocks, shard, first_slot, n, slots, last_words)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, want = row["source_size"], min(int(row["target"] + 0.5), int(cap * row["source_size"]))
                if size <= 0 or want <= 0:
                    continue
                slots, last = slots_of(size, want, length, row["source_key"])
                draw = np.random.default_rng([seed, row["source_key"] & (1 << 63) - 1])
                if slots < shards:  # the same distribution without a vector of all shards
                    shard, n = np.unique(draw.integers(0, shards, slots), return_counts=True)
                else:
                    n = draw.multinomial(slots, np.full(shards, 1 / shards))
                    shard = np.flatnonzero(n)
                    n = n[shard]
                same_all = lambda x: pa.array(np.full(len(n), x, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [same_all(row["sid"]), same_all(row["source_key"]), same_all(-(-size // length)),
                     pa.array(shard.astype(np.int64)), pa.array((np.cumsum(n) - n).astype(np.int64)), pa.array(n.astype(np.int64)),
                     same_all(slots), same_all(last)],
                    names=["sid", "source_key", "blocks", "shard", "first_slot", "n", "slots", "last_words"])

    schema = "sid bigint, source_key bigint, blocks bigint, shard bigint, first_slot bigint, n bigint, slots bigint, last_words bigint"
    return sources.select("sid", "source_key", "source_size", "target").mapInArrow(deal, schema)


def _block_of(source_key: Column, n_blocks: Column, slot: Column) -> Column:
    @F.arrow_udf("bigint")
    def block(source_key: pa.Array, n_blocks: pa.Array, slot: pa.Array) -> pa.Array:
        key, n, j = (x.to_numpy(zero_copy_only=False) for x in (source_key, n_blocks, slot))
        return pa.array(permuted(j % n, _epoch_key(key, j // n), n))

    return block(source_key, n_blocks, slot)


def draw_slots(sources: DataFrame, length: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
               cap: float = CAP) -> DataFrame:
    """(shard, slot, sid, block, words): which block goes where, and how many of its words are taken.

    Every block is taken at most as often as its source is gone through, so no document exceeds the cap.
    """
    all_words = sources.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, math.ceil(all_words / (length * shard_blocks)))
    keyed = sources.withColumn("source_key", F.xxhash64(F.lit(seed), "source"))
    dealt = settle(_deal(keyed, shards, length, seed, cap), "dealt")
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = dealt.repartition(parts, "sid", "shard").withColumn("j", F.explode(F.expr("sequence(first_slot, first_slot + n - 1)")))
    taken = F.when((F.col("j") == F.col("slots") - 1) & (F.col("last_words") >= 0), F.col("last_words")).otherwise(F.lit(length))
    return one.select("shard", F.col("j").alias("slot"), "sid", _block_of(F.col("source_key"), F.col("blocks"), F.col("j")).alias("block"), taken.alias("words"))


# --- layout --------------------------------------------------------------------------------------------------------

def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, t1, t2): the words of each text, null texts none."""
    t1, t2 = text_key(F.col(text))
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                       F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
                       t1.alias("t1"), t2.alias("t2"))


def laid_out(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Each row with its source's figures and ``start``, the place of its first word in the source's stream.

    Sources are split into chunks by hash, so that a source with a third of all rows is ordered by many tasks.
    """
    rows = sizes.withColumnRenamed("source", "_s").join(if_small(sources), same(F.col("_s"), F.col("source"))).drop("_s")
    n = F.ceil(F.col("docs") / F.lit(float(CHUNK_DOCS))).cast("long")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("t1", "t2", "doc_id"), n))
    chunks = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("_n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = settle(chunks.select("sid", "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")), "chunks")
    inside = (Window.partitionBy("sid", "chunk").orderBy(F.col("doc_id").asc_nulls_last(), "t1", "t2")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(if_small(chunks), ["sid", "chunk"])
        .withColumn("start", F.col("_offset") + F.col("_before")).drop("_before", "_offset", "chunk")
    )


def _overlap(length: int) -> dict:
    """Of a piece [at, at + n) of a block, the words that a slot takes."""
    return {"n": F.least(F.col("at") + F.col("n"), F.col("words")) - F.least(F.col("at"), F.col("words"))}


def mixed_counts(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", length: int = BLOCK_WORDS,
                 share: float = SHARE, cap: float = CAP, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target (its source's), taken (words, repeats counted).

    A source's taken words are its target, rounded. Null and empty texts have size 0 and give nothing; a null source is
    a source of its own; rows with the same id are documents of their own, in order of their texts' hashes; of rows
    equal in both either may come first. Very long texts are cut into blocks like a run of short
    ones. An empty table gives an empty one. Other columns are not returned, whatever their names.
    """
    sizes = settle(sized(docs, text, source, key), "sizes")
    sources = settle(source_targets(sizes, share, cap, weights), "targets")
    layout = settle(laid_out(sizes, sources), "layout")
    pieces = (
        layout.where("size > 0").select("sid", "start", "size")
        .withColumn("block", F.explode(F.expr(f"sequence(start div {length}, (start + size - 1) div {length})")))
        .withColumn("at", F.greatest("start", F.col("block") * length) - F.col("block") * length)
        .withColumn("n", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * length) - F.col("block") * length - F.col("at"))
    )
    got = (
        pieces.join(draw_slots(sources, length, seed=seed, cap=cap).select("sid", "block", "words"), ["sid", "block"])
        .withColumns(_overlap(length)).groupBy("sid", "start").agg(F.sum("n").alias("taken"))
        .select(F.col("sid").alias("_sid"), F.col("start").alias("_start"), "taken")
    )
    return (
        layout.join(got, (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0), "left")
        .select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )


def _cut(length: int):
    """Texts cut at the block borders of their source's stream: (sid, block, at, n, doc_id, piece)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, start, doc = (batch.column(i).to_pylist() for i in range(3))
            for first_row, data, offsets in blocks(batch.column(3)):
                at_word, _, first = words(data, offsets)
                raw, out = data.tobytes(), ([], [], [], [], [], [])
                for r in range(len(offsets) - 1):
                    a, b, end = int(first[r]), int(first[r + 1]), int(offsets[r + 1])
                    place = start[first_row + r]
                    while a < b:
                        n = min(b - a, length - place % length)
                        stop = int(at_word[a + n]) if a + n < b else end
                        for column, value in zip(out, (sid[first_row + r], place // length, place % length, n, doc[first_row + r],
                                                       raw[int(at_word[a]): stop].decode())):
                            column.append(value)
                        a, place = a + n, place + n
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in out[:5]], pa.array(out[5], pa.string())],
                    names=["sid", "block", "at", "n", "doc_id", "piece"])

    return cut


def _first_words(piece: Column, n: Column) -> Column:
    @F.arrow_udf("string")
    def cut(pieces: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for text, k in zip(pieces.to_pylist(), n.to_pylist()):
            raw = np.frombuffer(text.encode(), np.uint8)
            starts, _, _ = words(raw, np.array([0, len(raw)]))
            out.append(text if k >= len(starts) else text.encode()[: int(starts[k])].decode())
        return pa.array(out, pa.string())

    return cut(piece, n)


def mixed_blocks(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", length: int = BLOCK_WORDS,
                 share: float = SHARE, cap: float = CAP, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix itself: (shard, slot, source, block, n_words, doc_ids, text), one row for each block taken.

    A block's text is its pieces of documents in order, a blank line between documents; ``doc_ids`` are theirs.
    Defined for nulls, ties and empty tables as ``mixed_counts``.
    """
    sizes = settle(sized(docs, text, source, key), "sizes")
    sources = settle(source_targets(sizes, share, cap, weights), "targets")
    t1, t2 = text_key(F.col(text))
    # The layout is made with the texts: a row's place can't be joined back to rows that repeat.
    texts = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"), t1.alias("t1"), t2.alias("t2"),
                        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    layout = laid_out(texts.where("size > 0"), sources)
    pieces = layout.select("sid", "start", F.col("doc_id").cast("long"), "text").mapInArrow(
        _cut(length), "sid bigint, block bigint, at bigint, n bigint, doc_id bigint, piece string")
    whole = pieces.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("at", "n", "doc_id", "piece"))).alias("pieces"))
    slots = draw_slots(sources, length, seed=seed, cap=cap)
    names = sources.select("sid", "source")
    taken = F.filter("pieces", lambda p: p["at"] < F.col("words"))
    last = F.element_at("pieces", -1)
    joined = slots.join(whole, ["sid", "block"]).withColumn("pieces", taken).withColumn("full", last["at"] + last["n"])
    cut = joined.withColumn("end", F.when(F.col("full") > F.col("words"), _first_words(last["piece"], F.col("words") - last["at"]))
                            .otherwise(last["piece"]))
    body = F.concat(F.transform(F.slice("pieces", 1, F.greatest(F.size("pieces") - 1, F.lit(0))), lambda p: p["piece"]), F.array("end"))
    return cut.join(if_small(names), "sid").select(
        "shard", "slot", "source", "block", F.least("full", "words").alias("n_words"),
        F.array_distinct(F.transform("pieces", lambda p: p["doc_id"])).alias("doc_ids"), F.array_join(body, "\n\n").alias("text"))
