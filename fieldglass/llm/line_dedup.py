"""Line dedup: lines found in several documents stay in the smallest doc_id that holds them.

Line hashes are range-partitioned with (document, position) as secondary order, so that a line found in a third of all
documents is spread over many partitions; each partition streams its rows once and passes on what it can't know alone.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.blocks import Ranges, blocks, lines, mix, per_row, slices, words
from fieldglass.llm.frames import settle, text_key, unused

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_CHARS = 10
LAST = (1 << 63) - 1  # a document without an id comes after all others

LINE = "h1 bigint, h2 bigint, doc bigint, t1 bigint, t2 bigint, pos int, n_lines int"


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def block_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """(row, place, 61 bits, 61 bits more) of the lines of a block whose keys are long enough to count."""
    data = LOWER[data]
    start, end, row = lines(data, offsets)
    place = np.arange(len(row)) - np.searchsorted(row, row)
    begins, stops, _ = words(data, offsets)
    first, last = np.searchsorted(begins, start), np.searchsorted(begins, end)
    full = np.flatnonzero(last > first)  # a key runs from the line's first word to the end of its last
    row, place, low, high = row[full], place[full], begins[first[full]], stops[last[full] - 1]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = np.flatnonzero(chars[high] - chars[low] >= min_chars)
    low, high = low[long], high[long]
    return row[long], place[long], mix(Ranges(data).of(low, high)), mix(Ranges(data, seed=2).of(low, high))


def _hash_lines(min_chars: int):
    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, t1, t2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for first, data, offsets in blocks(batch.column(3)):
                row, place, h1, h2 = block_keys(data, offsets, min_chars)
                n_lines = 1 + per_row(data == 10, offsets)
                own = first + row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc[own]), pa.array(t1[own]), pa.array(t2[own]),
                     pa.array(place.astype(np.int32)), pa.array(n_lines[row].astype(np.int32))],
                    names=["h1", "h2", "doc", "t1", "t2", "pos", "n_lines"])

    return hash_lines


def _line_rows(docs: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    t1, t2 = text_key(F.col(text))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), t1.alias("t1"), t2.alias("t2"), F.col(text).alias("text"))
    return rows.mapInArrow(_hash_lines(min_chars), LINE)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted range: lines of other documents than the run's first are dropped ('drop').

    The first run may go on from an earlier partition, so the lines of its first document are passed on ('head'), as is
    the first document of the last run ('tail'); comparing them over partitions decides the rest.
    """
    names = ["h1", "h2", "doc", "t1", "t2", "pos", "n_lines"]
    run: tuple | None = None  # (h1, h2) of the run that goes on, its first document, whether it began the partition

    def made(kind: str, columns: list[np.ndarray], pick: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(int(pick.sum()), kind, object), pa.string()), *[pa.array(c[pick]) for c in columns]], names=["kind", *names])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        h1, h2, doc = columns[:3]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        goes_on = run is not None and run[0] == (h1[0], h2[0])
        opening = run is None or (goes_on and run[2])
        new[0] = not goes_on
        at = np.flatnonzero(new)
        owner = np.empty(len(doc), np.int64)
        lead = int(at[0]) if len(at) else len(doc)
        if lead:
            owner[:lead] = run[1]
        if len(at):
            owner[lead:] = np.repeat(doc[at], np.diff(np.append(at, len(doc))))
        end_of_first = (lead if goes_on else (int(at[1]) if len(at) > 1 else len(doc))) if opening else 0
        yield made("drop", columns, doc != owner)
        head = np.zeros(len(doc), bool)
        head[:end_of_first] = (doc == owner)[:end_of_first]
        if head.any():
            yield made("head", columns, head)
        run = ((h1[-1], h2[-1]), int(owner[-1]), opening and end_of_first == len(doc))
        last = columns
    if last is not None:
        tail = [c[-1:].copy() for c in last]
        tail[2][:] = run[1]
        yield made("tail", tail, np.ones(1, bool))


def keep_bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, t1, t2, n_lines, keep): a compressed bitmap, one bit a line, for each document that loses lines."""
    rows = settle(_line_rows(docs, text, key, min_chars), "lines")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["h1", "h2", "doc", "t1", "t2", "pos"]
    streamed = settle(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream, f"kind string, {LINE}"),
        "line-stream")
    edges = streamed.where("kind <> 'drop'")
    owners = edges.groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
    late = edges.where("kind = 'head'").join(owners, ["h1", "h2"]).where("doc > owner")
    lost = ["doc", "t1", "t2", "n_lines", "pos"]
    return (
        streamed.where("kind = 'drop'").select(*lost).unionByName(late.select(*lost))
        .groupBy("doc", "t1", "t2", "n_lines").agg(F.collect_set("pos").alias("lost"))
        .select("doc", "t1", "t2", "n_lines", _bitmap(F.col("lost"), F.col("n_lines")).alias("keep"))
    )


def _bitmap(lost: Column, n_lines: Column) -> Column:
    @F.arrow_udf("binary")
    def pack(lost: pa.Array, n_lines: pa.Array) -> pa.Array:
        out = []
        for gone, n in zip(lost, n_lines.to_pylist()):
            keep = np.ones(n, bool)
            keep[np.asarray(gone.values)] = False
            out.append(zlib.compress(np.packbits(keep).tobytes()))
        return pa.array(out, pa.binary())

    return pack(lost, n_lines)


def _kept(text: Column, keep: Column) -> Column:
    """The text's lines whose bit is set, and their number; without a bitmap only the number of lines."""

    @F.arrow_udf("kept string, n_lines bigint, n_dropped bigint")
    def apply(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
        kind = pa.struct([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
        done = [pa.array([], kind)]
        for row, own in slices(texts):
            kept, n_lines, dropped = [], [], []
            for text, bits in zip(own.to_pylist(), bitmaps.slice(row, len(own)).to_pylist()):
                if bits is None:
                    kept.append(text), n_lines.append(text.count("\n") + 1), dropped.append(0)
                    continue
                parts = text.split("\n")
                flags = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(parts)).tolist()
                left = [p for p, f in zip(parts, flags) if f]
                kept.append("\n".join(left)), n_lines.append(len(parts)), dropped.append(len(parts) - len(left))
            done.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip((kept, n_lines, dropped), kind)], names=[f.name for f in kind]))
        return pa.concat_arrays(done)

    return apply(text, keep)


def drop_repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``; columns of these names are replaced.

    A line's key is the line without white space at both ends, A-Z in lower case. Keys of at least ``min_chars`` code
    points that several documents hold lose all their lines except in the smallest id.

    Null and empty texts are one empty line. Rows that share an id are one document: they keep the lines that only they
    have, and all of them when it is the smallest. Rows without an id are one document that comes last. Repeated rows
    get the same result; an empty table gives an empty one. Very long texts are cut into lines whole. ``kept_text`` of a null
    text is empty. Other columns are kept, whatever their names.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    doc, own_1, own_2, map_doc, map_1, map_2, keep, done = unused(docs, "_doc", "_t1", "_t2", "_d", "_m1", "_m2", "_keep", "_done")
    maps = keep_bitmaps(docs, text, key, min_chars).select(
        F.col("doc").alias(map_doc), F.col("t1").alias(map_1), F.col("t2").alias(map_2), F.col("keep").alias(keep))
    t1, t2 = text_key(F.col(text))
    marked = docs.withColumns({doc: F.coalesce(F.col(key).cast("long"), F.lit(LAST)), own_1: t1, own_2: t2})
    joined = marked.join(maps, (F.col(doc) == F.col(map_doc)) & (F.col(own_1) == F.col(map_1)) & (F.col(own_2) == F.col(map_2)), "left")
    return (
        joined.withColumn(done, _kept(F.col(text), F.col(keep)))
        .select(*[docs[c] for c in docs.columns], F.col(f"{done}.kept").alias("kept_text"), F.col(f"{done}.n_lines").alias("n_lines"),
                F.col(f"{done}.n_dropped").alias("n_dropped"))
    )
