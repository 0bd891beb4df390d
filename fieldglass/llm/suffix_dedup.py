"""Suffix-array dedup: every byte that lies in a repeated string of 200 bytes goes.

A window (200 bytes) is named by the least hash of its short strings, so equal windows have equal names, and consecutive
windows mostly share one: a *run*. Runs whose name occurs once can't repeat. Where all runs of a name have the same
bytes, all of them repeat. Only the bytes of the other runs are moved: the runs of a name meet in one group, where a
mergesort of the windows' suffixes, compared by prefix hashes and binary search, puts equal windows side by side.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.blocks import BLOCK, Prefix, blocks, mix
from fieldglass.llm.frames import settle, text_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
#: bytes of the short strings that name a window
SHORT = 48
#: bytes of the strings that name the windows of a run anew when too many runs share its name
FINE = 168
#: different runs of one name that are sorted by one task; a name with more is split by finer names, and one that is
#: still too common is dealt to several tasks, which compare digests
GROUP_RUNS = 8192
#: bytes of whole groups that are sorted at once, rows of a batch that are Python objects at once, and windows compared at once
GROUP_BYTES, ROWS, WINDOWS = 1 << 19, 1024, 2000


def _forward_backward(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values, in a fixed number of passes."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def block_runs(data: np.ndarray, offsets: np.ndarray, length: int, short: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, name, content hash, whether a window may recur inside) of a block's runs."""
    width = length - short + 1
    hashed = Prefix(data)
    small = mix(hashed.windows(short))
    if len(data) < length:
        small = small[:0]
    names = _forward_backward(small, width) if len(small) else small
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(names)]
    inside = np.arange(len(names)) + length <= offsets[row + 1]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (row[1:] != row[:-1])
    new &= inside
    starts = np.flatnonzero(new)
    at = np.searchsorted(starts, np.flatnonzero(inside), "right") - 1
    n = np.bincount(at, minlength=len(starts))
    again = np.zeros(len(names), np.int64)
    if len(names):
        again[1:] = (small[width: width + len(names) - 1] == names[1:]) & ~new[1:] & inside[1:]
    recurs = np.add.reduceat(again, starts) > 0 if len(starts) else np.zeros(0, bool)
    content = mix(Prefix(data, seed=2).ranges(starts, starts + n + length - 1) + n.astype(np.uint64))
    return row[starts], starts - offsets[row[starts]], n, names[starts], content, recurs


RUN = "k1 bigint, k2 bigint, start bigint, n bigint, name bigint, content bigint, recurs boolean"


def _run_rows(k1, k2, start, n, name, content, recurs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(k1), pa.array(k2), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(name.view(np.int64)),
         pa.array(content.view(np.int64)), pa.array(recurs)], names=["k1", "k2", "start", "n", "name", "content", "recurs"])


def _runs(length: int, short: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, data, offsets in blocks(batch.column(2)):
                row, start, n, name, content, recurs = block_runs(data, offsets, length, short)
                yield _run_rows(k1[first + row], k2[first + row], start, n, name, content, recurs)

    return runs


# --- the suffix sort -----------------------------------------------------------------------------------------------

class Suffixes:
    """Suffixes of a block of bytes, compared up to ``limit`` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, limit: int):
        self.data, self.limit = data, limit
        self.hashed = Prefix(data, seed=4)
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.head = np.zeros(len(data), np.uint64)
        for k in range(8):
            self.head = (self.head << np.uint64(8)) | padded[k: k + len(data)]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, at most ``limit``: binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.limit, np.int64)
        whole = self.hashed.ranges(a, a + self.limit) == self.hashed.ranges(b, b + self.limit)
        low[whole] = self.limit
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_] + 1) // 2
            x, y = a[open_], b[open_]
            equal = self.hashed.ranges(x, x + middle) == self.hashed.ranges(y, y + middle)
            low[open_[equal]] = middle[equal]
            high[open_[~equal]] = middle[~equal] - 1
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b; equal ones don't."""
        out = self.head[a] < self.head[b]
        tied = np.flatnonzero(self.head[a] == self.head[b])
        if tied.size:
            x, y = a[tied], b[tied]
            size = self.common(x, y)
            ends = size >= self.limit
            at = np.where(ends, 0, size)
            out[tied] = ~ends & (self.data[x + at] < self.data[y + at])
        return out

    def sort(self, starts: np.ndarray) -> np.ndarray:
        """``starts`` in the order of their suffixes: a bottom-up mergesort, all merges of a level at once.

        Each element's place in a merge is its own index plus its rank in the other half, found by binary search.
        """
        n, order, width = len(starts), starts[np.argsort(self.head[starts], kind="stable")], 1
        # Suffixes whose first bytes differ are in order already: only ties are merged.
        edges = np.flatnonzero(np.concatenate([[True], self.head[order][1:] != self.head[order][:-1]])) if n else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, n)))
        begin, end = edges[group], np.append(edges, n)[group + 1]
        largest = int(np.diff(np.append(edges, n)).max()) if n else 0
        index = np.arange(n)
        while width < largest:
            busy = np.flatnonzero(end - begin > width)
            i, b, e = index[busy], begin[busy], end[busy]
            part = (i - b) // width
            mine = b + part * width
            twin_from = np.minimum(b + (part ^ 1) * width, e)
            twin_to = np.minimum(twin_from + width, e)
            left = part % 2 == 0
            low, high = twin_from.copy(), twin_to.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                own, other = order[i[open_]], order[middle]
                # a left element comes after the right ones that are less; a right one after the left ones not greater
                past = np.where(left[open_], self.before(other, own), ~self.before(own, other))
                low[open_[past]] = middle[past] + 1
                high[open_[~past]] = middle[~past]
            to = np.where(left, mine, twin_from) + (i - mine) + (low - twin_from)
            moved = order.copy()
            moved[to] = order[i]
            order, width = moved, width * 2
        return order

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the first ``limit`` bytes are the same, by the bytes themselves."""
        out = np.zeros(len(a), bool)
        steps = np.arange(self.limit)
        for k in range(0, len(a), WINDOWS):
            x, y = a[k: k + WINDOWS, None] + steps, b[k: k + WINDOWS, None] + steps
            out[k: k + WINDOWS] = (self.data[x] == self.data[y]).all(1)
        return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each window occurs twice among ``starts``, whether it is its kind's first).

    A window whose hash no other has can't repeat; the others are sorted as suffixes, and neighbours whose common
    extension is the whole window are confirmed byte by byte.
    """
    table = Suffixes(data, length)
    own = table.hashed.ranges(starts, starts + length)
    order = np.argsort(own, kind="stable")
    tied = own[order][1:] == own[order][:-1]
    maybe = np.zeros(len(starts), bool)
    maybe[order[1:][tied]] = True
    maybe[order[:-1][tied]] = True
    place = np.full(len(data), -1, np.int64)
    place[starts] = np.arange(len(starts))
    ranked = table.sort(starts[maybe])
    a, b = ranked[:-1], ranked[1:]
    near = np.flatnonzero(table.common(a, b) >= length) if len(a) else np.zeros(0, np.int64)
    near = near[table.equal(a[near], b[near])]
    twice, first = np.zeros(len(starts), bool), np.ones(len(starts), bool)
    twice[place[a[near]]] = True
    twice[place[b[near]]] = True
    first[place[b[near]]] = False
    return twice, first


def _group(length: int):
    """Of the runs of names: their repeated windows ('span'), and digests where other tasks have runs of the name."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            k1, k2, start, n, shared, raw = ([x[i] for x in held] for i in range(1, 7))
            data = np.frombuffer(b"".join(raw), np.uint8)
            base = np.cumsum([0, *map(len, raw)])
            run = np.repeat(np.arange(len(held)), n)
            inner = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
            starts = base[run] + inner
            twice, first = repeated_windows(data, starts, length)
            out = ([], [], [], [], [])
            # consecutive repeated windows of a run are one span
            opens = twice.copy()
            opens[1:] &= ~(twice[:-1] & (run[1:] == run[:-1]))
            closes = twice.copy()
            closes[:-1] &= ~(twice[1:] & (run[1:] == run[:-1]))
            for i, j in zip(np.flatnonzero(opens).tolist(), np.flatnonzero(closes).tolist()):
                r = int(run[i])
                for column, value in zip(out, (k1[r], k2[r], start[r] + int(inner[i]), j - i + 1, None)):
                    column.append(value)
            flag = np.array(shared, bool)[run] & first
            whole = data.tobytes()
            for i in np.flatnonzero(flag).tolist():
                r, s = int(run[i]), int(starts[i])
                digest = hashlib.blake2b(whole[s: s + length], digest_size=16).digest()
                # a window already known to repeat speaks for others only: 0 windows
                for column, value in zip(out, (k1[r], k2[r], start[r] + int(inner[i]), 0 if twice[i] else 1, digest)):
                    column.append(value)
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.binary())],
                                              names=["k1", "k2", "start", "n", "digest"])

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                for row in zip(*[column.to_pylist() for column in batch.slice(k, ROWS).columns[:7]]):
                    if held and row[0] != held[-1][0] and size >= GROUP_BYTES:
                        yield done()
                        held, size = [], 0
                    held.append(row)
                    size += len(row[6])
        if held:
            yield done()

    return group


def _cut_runs(length: int):
    """The bytes of a document's runs: (bucket, k1, k2, start, n, shared, raw)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in blocks(batch.column(2)):
                k1, k2, runs = (batch.column(i).slice(first, len(offsets) - 1).to_pylist() for i in (0, 1, 3))
                out = ([], [], [], [], [], [], [])
                size = 0
                for a, b, begin, end, own in zip(k1, k2, offsets.tolist(), offsets[1:].tolist(), runs):
                    for r in own:
                        piece = data[begin + r["start"]: min(end, begin + r["start"] + r["n"] + length - 1)].tobytes()
                        size += len(piece)
                        for column, value in zip(out, (r["name"], a, b, r["start"], r["n"], r["shared"], piece)):
                            column.append(value)
                    if size > BLOCK:
                        yield _made(out)
                        out, size = ([], [], [], [], [], [], []), 0
                yield _made(out)

    def _made(out) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                          names=["name", "k1", "k2", "start", "n", "shared", "raw"])

    return cut


def _without(length: int):
    """What is left of each text: n_bytes, n_removed, n_spans, kept."""

    @F.arrow_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        parts = [pa.array([], kind)]
        for first, data, offsets in blocks(texts):
            out = ([], [], [], [])
            for begin, end, own in zip(offsets.tolist(), offsets[1:].tolist(), spans.slice(first, len(offsets) - 1)):
                raw = data[begin: end]
                if not own.is_valid or not len(own):
                    values = len(raw), 0, 0, raw.tobytes()
                else:
                    found = own.values
                    starts, n = found.field("start").to_numpy(), found.field("n").to_numpy()
                    marks = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(marks, starts, 1)
                    np.add.at(marks, starts + n + length - 1, -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    opens = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    values = len(raw), int(gone.sum()), opens, raw[~gone].tobytes()
                for column, value in zip(out, values):
                    column.append(value)
            parts.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind)], names=[f.name for f in kind]))
        return pa.concat_arrays(parts)

    return without


def _fine_runs(length: int, fine: int):
    """The runs of documents' runs under finer names."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut_runs(length)(batches):
            k1, k2, start = (batch.column(c).to_numpy() for c in ("k1", "k2", "start"))
            for first, data, offsets in blocks(batch.column("raw")):
                row, inner, n, name, content, recurs = block_runs(data, offsets, length, fine)
                own = first + row
                yield _run_rows(k1[own], k2[own], start[own] + inner, n, name, content, recurs)

    return runs


def _sift(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What names and contents tell: (spans of runs that all repeat, kinds of runs to compare with the number of the name's).

    A name of one run can't repeat, unless a window may recur inside the run. Runs of a name that all have the same
    bytes repeat as they are, and so do twins among others; one of each kind is left to be compared with other kinds.
    """
    names = (
        runs.groupBy("name").agg(F.count(F.lit(1)).alias("runs"), F.min("content").alias("least"), F.max("content").alias("most"),
                                 F.max("recurs").alias("any_recurs"))
        .where("runs > 1 OR any_recurs")
        .select(F.col("name").alias("_name"), (~F.col("any_recurs") & (F.col("least") == F.col("most"))).alias("alike"))
    )
    known = settle(runs.join(names, F.col("name") == F.col("_name")).drop("_name"), "runs")
    mixed = settle(known.where("NOT alike").groupBy("name", "content").agg(
        F.count(F.lit(1)).alias("twins"), F.min(F.struct("k1", "k2", "start", "n")).alias("r")), "mixed")
    twins = known.where("NOT alike").join(
        mixed.where("twins > 1").select(F.col("name").alias("_name"), F.col("content").alias("_content")),
        (F.col("name") == F.col("_name")) & (F.col("content") == F.col("_content")), "left_semi")
    kinds = mixed.groupBy("name").agg(F.count(F.lit(1)).alias("kinds")).withColumnRenamed("name", "_name")
    sized = settle(mixed.join(kinds, F.col("name") == F.col("_name")).select("name", "content", "r.*", "kinds"), "kinds")
    return known.where("alike").unionByName(twins).select("k1", "k2", "start", "n"), sized


def _with_bytes(keyed: DataFrame, kinds: DataFrame) -> DataFrame:
    """(k1, k2, text, runs): the texts that have the wanted runs."""
    wanted = (
        kinds.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.struct("name", "start", "n", "shared").alias("run"))
        .groupBy("p1", "p2").agg(F.collect_list("run").alias("runs"))
    )
    return keyed.join(wanted, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2"))).select("k1", "k2", "text", "runs")


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, short: int = SHORT, fine: int = FINE) -> DataFrame:
    """(k1, k2, start, n): n consecutive windows of a text that occur elsewhere as well.

    A text is keyed by a hash of its id and 64 bits of its own; rows alike in both have the same spans.
    """
    keyed = _keyed(docs, text, key)
    whole = keyed.where(F.octet_length("text") >= length).mapInArrow(_runs(length, short), RUN)
    alike, kinds = _sift(whole)
    common = kinds.where(F.col("kinds") > GROUP_RUNS).withColumn("shared", F.lit(False))
    alike_fine, kinds_fine = _sift(_with_bytes(keyed, common).mapInArrow(_fine_runs(length, fine), RUN))
    wide = F.ceil(F.col("kinds") / GROUP_RUNS)
    left = (
        kinds.where(F.col("kinds") <= GROUP_RUNS).unionByName(kinds_fine).withColumn("shared", F.col("kinds") > GROUP_RUNS)
        .withColumn("name", F.xxhash64("name", F.pmod(F.xxhash64("content"), wide)))
    )
    bytes_of = _with_bytes(keyed, left).mapInArrow(
        _cut_runs(length), "name bigint, k1 bigint, k2 bigint, start bigint, n bigint, shared boolean, raw binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = settle(
        bytes_of.repartition(parts, "name").sortWithinPartitions("name")
        .mapInArrow(_group(length), "k1 bigint, k2 bigint, start bigint, n bigint, digest binary"), "windows")
    across = (
        found.where("digest IS NOT NULL").groupBy("digest")
        .agg(F.count(F.lit(1)).alias("seen"), F.collect_set(F.when(F.col("n") == 1, F.struct("k1", "k2", "start", "n"))).alias("own"))
        .where("seen > 1").select(F.explode("own").alias("w")).select("w.*")
    )
    return alike.unionByName(alike_fine).unionByName(found.where("digest IS NULL").drop("digest")).unionByName(across)


def _keyed(docs: DataFrame, text: str, key: str, *more: str) -> DataFrame:
    t1, t2 = text_key(F.col(text))
    return docs.select(F.xxhash64(F.col(key), t1).alias("k1"), t2.alias("k2"), F.col(text).alias("text"), *more)


def drop_repeated_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, short: int = SHORT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): each text as UTF-8 without the bytes of repeated strings.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another;
    strings are judged on the input. ``kept`` is binary: a cut may fall inside a character.

    Null and empty texts, and texts shorter than ``length``, stay as they are. Repeated rows are copies of each other
    and lose everything that is long enough, so no tie is broken; an empty table gives an empty one. Very long texts are
    judged whole. Other columns are not returned, whatever their names.
    """
    spans = repeated_spans(docs, text, key, length, short, max(short, length * FINE // LENGTH))
    own = (spans.groupBy(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.collect_set(F.struct("start", "n")).alias("spans")))
    keyed = _keyed(docs, text, key, key)
    joined = keyed.join(own, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    return joined.withColumn("x", _without(length)(F.col("text"), F.col("spans"))).select(key, "x.n_bytes", "x.n_removed", "x.n_spans", "x.kept")


__all__ = ["Suffixes", "block_runs", "drop_repeated_bytes", "repeated_spans", "repeated_windows"]
