"""LM scoring: masked pseudo-likelihood from a bidirectional window network, trained in numpy over all documents.

Every word is predicted from the two words on each side. The output is two softmaxes: the word's class, and the word
within its class. Rarer words share entries by hash; which word of its entry it is, is a third level, by the counts of
all words, which stay in Spark. Partitions train on their own words and their networks are averaged, round after round.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.blocks import MODEL_BLOCK, Prefix, blocks, mix, words
from fieldglass.llm.frames import settle, unused
from fieldglass.llm.marks import is_marked, key_marks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLASSES, WITHIN = 32, 64
VOCABULARY = CLASSES * WITHIN
#: rarer words share so many entries, by hash
RARE = 256
WIDTH, HIDDEN = 16, 32
SIDES = (-2, -1, 1, 2)
#: training rounds; every word of every document is masked and predicted in one of them
ROUNDS = 2
BATCH = 2048
RATE = 0.05
SEED = 23
#: outputs of up to this size either way have an exp, and sums of them, that 32 bits hold
LARGE = 60
#: networks that are averaged by one task at a time
FAN_IN = 64
#: words beyond the vocabulary whose counts go to every task; the counts of rarer ones are joined
HEAD = 1 << 18
SLICES = 16

SHAPES = {"embed": (VOCABULARY + 1, WIDTH), "hidden": (WIDTH * len(SIDES), HIDDEN), "bias": (HIDDEN,),
          "classes": (HIDDEN, CLASSES), "class_bias": (CLASSES,), "inner": (CLASSES, HIDDEN, WITHIN), "inner_bias": (CLASSES, WITHIN)}


def hashed_words(texts: pa.Array):
    for row, data, offsets in blocks(texts, MODEL_BLOCK):
        starts, ends, first = words(data, offsets)
        yield row, mix(Prefix(data).ranges(starts, ends)), first


# --- vocabulary ----------------------------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.unique(h, return_counts=True) for _, h, _ in hashed_words(batch.column(0))]
        if not parts:
            continue
        every, n = (np.concatenate(x) for x in zip(*parts))
        kinds, kind = np.unique(every, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(kind, n, len(kinds)).astype(np.int64))], names=["word", "n"])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of every word of all documents, written."""
    return settle(docs.select(F.col(text)).mapInArrow(_count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the frequent words by rank, one more than each entry's count): entries of rare words count all of theirs."""
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - RARE).toArrow()
    sums = counts.groupBy(F.pmod("word", F.lit(RARE)).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    frequent, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.float64)
    entries = np.full(VOCABULARY, 1.0)
    entries[: len(n)] += n
    rare = entries[VOCABULARY - RARE:]
    rare[sums.column("bucket").to_numpy().astype(np.int64)] += sums.column("n").to_numpy()
    np.subtract.at(rare, (frequent % np.uint64(RARE)).astype(np.int64), n)
    return frequent, entries


class Words:
    """Word hashes to entries: frequent words by rank, all others by hash into the rare ones."""

    def __init__(self, frequent: np.ndarray):
        self.order = np.argsort(frequent)
        self.sorted = frequent[self.order]

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        rare = VOCABULARY - RARE + (hashes % np.uint64(RARE)).astype(np.int64)
        if not len(self.sorted):
            return rare
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], rare)


def contexts(entries: np.ndarray, first: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The entries around each of the words from ``start`` to ``stop``, in two bytes; outside the document the blank entry."""
    stop = len(entries) if stop is None else stop
    out = np.full((stop - start, len(SIDES)), VOCABULARY, np.uint16)
    reach = max(SIDES)
    edges = first[np.searchsorted(first, start - reach): np.searchsorted(first, stop + reach, "right")]
    for k, step in enumerate(SIDES):
        a, b = max(start, -step), min(stop, len(entries) - step)
        if b > a:
            out[a - start: b - start, k] = entries[a + step: b + step]
        for j in range(abs(step)):  # the words so near an edge that the step goes beyond it
            at = edges + j if step < 0 else edges - 1 - j
            out[at[(at >= start) & (at < stop)] - start, k] = VOCABULARY
    return out


# --- the network ---------------------------------------------------------------------------------------------------

def new_network(entries: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    net = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    grid = entries.reshape(CLASSES, WITHIN)
    net["class_bias"] = np.log(grid.sum(1) / grid.sum()).astype(np.float32)
    net["inner_bias"] = np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32)
    net["bias"] = np.zeros(HIDDEN, np.float32)
    return net


def pack(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].reshape(-1) for k in SHAPES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[k] = flat[at: at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def _exps(z: np.ndarray) -> np.ndarray:
    """exp(z) in place; the sums of its rows."""
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], np.float32)


def _bounded(z: np.ndarray) -> np.ndarray:
    """In place: rows are moved to a greatest number of 0, which leaves their softmax as it is, where exp or a sum could leave the range."""
    if not (z.max(initial=0) < LARGE and z.min(initial=0) > -LARGE):
        z -= z.max(1, keepdims=True)
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place."""
    sums = _exps(_bounded(z))
    z /= sums[:, None]
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = _bounded(z)[np.arange(len(at)), at]
    return own - np.log(_exps(z))


def _sorted_kinds(values: np.ndarray) -> np.ndarray:
    """The stable order of entries or classes; 16 bits are sorted by digits."""
    return np.argsort(values.astype(np.uint16), kind="stable")


def _hidden(net, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = net["embed"].take(around.reshape(-1), axis=0).reshape(len(around), -1)
    h = x @ net["hidden"]
    h += net["bias"]
    return x, np.tanh(h, out=h)


def _by_class(kind: np.ndarray) -> list[tuple[int, int, int]]:
    """(class, start, end) of the classes that occur among sorted ones."""
    edges = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    return [(c, a, b) for c, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def _inner(net, h: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The outputs within the class of each row."""
    z = np.empty((len(h), WITHIN), np.float32)
    for c, a, b in spans:
        np.matmul(h[a:b], net["inner"][c], out=z[a:b])
        z[a:b] += net["inner_bias"][c]
    return z


def log_probability(net: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(word | words around it)."""
    order = _sorted_kinds(target // WITHIN)
    _, h = _hidden(net, around[order])
    kind, inner = target[order] // WITHIN, target[order] % WITHIN
    z = h @ net["classes"]
    z += net["class_bias"]
    own = _log_softmax_at(z, kind).astype(np.float64)
    own += _log_softmax_at(_inner(net, h, _by_class(kind)), inner)
    out = np.empty(len(target))
    out[order] = own
    return out


def _descend(values: np.ndarray, grads: np.ndarray, seen: np.ndarray) -> None:
    """Steps scaled by each parameter's own history (Adagrad), all in place."""
    scale = grads * grads
    seen += scale
    np.sqrt(seen, out=scale)
    grads /= scale
    grads *= np.float32(RATE)
    values -= grads


def train_step(net: dict[str, np.ndarray], seen: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray) -> None:
    """One step of gradient descent."""
    n = len(target)
    order = _sorted_kinds(target // WITHIN)
    around, target = around[order], target[order]
    x, h = _hidden(net, around)
    kind, inner, rows = target // WITHIN, target % WITHIN, np.arange(n)
    spans = _by_class(kind)
    d = h @ net["classes"]
    d += net["class_bias"]
    d, e = _softmax(d), _softmax(_inner(net, h, spans))
    d[rows, kind] -= 1
    e[rows, inner] -= 1
    grads = {"classes": h.T @ d, "class_bias": d.sum(0), "inner": np.zeros(SHAPES["inner"], np.float32), "inner_bias": np.zeros(SHAPES["inner_bias"], np.float32)}
    back = d @ net["classes"].T
    for c, a, b in spans:
        np.matmul(h[a:b].T, e[a:b], out=grads["inner"][c])
        grads["inner_bias"][c] = e[a:b].sum(0)
        back[a:b] += e[a:b] @ net["inner"][c].T
    back *= 1 - h * h
    grads["hidden"], grads["bias"] = x.T @ back, back.sum(0)
    to_words = (back @ net["hidden"].T).reshape(-1, WIDTH)
    flat = around.reshape(-1)
    order = _sorted_kinds(flat)
    flat = flat[order]
    at = np.flatnonzero(np.diff(flat, prepend=-1))
    kinds, rows = flat[at], np.add.reduceat(to_words.take(order, axis=0), at, axis=0)
    for k, g in grads.items():
        g /= np.float32(n)
        _descend(net[k], g, seen[k])
    rows /= np.float32(n)
    values, history = net["embed"][kinds], seen["embed"][kinds]
    _descend(values, rows, history)
    net["embed"][kinds], seen["embed"][kinds] = values, history


def masked(hashes: np.ndarray, first: np.ndarray, own: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """The words that are predicted in a round, by hash of the word, its place and the document's key ``own``.

    The rounds together predict each word once.
    """
    place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    draw = mix(hashes + mix(place.astype(np.uint64) + np.uint64(SEED)) + np.repeat(mix(own.astype(np.int64).view(np.uint64)), np.diff(first)))
    return np.flatnonzero(draw % np.uint64(rounds) == np.uint64(turn))


def _train(start: np.ndarray, turn: int, rounds: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, n = unpack(start.copy()), 0
        seen = {k: np.full(s, 1e-6, np.float32) for k, s in SHAPES.items()}
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for row, entries, first in coded_words(batch.column(0)):
                at = masked(entries.astype(np.uint64), first, keys[row: row + len(first) - 1], turn, rounds)
                at = np.random.default_rng([SEED, turn, len(at)]).permutation(at)
                around = contexts(entries, first)
                for k in range(0, len(at), BATCH):
                    own = at[k: k + BATCH]
                    train_step(net, seen, around[own].astype(np.int64), entries[own])
                n += len(at)
        if n:
            flat = pack(net)
            cuts = np.array_split(flat, SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(SLICES)), pa.array(np.full(SLICES, int(mix(flat[:64].view(np.uint64))[0] >> np.uint64(1)), np.int64)),
                 pa.array(np.full(SLICES, float(n))), pa.array([c.tobytes() for c in cuts], pa.binary())], names=["slice", "part", "n", "weights"])

    return train


def _average(batches):
    total, n = None, 0.0
    key = None
    for batch in batches if isinstance(batches, list) else batches:
        key = batch.column("slice")[0].as_py() if key is None and batch.num_rows else key
        order = np.argsort(batch.column("part").to_numpy(), kind="stable")
        for k in order.tolist():
            w = batch.column("n")[k].as_py()
            own = np.frombuffer(batch.column("weights")[k].as_py(), np.float32).astype(np.float64) * w
            total, n = own if total is None else total + own, n + w
    return key, n, total


def _merged(parts: DataFrame) -> np.ndarray:
    """The weighted mean of all networks, by slices and at most about FAN_IN at once."""

    def merge(table: pa.Table) -> pa.Table:
        key, n, total = _average(table.combine_chunks().sort_by("part").to_batches())
        return pa.table({"slice": pa.array([key], pa.int64()), "part": pa.array([table.column("part")[0].as_py()], pa.int64()),
                         "n": pa.array([n]), "weights": pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())})

    schema = "slice bigint, part bigint, n double, weights binary"
    while (most := parts.groupBy("slice").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = -(-most // FAN_IN)
        parts = settle(parts.withColumn("_g", F.pmod(F.xxhash64("part"), F.lit(groups))).groupBy("slice", "_g").applyInArrow(
            lambda table: merge(table.drop_columns(["_g"])), schema), "network")
    rows = parts.orderBy("slice").toArrow()
    return np.concatenate([np.frombuffer(w, np.float32) for w in rows.column("weights").to_pylist()]) if rows.num_rows else np.zeros(0, np.float32)


def coded_words(codes: pa.Array):
    """(first row, entries, each row's first word) by block, of rows of two-byte entries."""
    for row, data, offsets in blocks(codes, MODEL_BLOCK):
        yield row, np.frombuffer(data.tobytes(), np.uint16).astype(np.int64), offsets // 2


def _fit(coded: DataFrame, codes: str, entries: np.ndarray, rounds: int, key: str) -> np.ndarray:
    net = pack(new_network(entries))
    for turn in range(rounds):
        parts = settle(coded.select(F.col(codes), F.xxhash64(F.col(f"`{key}`"))).mapInArrow(
            _train(net, turn, rounds), "slice bigint, part bigint, n double, weights binary"), "networks")
        new = _merged(parts)
        net = new if len(new) else net
    return net


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, key: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """(frequent words, network): the vocabulary counts, and training predicts, every word of every document once."""
    counts = word_counts(docs, text)
    frequent, entries = vocabulary(counts)
    coded, names = _coded(docs, text, frequent, entries, head_words(counts), None)
    return frequent, _fit(coded, names["codes"], entries, rounds, key)


def score_texts(texts: pa.Array, net: dict[str, np.ndarray], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """(words, summed log-probability of every word's entry given the words around it) of each text."""
    n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for row, hashes, first in hashed_words(texts):
        n[row: row + len(first) - 1], total[row: row + len(first) - 1] = _summed(known.entries(hashes), first, net)
    return n, total


def _summed(entries: np.ndarray, first: np.ndarray, net: dict[str, np.ndarray], step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(words, summed log-probability) of each row of a block of entries."""
    own = np.zeros(len(entries) + 1)
    for k in range(0, len(entries), step):
        end = min(k + step, len(entries))
        own[k + 1: end + 1] = log_probability(net, contexts(entries, first, k, end).astype(np.int64), entries[k:end])
    sums = np.cumsum(own)
    return np.diff(first), sums[first[1:]] - sums[first[:-1]]


# --- rare words ----------------------------------------------------------------------------------------------------

class Head:
    """The log counts of the most frequent words, ``HEAD`` at most; every word with a count of ``least`` or more is there."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, least: float):
        order = np.argsort(hashes)
        self.hashes, self.logs, self.least = hashes[order], np.log(counts[order]).astype(np.float32), least

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the head holds each word, where)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, at


def head_words(counts: DataFrame, most: int = HEAD) -> Head:
    """The words from some count on, that count being the least (to a sixteenth of an octave) with ``most`` words at most."""
    octave = F.floor(F.log2("n") * 16)
    sizes = counts.where("n > 1").groupBy(octave.alias("octave")).count().orderBy(F.desc("octave")).collect()  # some hundred rows
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["octave"]
    if least is None:
        return Head(np.zeros(0, np.uint64), np.zeros(0), 2.0 ** 60 if sizes else 2.0)
    rows = counts.where((F.col("n") > 1) & (octave >= least)).toArrow()
    whole = least == sizes[-1]["octave"]
    return Head(rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy(), 2.0 if whole else 2.0 ** (least / 16))


def _coded(docs: DataFrame, text: str, frequent: np.ndarray, sizes: np.ndarray, head: Head, marks: np.ndarray | None) -> tuple[DataFrame, dict[str, str]]:
    """(docs with a struct more, written; the names of its parts): words are hashed once, and later passes read entries.

    ``codes`` has a text's entries in two bytes each; ``known`` the summed log shares of rare words in their entries as far
    as the head knows their counts; ``tail`` the other rare words that are marked, repeats included.
    """
    logs = np.log(sizes)

    @F.arrow_udf("codes binary, known double, tail array<bigint>")
    def encode(texts: pa.Array) -> pa.Array:
        words_of = Words(frequent)
        codes, known, tails, lengths = [], [], [], []
        for _, hashes, first in hashed_words(texts):
            entries = words_of.entries(hashes)
            raw = entries.astype(np.uint16).tobytes()
            codes += [raw[2 * a: 2 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            rare = np.flatnonzero(entries >= VOCABULARY - RARE)
            kinds, kind = np.unique(hashes[rare], return_inverse=True)
            held, at = head.places(kinds)
            share = np.zeros(len(hashes) + 1)
            share[rare + 1] = (np.where(held, head.logs[at], 0.0) if len(head.logs) else np.zeros(len(kinds)))[kind] - logs[entries[rare]]
            sums = np.cumsum(share)
            known.append(sums[first[1:]] - sums[first[:-1]])
            if marks is None:
                lengths.append(np.zeros(len(first) - 1, np.int64))
                continue
            open_ = ~held & is_marked(kinds.view(np.int64), marks)
            mine = rare[open_[kind]]
            tails.append(hashes[mine].view(np.int64))
            lengths.append(np.diff(np.searchsorted(mine, first)))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32) if lengths else np.zeros(1, np.int32)
        tail = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tails) if tails else np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays([pa.array(codes, pa.binary()), pa.array(np.concatenate(known) if known else np.zeros(0)), tail],
                                          names=["codes", "known", "tail"])

    found, *parts = unused(docs, "coded", "codes", "known", "tail", "own_text")
    names = dict(zip(("codes", "known", "tail", "own"), parts))
    coded = docs.withColumn(found, encode(F.col(f"`{text}`"))).withColumns(
        {names[c]: F.col(found)[c] for c in ("codes", "known", "tail")} | {names["own"]: _own(text)}).drop(found)
    return settle(coded, "coded-texts"), names


def tail_words(counts: DataFrame, head: Head) -> DataFrame | None:
    """(word, n) of the words that occur again but are not in the head; None if there are none.

    Words that occur once add log 1 = 0: a bitmap of fixed size keeps nearly all of them out of the shuffle.
    """
    if head.least <= 2.0:
        return None
    return counts.where((F.col("n") > 1) & (F.floor(F.log2("n") * 16) < F.floor(F.log2(F.lit(head.least)) * 16 + 1e-6)))


def tail_levels(coded: DataFrame, names: dict[str, str], tail: DataFrame) -> DataFrame:
    """(own, level): the summed log count of a text's tail words, own being the text's hash; of copies the mean, so that of one."""
    rows = coded.where(F.size(names["tail"]) > 0).select(F.col(names["own"]).alias("own"), F.explode(F.concat(names["tail"], F.array(F.lit(None).cast("long")))).alias("word"))
    logs = tail.select(F.col("word").alias("tail_word"), F.log("n").alias("log_n"))
    return rows.join(logs, F.col("word") == F.col("tail_word"), "left").groupBy("own").agg(
        (F.sum(F.coalesce("log_n", F.lit(0.0))) / F.count_if(F.col("word").isNull())).alias("level"))


def _own(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def lm_scores(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_tokens``, ``log_likelihood`` (pseudo, summed) and ``lm_score`` (per word); such columns are replaced.

    A word that shares its entry with others has the entry's probability times its share of the entry's words in all
    documents, n / (words of the entry + 1); the rest is for words never seen.

    Every word is predicted once in training, in one of the rounds; ``key`` (nulls and repeats may be) only spreads the
    words of copies over the rounds.

    Very long texts are worked on in a block of their own; ties don't matter; other columns are kept, whatever their names.
    Null and empty texts have 0 words, log-likelihood 0 and a null score. Repeated rows get the same score (to
    rounding); an empty table gives an empty one. Scores of another layout of the same rows differ slightly, as partitions train apart.
    """
    docs = docs.drop("n_tokens", "log_likelihood", "lm_score")
    counts = word_counts(docs, text)
    frequent, entries = vocabulary(counts)
    head = head_words(counts)
    tail = tail_words(counts, head)
    coded, names = _coded(docs, text, frequent, entries, head, key_marks(tail, "word") if tail is not None else None)
    flat = _fit(coded, names["codes"], entries, rounds, key)

    @F.arrow_udf("n bigint, total double")
    def score(codes: pa.Array) -> pa.Array:
        net, parts = unpack(flat), [(np.zeros(0, np.int64), np.zeros(0))]
        parts += [_summed(own, first, net) for _, own, first in coded_words(codes)]
        n, total = (np.concatenate(x) for x in zip(*parts))
        return pa.StructArray.from_arrays([pa.array(n), pa.array(total)], names=["n", "total"])

    found, of_text, level = unused(coded, "scored", "of_text", "level")
    scored, more = coded.withColumn(found, score(F.col(names["codes"]))), F.lit(0.0)
    if tail is not None:
        named = tail_levels(coded, names, tail).select(F.col("own").alias(of_text), F.col("level").alias(level))
        scored = scored.join(named, F.col(names["own"]) == F.col(of_text), "left")
        more = F.coalesce(level, F.lit(0.0))
    whole = F.col(found)["total"] + F.col(names["known"]) + more
    return (
        scored.withColumn("n_tokens", F.col(found)["n"]).withColumn("log_likelihood", whole)
        .withColumn("lm_score", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
        .drop(found, of_text, level, *names.values())
    )
