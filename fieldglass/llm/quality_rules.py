"""Quality rules: document counts, and host verdicts from failure rates shrunk by an empirical beta prior."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.blocks import SPACE, Ranges, blocks, grams, lines, mix, per_row, words
from fieldglass.llm.frames import if_small, same, settle, unused

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

#: words in a window that is looked for a second time
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: a host is rejected when more than this share of its documents is expected to fail
HOST_LIMIT = 0.5


def _block_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    hashed = Ranges(data)
    n_words = np.diff(first)
    letters = ~SPACE[data] & ((data & 0xC0) != 0x80)
    line_from, line_to, line_row = lines(data, offsets)
    full = np.searchsorted(starts, line_to) > np.searchsorted(starts, line_from)
    line_hash, rows = mix(hashed.of(line_from[full], line_to[full])), line_row[full]
    order = np.lexsort((line_hash, rows))
    again = (line_hash[order][1:] == line_hash[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    dup_lines = np.bincount(rows[order][1:][again], minlength=n)

    windows = grams(mix(hashed.of(starts, ends)), WINDOW)
    word_row = np.repeat(np.arange(n), n_words)
    whole = np.arange(len(windows)) + WINDOW <= first[word_row[: len(windows)] + 1]
    at = np.flatnonzero(whole)
    key = mix(windows[at] + mix(word_row[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    twin = key[order][1:] == key[order][:-1]
    repeated = np.zeros(len(at), bool)
    repeated[order[1:][twin]] = True
    repeated[order[:-1][twin]] = True
    steps = np.zeros(len(starts) + 1, np.int64)
    steps[at[repeated]] += 1
    steps[at[repeated] + WINDOW] -= 1
    covered = np.cumsum(steps[:-1]) > 0
    return [n_words, per_row(letters, offsets), per_row(SYMBOLS[data], offsets),
            np.bincount(line_row, minlength=n), dup_lines, per_row(covered, first)]


def text_counts(texts: pa.Array) -> pa.StructArray:
    """The counts of every text; a null text counts as empty."""
    parts = [_block_counts(data, offsets) for _, data, offsets in blocks(texts)]
    columns = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in zip(*parts)] or [np.zeros(0, np.int64)] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=list(COUNTS))


def counted(docs: DataFrame, text: str = "text") -> Column:
    """A struct of the counts of each text."""

    @F.arrow_udf(", ".join(f"{c} bigint" for c in COUNTS))
    def count(texts: pa.Array) -> pa.Array:
        return text_counts(texts)

    return count(docs[text])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_failed() -> Column:
    """The rules beyond the base: too many symbols for the letters, too many repeated lines."""
    return (10 * F.col("n_symbols") > F.col("word_chars")) | (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))


def host_rates(judged: DataFrame, host: str) -> DataFrame:
    """Per host: documents, failures, and the failure rate shrunk towards all hosts' rate.

    The beta prior is fitted to all hosts by moments: its mean is the pooled rate, its spread what the hosts differ
    beyond chance. Hosts that differ no more than chance all get about the pooled rate.
    """
    hosts = settle(judged.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures")), "hosts")
    sums = hosts.agg(F.sum("docs").alias("n"), F.sum("failures").alias("k"), F.count(F.lit(1)).alias("hosts"),
                     F.sum(F.pow(F.col("failures"), 2) / F.col("docs")).alias("squares")).first()
    n = sums["n"] or 1
    mean = (sums["k"] or 0) / n
    noise = mean * (1 - mean) * (sums["hosts"] or 0) / n
    spread = max((sums["squares"] or 0.0) / n - mean * mean - noise, 0.0)
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
    return hosts.withColumn("rate", (F.col("failures") + mean * weight) / (F.col("docs") + weight))


def quality_verdicts(docs: DataFrame, text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """``docs`` with the counts of each text, ``base_failed``, ``host_rejected`` and ``kept``.

    A document is kept unless it fails a rule itself or its host is rejected: hosts whose shrunk failure rate is above
    ``limit`` lose all documents. Columns of the added names are replaced.

    Null and empty texts have no words and fail; a null host is a host of its own; repeated rows are counted and
    returned each; an empty table gives an empty one. Very long texts are counted whole; a host at the limit stays. Other
    columns are kept, whatever their names. Only counts per host are shuffled (partial sums first); the host
    table comes back by broadcast while its files are small, else by a join that adaptive execution splits.
    """
    docs = docs.drop(*COUNTS, "base_failed", "host_rejected", "kept")
    packed, rejected_host = unused(docs, "_counts", "_host")
    judged = (
        docs.withColumn(packed, counted(docs, text)).select("*", f"{packed}.*").drop(packed)
        .withColumn("base_failed", base_failed())
    )
    flags = judged.withColumn("failed", F.col("base_failed") | rule_failed()).select(host, "failed")
    rejected = settle(host_rates(flags, host).where(F.col("rate") > limit).select(F.col("_host").alias(rejected_host)), "rejected-hosts")
    return (
        judged.join(if_small(rejected.withColumn("host_rejected", F.lit(True))), same(F.col(host), F.col(rejected_host)), "left")
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~rule_failed() & ~F.col("host_rejected"))
        .drop(rejected_host)
    )
