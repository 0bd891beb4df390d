"""Benchmark decontamination: pigeonhole pieces found exactly, then Myers' bit-parallel edit distance over words."""

from __future__ import annotations

import sys
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fieldglass.llm.blocks import Ranges, blocks, grams, mix, slices, words
from fieldglass.llm.frames import if_small, settle, text_key, unused

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: one edit (a word put in, left out or changed) is allowed for so many words of an item
WORDS_PER_EDIT = 8
#: items are looked for in blocks of about so many bytes; each block is one pass over the documents, and one index on the driver
ITEM_BYTES = 8 << 20

#: bytes of words: ASCII letters and digits, and everything beyond ASCII
LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def hashed_words(texts: pa.Array):
    """(first row, word hashes, each row's first word) by block; case and punctuation don't count."""
    for row, own in slices(texts):
        for inner, data, offsets in blocks(pc.utf8_lower(own)):
            starts, ends, first = words(data, offsets, LETTER)
            yield row + inner, mix(Ranges(data).of(starts, ends)), first


def distance_within(pattern: list[int], window: list[int], budget: int) -> int | None:
    """Least edit distance of ``pattern`` to any part of ``window`` if it is at most ``budget`` (Myers, bit-parallel)."""
    m = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in window:
        eq = where.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        best = min(best, score)
    return best if best <= budget else None


class Index:
    """The pieces of a block of items, by length: sorted hashes and the places that have them."""

    def __init__(self, ids: list[int], texts: list[str], words_per_edit: int):
        self.items: list[tuple[int, list[int], int]] = []
        places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        row = 0
        for _, hashes, first in hashed_words(pa.array(texts, pa.string())):
            for k in range(len(first) - 1):
                own = hashes[first[k]: first[k + 1]]
                if len(own):
                    budget = len(own) // words_per_edit
                    cuts = [len(own) * i // (budget + 1) for i in range(budget + 2)]
                    for a, b in zip(cuts, cuts[1:]):
                        places[b - a][int(grams(own[a:b], b - a)[0])].append((len(self.items), a))
                    self.items.append((ids[row], own.tolist(), budget))
                row += 1
        self.by_length = {}
        for size, found in places.items():
            keys = np.array(sorted(found), np.uint64)
            self.by_length[size] = keys, [found[int(k)] for k in keys]

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """(row, item) -> where the item would begin, by every piece found whole in a row."""
        out: dict[tuple[int, int], set[int]] = defaultdict(set)
        for size, (keys, places) in self.by_length.items():
            have = grams(hashes, size)
            if not len(have):
                continue
            marks = np.zeros(1 << 16, bool)
            marks[keys >> np.uint64(48)] = True
            near = np.flatnonzero(marks[have >> np.uint64(48)])
            at = np.minimum(np.searchsorted(keys, have[near]), len(keys) - 1)
            good = keys[at] == have[near]
            for pos, k in zip(near[good].tolist(), at[good].tolist()):
                if rows[pos] == rows[pos + size - 1]:
                    for item, offset in places[k]:
                        out[int(rows[pos]), item].add(pos - offset)
        return out


def _found(index: Index, texts: pa.Array) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
    for row, hashes, first in hashed_words(texts):
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for (r, item), begins in index.hits(hashes, rows).items():
            key, pattern, budget = index.items[item]
            best = None
            for at in sorted(begins):
                low, high = max(int(first[r]), at - budget), min(int(first[r + 1]), at + len(pattern) + budget)
                got = distance_within(pattern, hashes[low:high].tolist(), budget)
                best = got if best is None else best if got is None else min(best, got)
                if best == 0:
                    break
            if best is not None:
                out[row + r].append((key, best))
    return out


def _matches(index: Index, text: Column, id_type: T.DataType) -> Column:
    kind = to_arrow_type(T.ArrayType(T.StructType([T.StructField("item_id", id_type), T.StructField("distance", T.IntegerType())])))

    @F.arrow_udf(f"array<struct<item_id {id_type.simpleString()}, distance int>>")
    def match(texts: pa.Array) -> pa.Array:
        return pa.array([[{"item_id": k, "distance": d} for k, d in found] for found in _found(index, texts)], kind)

    return match(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                 words_per_edit: int = WORDS_PER_EDIT, block_bytes: int | None = None) -> DataFrame:
    """``docs`` with ``matches`` (array of item_id and distance) and ``contaminated``; columns of these names are replaced.

    An item is found where some part of a document is within one word edit for each ``words_per_edit`` words of it;
    case and punctuation don't count. A shorter item has to stand there whole, be it a single word.

    Items are taken in blocks of about ``block_bytes`` (by default ``ITEM_BYTES``), one after another. With one block, documents are judged in one pass
    without a shuffle. With more, each block is one written pass that keeps the texts it finds matches in, by 128 bits of
    their hash, and the driver holds the index of one block only; a join puts the matches back to the documents.

    Null and empty texts, null items and items without a word, and an empty benchmark match nothing; an item without an id
    is matched and its id is null. Repeated rows and items are judged each, and equal matches are listed in order of id and
    distance. Very long texts are worked on in a block of their own. Other columns are kept, whatever their names.
    """
    docs = docs.drop("matches", "contaminated")
    items = settle(benchmark.select(F.col(item).alias("id"), F.col(item_text).alias("t")).where(F.col("t").isNotNull()), "items")
    kind = items.schema["id"].dataType
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = int(total // (block_bytes or ITEM_BYTES)) + 1

    def matched(k: int) -> Column:
        block = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(passes)) == k).orderBy("id", "t").toArrow()
        return _matches(Index(block.column("id").to_pylist(), block.column("t").to_pylist(), words_per_edit), F.col(f"`{text}`"), kind)

    if passes == 1:
        found = docs.withColumn("matches", F.array_sort(matched(0)))
    else:
        key, names = text_key(F.col(f"`{text}`")), unused(docs, "text_1", "text_2", "found_1", "found_2")
        parts = [settle(docs.select(key[0].alias("k1"), key[1].alias("k2"), matched(k).alias("own")).where(F.size("own") > 0)
                        .dropDuplicates(["k1", "k2"]), "matches") for k in range(passes)]
        every = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("matches"))
        every = settle(every.withColumnsRenamed({"k1": names[2], "k2": names[3]}), "all-matches")
        keyed = docs.withColumns({names[0]: key[0], names[1]: key[1]})
        joined = keyed.join(if_small(every), (F.col(names[0]) == F.col(names[2])) & (F.col(names[1]) == F.col(names[3])), "left")
        found = joined.withColumn("matches", F.coalesce("matches", F.array().cast(every.schema["matches"].dataType))).drop(*names)
    return found.withColumn("contaminated", F.size("matches") > 0)
