"""Language identification by stages: first the language's family, then one-versus-one linear SVMs within the family.

A text is described by the shares of its words' byte n-grams (hashed). One linear SVM for each family is set against all
others; every two languages of a family have an SVM of their own, which votes. The SVMs are fitted in numpy by dual
coordinate descent on a bounded sample of labelled documents; every text is then scored in one pass without a shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.blocks import MODEL_BLOCK, Prefix, blocks, mix, words
from fieldglass.llm.classifier import is_held_out
from fieldglass.llm.frames import unused

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Language codes of families with several written languages.
FAMILIES = {
    "germanic": "de en nl sv da nb nn no is fo af fy lb yi", "romance": "es fr it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg", "baltic": "lt lv", "celtic": "ga gd cy br", "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt", "semitic": "ar he mt am", "indic": "hi ur bn pa gu mr ne si", "iranian": "fa ps ku tg",
    "malayic": "id ms jv su tl", "dravidian": "ta te kn ml", "sinitic": "zh yue wuu", "bantu": "sw zu xh st sn rw",
}

BUCKET_BITS = 15
GRAMS = (1, 2, 3, 4)
#: labelled documents per language in expectation, in all at most, and the most frequent languages learned
PER_LANGUAGE, SAMPLE, LANGUAGES = 800, 6000, 64
#: weight of the margin's violations, and passes over the sample
COST, PASSES = 4.0, 30
SEED = 12
UNKNOWN = "und"

#: bytes of words: ASCII letters and everything beyond ASCII
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_TO_BUCKET = np.uint64(64 - BUCKET_BITS)


def family_of(language: str) -> str:
    """The family of a language code by its first subtag; all unlisted codes are one family."""
    code = language.replace("_", "-").split("-")[0].lower()
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), "other")


# --- features ------------------------------------------------------------------------------------------------------

def _bordered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another, each between borders, and the word of each byte."""
    sizes = ends - starts + 2
    last = np.cumsum(sizes)
    word = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(int(last[-1]) if len(last) else 0) - (last - sizes)[word] if len(sizes) else np.zeros(0, np.int64)
    flat = data[np.clip(starts[word] + at - 1, 0, max(len(data) - 1, 0))] if len(word) else np.zeros(0, np.uint8)
    flat[last - sizes], flat[last - 1] = ord("<"), ord(">")
    return flat, word


def _block(data: np.ndarray, offsets: np.ndarray):
    """Each word's kind, the n-gram buckets of the kinds with the kind of each, and the rows' first words."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets, LETTER)
    kinds, example, kind = np.unique(mix(Prefix(data).ranges(starts, ends)), return_index=True, return_inverse=True)
    flat, word = _bordered(data, starts[example], ends[example])
    prefix = Prefix(flat, seed=4)
    buckets, owners = [(mix(kinds) >> _TO_BUCKET).astype(np.int64)], [np.arange(len(kinds))]
    for n in GRAMS:
        h = prefix.windows(n)
        inside = np.flatnonzero(word[: len(h)] == word[n - 1: n - 1 + len(h)])
        buckets.append((mix(h[inside] + np.uint64(n)) >> _TO_BUCKET).astype(np.int64))
        owners.append(word[inside])
    return kind, np.concatenate(buckets), np.concatenate(owners), first


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text's n-grams."""
    for _, data, offsets in blocks(texts, MODEL_BLOCK):
        kind, buckets, owner, first = _block(data, offsets)
        order = np.argsort(owner, kind="stable")
        buckets, sizes = buckets[order], np.bincount(owner, minlength=int(kind.max(initial=-1)) + 1)
        begin = np.cumsum(sizes) - sizes
        for a, b in zip(first, first[1:]):
            mine, times = np.unique(kind[a:b], return_counts=True)
            bag = np.zeros(1 << BUCKET_BITS)
            for k, n in zip(mine.tolist(), times.tolist()):
                np.add.at(bag, buckets[begin[k]: begin[k] + sizes[k]], n)
            used = np.flatnonzero(bag)
            yield used.astype(np.int32), (bag[used] / max(bag.sum(), 1)).astype(np.float32)


# --- fitting -------------------------------------------------------------------------------------------------------

def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, cost: float = COST, passes: int = PASSES,
               seed: int = SEED) -> tuple[np.ndarray, float]:
    """(weights, bias) of least |w|^2 / 2 + cost * sum of hinge losses, the bias being one weight more; dual coordinate descent."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slope = signs[i] * (float(w[at] @ v) + bias) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            step = (new - alpha[i]) * signs[i]
            if step:
                alpha[i] = new
                w[at] += step * v
                bias += step
                most = max(most, abs(step) * norms[i])
        if most < 1e-3:
            break
    return w, bias


class Model:
    """Families, their languages, and the weights by bucket: one column a family, then one for each two languages of one."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.families: dict[str, list[int]] = {}
        for i, name in enumerate(languages):
            self.families.setdefault(family_of(name), []).append(i)
        self.pairs = [(a, b) for own in self.families.values() for a, b in combinations(own, 2)]
        n = (len(self.families) if len(self.families) > 1 else 0) + len(self.pairs)
        self.weights, self.biases = np.zeros((n, 1 << BUCKET_BITS), np.float32), np.zeros(n)

    def fit(self, language: np.ndarray, bag: list[tuple[np.ndarray, np.ndarray]]) -> "Model":
        size = 1 << BUCKET_BITS
        mean = np.zeros(size)
        for at, share in bag:
            mean[at] += share
        scale = 1 / np.sqrt(mean / max(len(bag), 1) + 1e-5)  # common n-grams count less, rare ones not without bound
        rows = [(at, share * scale[at]) for at, share in bag]
        member = np.array([next(f for f, own in enumerate(self.families.values()) if i in own) for i in language.tolist()], np.int64)
        column = 0
        if len(self.families) > 1:
            for f in range(len(self.families)):
                self._learn(column, rows, np.where(member == f, 1.0, -1.0), scale)
                column += 1
        for a, b in self.pairs:
            own = np.flatnonzero((language == a) | (language == b))
            self._learn(column, [rows[i] for i in own], np.where(language[own] == a, 1.0, -1.0), scale)
            column += 1
        return self

    def _learn(self, column: int, rows, signs: np.ndarray, scale: np.ndarray) -> None:
        w, self.biases[column] = linear_svm(rows, signs, len(scale))
        self.weights[column] = w * scale

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of rows of margins: the family with the widest margin, then its language with most votes.

        Equal votes are decided by the summed margins, equal sums by the languages' order. The score is the chance of
        the family's lead times the mean chance of the language's own margins.
        """
        n, chance = len(margins), lambda x: 1 / (1 + np.exp(-np.clip(2 * x, -60, 60)))
        many = len(self.families) > 1
        lead = margins[:, : len(self.families)] if many else np.zeros((n, 1))
        family = lead.argmax(1)
        score = np.ones(n)
        if many:
            ordered = np.sort(lead, axis=1)
            score = chance((ordered[:, -1] - ordered[:, -2]) / 2)
        language, column = np.zeros(n, np.int64), len(self.families) if many else 0
        for f, own in enumerate(self.families.values()):
            mine = np.flatnonzero(family == f)
            votes, sums, chances = (np.zeros((len(mine), len(own))) for _ in range(3))
            for a, b in combinations(range(len(own)), 2):
                m = margins[mine, column]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                sums[:, a] += m
                sums[:, b] -= m
                chances[:, a] += chance(m)
                chances[:, b] += chance(-m)
                column += 1
            best = np.lexsort((-np.arange(len(own))[None].repeat(len(mine), 0), sums, votes), axis=1)[:, -1] if len(mine) else np.zeros(0, np.int64)
            language[mine] = np.array(own)[best] if len(mine) else 0
            if len(own) > 1 and len(mine):
                score[mine] *= chances[np.arange(len(mine)), best] / (len(own) - 1)
        return language, score

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Of each text, every SVM's weight summed over its n-grams' shares, and the bias."""
        out = np.repeat(self.biases[None], len(texts), 0)
        for row, data, offsets in blocks(texts, MODEL_BLOCK):
            kind, buckets, owner, first = _block(data, offsets)
            kinds = int(kind.max(initial=-1)) + 1
            n = _row_sums(np.bincount(owner, minlength=kinds)[kind], first)
            for c, table in enumerate(self.weights):
                worth = np.bincount(owner, table[buckets], kinds)
                out[row: row + len(n), c] += _row_sums(worth[kind], first) / np.maximum(n, 1.0)
        return out


def _train(languages: list[str]):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = [], []
        for batch in batches:
            known += batch.column("language").to_pylist()
            own += bags(batch.column("text"))
        model = Model(languages).fit(np.array([languages.index(x) for x in known], np.int64), own)
        for i, (w, b) in enumerate(zip(model.weights, model.biases)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([b])],
                                             names=["svm", "weights", "bias"])

    return train


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", per_language: int = PER_LANGUAGE,
          sample: int = SAMPLE, languages: int = LANGUAGES) -> Model | None:
    """Fit on labelled documents that are not held out: about ``per_language`` different ones of each of the ``languages``
    most frequent labels, ``sample`` in all at most, drawn by a hash of id and text. None without a label."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("language"), F.col(f"`{text}`").alias("text"),
                       F.xxhash64(F.lit(SEED), F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")).alias("draw"),
                       is_held_out(F.col(f"`{key}`")).alias("out"))
    rows = rows.where("language IS NOT NULL AND text IS NOT NULL AND NOT out").drop("out")
    sizes = rows.groupBy("language").count().orderBy(F.desc("count"), "language").limit(languages).collect()
    if not sizes:
        return None
    names = sorted(r["language"] for r in sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["language"], min(1.0, per_language / r["count"]))])
    unit = F.shiftrightunsigned("draw", 11).cast("double") * 2.0 ** -53
    drawn = rows.where(F.col("language").isin(names) & (unit < share[F.col("language")]))
    chosen = drawn.select("draw").distinct().orderBy(F.xxhash64(F.lit(SEED), "draw"), "draw").limit(sample)
    fitted = (
        drawn.join(F.broadcast(chosen), "draw").groupBy("draw").agg(F.min("language").alias("language"), F.max("text").alias("text"))
        .repartitionByRange(1, "draw").sortWithinPartitions("draw").select("language", "text")
        .mapInArrow(_train(names), "svm int, weights binary, bias double").orderBy("svm").collect()
    )
    model = Model(names)
    for r in fitted:
        model.weights[r["svm"]], model.biases[r["svm"]] = np.frombuffer(r["weights"], np.float32), r["bias"]
    return model


def languages_of(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", per_language: int = PER_LANGUAGE,
                 sample: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score`` (0 to 1); such columns are replaced.

    Only the text decides; documents whose key's crc32 modulo 4 is 2 are held out of the fit. Null texts and texts without
    a letter are ``und`` with score 0, as is everything if no document is labelled; with one label all others get it.

    Null keys are not held out. Whole texts count, very long ones in a block of their own. Ties go to the language first
    in order; repeated rows get the same result and count once in the fit, with the least of their labels; an empty
    table gives an empty one. Other columns are kept, whatever their names.
    """
    docs = docs.drop("held_out", "lang_pred", "score")
    model = train(docs, text, key, lang, per_language, sample, languages)
    body = F.col(f"`{text}`")
    if model is None:
        return docs.withColumns({"held_out": is_held_out(F.col(f"`{key}`")), "lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    @F.arrow_udf("language string, score double")
    def judged(texts: pa.Array) -> pa.Array:
        language, score = model.decide(model.margins(texts))
        return pa.StructArray.from_arrays(
            [pa.array([model.languages[i] for i in language.tolist()], pa.string()), pa.array(score)], names=["language", "score"])

    found, lettered = unused(docs, "judged", "lettered")
    letters = F.coalesce(body.rlike(r"\p{L}"), F.lit(False))
    return (
        docs.withColumns({found: judged(body), lettered: letters})
        .withColumns({"held_out": is_held_out(F.col(f"`{key}`")),
                      "lang_pred": F.when(F.col(lettered), F.col(found)["language"]).otherwise(UNKNOWN),
                      "score": F.when(F.col(lettered), F.col(found)["score"]).otherwise(0.0)})
        .drop(found, lettered)
    )
