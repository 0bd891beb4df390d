"""Language identification: held-out accuracy, the fit's optimum, scoring by brute force, odd tables."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import language_id
from fieldglass.llm.language_id import Model, bags, family_of, languages_of, linear_svm

SCHEMA = "doc_id bigint, text string, lang string"


def test_families():
    assert family_of("de") == family_of("EN-us") == "germanic" and family_of("pt_BR") == "romance" and family_of("klingon") == "other"


def test_fit_is_the_optimum():
    """At the optimum no dual variable can move: each hinge loss and weight agree with it (the primal-dual gap closes)."""
    rng = np.random.default_rng(0)
    size, rows, signs = 40, [], []
    for i in range(80):
        at = np.sort(rng.choice(size, 6, replace=False)).astype(np.int32)
        v = rng.random(6).astype(np.float32)
        rows.append((at, v))
        signs.append(1.0 if v @ (at % 3 - 1) + rng.normal() * 0.3 > 0 else -1.0)
    w, bias = linear_svm(rows, np.array(signs), size, cost=1.0, passes=3000)
    loss = lambda w, b: (w @ w + b * b) / 2 + sum(max(0.0, 1 - s * (w[at] @ v + b)) for (at, v), s in zip(rows, signs))
    best = loss(w, bias)
    for _ in range(300):  # convex: no step in any direction is better
        d, e = rng.normal(size=size), rng.normal()
        for step in (1e-1, 1e-2):
            assert loss(w + step * d, bias + step * e) >= best - 2e-3


def brute_margin(model, column, text):
    data = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in text.encode())
    word, found = b"", []
    for b in [*data, 0]:
        if 0x61 <= b <= 0x7A or b >= 0x80:
            word += bytes([b])
        elif word:
            found.append(word)
            word = b""
    one = lambda w: next(iter(bags(pa.array([w.decode(errors="surrogateescape")]))))
    total, n = 0.0, 0
    for w in found:  # a word alone has the same n-grams as in a text; their number follows from its length
        at, share = one(w)
        grams = 1 + sum(max(len(w) + 2 - k + 1, 0) for k in language_id.GRAMS)
        total += float(model.weights[column][at].astype(np.float64) @ share) * grams
        n += grams
    return model.biases[column] + total / max(n, 1)


def test_margins_by_words(spark):
    model = Model(["de", "en", "es", "fr"])
    rng = np.random.default_rng(1)
    model.weights, model.biases = rng.normal(size=model.weights.shape).astype(np.float32), rng.normal(size=len(model.biases))
    texts = ["The quick brown fox", "été À la École 123 http://a.b/c?d", "", "x", "!!! 42"]
    got = model.margins(pa.array(texts))
    for i, text in enumerate(texts):
        for c in range(len(model.weights)):
            assert got[i, c] == pytest.approx(brute_margin(model, c, text), abs=1e-4)


def test_votes():
    """Families first, then votes; equal votes by summed margins, equal sums by order."""
    model = Model(["da", "fr", "nl", "sv"])
    assert list(model.families) == ["germanic", "romance"] and model.pairs == [(0, 2), (0, 3), (2, 3)]
    lead, rest = [1.0, -1.0], [1.0, -2.0, 3.0]  # da beats nl, sv beats da, nl beats sv: sums -1, 2 and 1 against
    language, score = model.decide(np.array([lead + rest, [-1.0, 1.0] + rest, lead + [1.0, 1.0, 1.0], lead + [0.0, 0.0, 0.0]]))
    assert language.tolist() == [2, 1, 0, 0] and ((0 < score) & (score <= 1)).all()


def test_held_out_accuracy(documents, spark):
    got = languages_of(documents.select("doc_id", "text", "lang")).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(odd, spark):
    """Nulls, empty and very long texts, texts without letters, repeated rows, clashing names, no labels, an empty table."""
    table = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") % 5 == 0, "fr"))
    more = spark.createDataFrame([(100, "123 !?", "en", "a"), (101, "你好", None, "a")], "doc_id bigint, text string, lang string, source string")
    table = table.unionByName(more)
    names = ("judged", "lettered", "score", "draw", "language", "out")
    got = languages_of(table.withColumns({c: F.lit("mine") for c in names})).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in table.collect())
    for r in got:
        empty = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == empty and (r.lang_pred in ("en", "fr", "und")) and (not empty or r.score == 0.0)
        assert r.judged == r.draw == r.language == "mine"
    same = {}
    for r in got:
        assert same.setdefault(r.text, (r.lang_pred, r.score)) == (r.lang_pred, r.score)
    assert {r.lang_pred for r in languages_of(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in languages_of(table.withColumn("lang", F.lit("xx"))).collect()} == {"und", "xx"}
    assert languages_of(table.limit(0)).count() == 0
