"""Language-model scores, quality classifier, decontamination, mixing, pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import classifier, lm_score, mixing
from fieldglass.llm.classifier import quality_scores
from fieldglass.llm.decontamination import contaminated, distance_within
from fieldglass.llm.lm_score import lm_scores
from fieldglass.llm.mixing import mixed_blocks, mixed_counts, permuted, slots_of

from .conftest import prose

WORD = re.compile("[^\x20\x09-\x0d]+")


# --- language model ------------------------------------------------------------------------------------------------

def test_scores_are_sums_over_words(documents):
    frequent, flat = lm_score.fit(documents)
    net, known = lm_score.unpack(flat), lm_score.Words(frequent)
    texts = ["one two three two one", "", "word", documents.first().text]
    n, total = lm_score.score_texts(pa.array(texts), net, known)
    for text, count, got in zip(texts, n, total):
        _, hashes, _ = next(lm_score.hashed_words(pa.array([text or ""]))) if text else (0, np.zeros(0, np.uint64), 0)
        ids = known.entries(hashes)
        sums = 0.0
        for i, target in enumerate(ids):
            around = [ids[i + s] if 0 <= i + s < len(ids) else lm_score.VOCABULARY for s in lm_score.SIDES]
            h = np.tanh(np.concatenate([net["embed"][a] for a in around]) @ net["hidden"] + net["bias"])
            c, k = divmod(int(target), lm_score.WITHIN)
            a, b = h @ net["classes"] + net["class_bias"], h @ net["inner"][c] + net["inner_bias"][c]
            sums += a[c] - math.log(np.exp(a).sum()) + b[k] - math.log(np.exp(b).sum())
        assert count == len(ids) and got == pytest.approx(sums, abs=1e-3)


def test_gradients():
    rng = np.random.default_rng(0)
    net = lm_score.new_network(np.ones(lm_score.VOCABULARY))
    around, target = rng.integers(0, lm_score.VOCABULARY, (40, 4)), rng.integers(0, lm_score.VOCABULARY, 40)
    seen = {k: np.full(s, 1e4, np.float32) for k, s in lm_score.SHAPES.items()}  # steps so small that they show the slope
    loss = lambda x: -lm_score.log_probability(x, around, target).mean()
    before = {k: v.copy() for k, v in net.items()}
    lm_score.train_step(net, seen, around, target)
    for k in lm_score.SHAPES:
        slope = (before[k].astype(np.float64) - net[k]) / lm_score.RATE * 1e2
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        up, down = ({x: v.copy() for x, v in before.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(slope[at], rel=0.15, abs=1e-3)


def plain_step(net, seen, around, target):
    """A training step by softmaxes and sums, a class at a time: what ``train_step`` must give."""
    rate, within, n = lm_score.RATE, lm_score.WITHIN, len(target)

    def shares(z):
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    order = np.argsort((target // within).astype(np.uint16), kind="stable")
    around, target = around[order], target[order]
    x = net["embed"][around].reshape(n, -1)
    h = np.tanh(x @ net["hidden"] + net["bias"])
    kind, inner = target // within, target % within
    d = shares(h @ net["classes"] + net["class_bias"])
    d[np.arange(n), kind] -= 1
    grads = {k: np.zeros_like(v) for k, v in net.items() if k != "embed"}
    grads["classes"], grads["class_bias"], back = h.T @ d, d.sum(0), d @ net["classes"].T
    edges = np.searchsorted(kind, np.arange(lm_score.CLASSES + 1))
    for c, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            e = shares(h[a:b] @ net["inner"][c] + net["inner_bias"][c])
            e[np.arange(b - a), inner[a:b]] -= 1
            grads["inner"][c], grads["inner_bias"][c] = h[a:b].T @ e, e.sum(0)
            back[a:b] += e @ net["inner"][c].T
    back *= 1 - h * h
    grads["hidden"], grads["bias"] = x.T @ back, back.sum(0)
    order = np.argsort(around.reshape(-1).astype(np.uint16), kind="stable")
    kinds, at = np.unique(around.reshape(-1)[order], return_index=True)
    rows = np.add.reduceat((back @ net["hidden"].T).reshape(-1, lm_score.WIDTH)[order], at, axis=0) / np.float32(n)
    for k, g in grads.items():
        g = g / np.float32(n)
        seen[k] += g * g
        net[k] -= rate * g / np.sqrt(seen[k])
    seen["embed"][kinds] += rows * rows
    net["embed"][kinds] -= rate * rows / np.sqrt(seen["embed"][kinds])


def test_steps_give_the_plain_result_by_two_softmaxes(monkeypatch):
    """Whole batches are worked on at once, not class by class: that was most of a step's CPU time."""
    rng = np.random.default_rng(4)
    draw = lambda size: np.minimum(rng.zipf(1.3, size) - 1, lm_score.VOCABULARY - 1)
    steps = [(draw((lm_score.BATCH, 4)), draw(lm_score.BATCH)) for _ in range(15)]

    def run(step):
        net = lm_score.new_network(np.ones(lm_score.VOCABULARY))
        seen = {k: np.full(s, 1e-6, np.float32) for k, s in lm_score.SHAPES.items()}
        for around, target in steps:
            step(net, seen, around, target)
        return net

    calls, softmax = [], lm_score._softmax
    monkeypatch.setattr(lm_score, "_softmax", lambda z: calls.append(z.shape) or softmax(z))
    want, got = run(plain_step), run(lm_score.train_step)
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-3), k
    assert len(calls) == 2 * len(steps)


def test_contexts_of_a_part_and_large_outputs():
    first = np.array([0, 0, 1, 1, 3, 5, 5, 8, 14, 14])
    entries = np.arange(100, 114)
    want = [[entries[i + s] if a <= i + s < b else lm_score.VOCABULARY for s in lm_score.SIDES] for a, b in zip(first, first[1:]) for i in range(a, b)]
    for start in range(15):
        for stop in range(start, 15):
            assert lm_score.contexts(entries, first, start, stop).tolist() == [list(map(int, x)) for x in want[start:stop]]
    z = np.array([[500, 400, -400], [-300, -301, -302], [1, 2, 3]], np.float32)
    exact = z - z.max(1, keepdims=True).astype(float)
    exact -= np.log(np.exp(exact).sum(1, keepdims=True))
    assert lm_score._log_softmax_at(z.copy(), np.array([0, 1, 2])) == pytest.approx(exact[[0, 1, 2], [0, 1, 2]], abs=1e-5)
    assert np.allclose(lm_score._softmax(z.copy()), np.exp(exact), atol=1e-6)


def test_order_and_likelihood(spark, documents, odd, none, clash):
    text = " ".join(["alpha beta gamma delta epsilon zeta eta theta"] * 40)
    rows = [(i, text) for i in range(60)] + [(100, " ".join(random.Random(1).sample(text.split(), 320)))]
    got = {r.doc_id: r.lm_score for r in lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect()}
    assert got[0] > got[100] + 0.5 and max(got[i] for i in range(60)) == pytest.approx(min(got[i] for i in range(60)), abs=1e-6)
    scored = lm_scores(clash(odd, "n_tokens", "lm_score", "_lm", "word")).collect()
    assert all((r.n_tokens == 0) == (r.lm_score is None) == (r.log_likelihood == 0) for r in scored) and len(scored) == odd.count()
    assert lm_scores(none).count() == 0
    assert lm_scores(documents).agg(F.sum("n_tokens")).first()[0] == sum(len(WORD.findall(r.text)) for r in documents.collect())


def test_rare_words_by_their_own_counts(spark):
    r = random.Random(3)
    known = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(5000)]
    rows = [(i, " ".join(r.choice(known) for _ in range(200))) for i in range(300)]
    rows += [(1000 + i, " ".join("".join(r.sample(w, 7)) for w in t.split())) for i, t in rows[:20]]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id bigint, text string").repartition(3).cache()
    got = {x.doc_id: x for x in lm_scores(docs).collect()}
    assert min(got[i].lm_score for i in range(300)) > max(got[i].lm_score for i in range(1000, 1020)) + 1
    frequent, flat = lm_score.fit(docs)
    kept, per = lm_score.Words(frequent), Counter()
    hashes = {i: next(lm_score.hashed_words(pa.array([t])))[1] for i, t in rows}
    n = Counter(h for i, _ in rows + rows[:40] for h in hashes[i].tolist())
    rare = {h for h in n if kept.entries(np.array([h], np.uint64))[0] >= lm_score.VOCABULARY - lm_score.RARE}
    for h in rare:
        per[h % lm_score.RARE] += n[h]
    for i, t in rows[:3] + rows[-3:]:
        _, total = lm_score.score_texts(pa.array([t]), lm_score.unpack(flat), kept)
        want = total[0] + sum(math.log(n[h] / (per[h % lm_score.RARE] + 1)) for h in hashes[i].tolist() if h in rare)
        assert got[i].log_likelihood == pytest.approx(want, rel=1e-4)


def test_rare_words_of_the_tail_are_joined(spark, monkeypatch):
    """With a small head most counts are joined; scores are those of a head that holds all."""
    r = random.Random(5)
    known = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(6000)]
    rows = [(i, " ".join(r.choice(known) for _ in range(150))) for i in range(200)]
    docs = spark.createDataFrame(rows + rows[:9] + [(900, None), (901, "")], "doc_id bigint, text string").repartition(2).cache()
    scores = lambda: {x.doc_id: x.log_likelihood for x in lm_scores(docs).collect()}
    whole = scores()
    monkeypatch.setattr(lm_score.head_words, "__defaults__", (700,))
    counts = lm_score.word_counts(docs)
    head = lm_score.head_words(counts)
    assert 0 < len(head.hashes) <= 700 and head.least > 2 and counts.where(F.col("n") >= head.least).count() == len(head.hashes)
    assert scores() == pytest.approx(whole, rel=1e-4)


def test_every_word_is_a_target_once(spark, monkeypatch):
    texts = ["one", "two words", *[prose(i, 40) for i in range(5)], prose(0, 40)]
    _, hashes, first = next(lm_score.hashed_words(pa.array(texts)))
    for rounds in (1, 2, 5):
        at = [lm_score.masked(hashes, first, np.arange(len(texts)), k, rounds) for k in range(rounds)]
        assert sorted(np.concatenate(at).tolist()) == list(range(len(hashes)))
    copies = [tuple(x[(x >= a) & (x < a + 40)] - a) for x in at for a in (first[2], first[7])]
    assert copies[0::2] != copies[1::2]  # the same text under two keys
    seen = []
    merged = lm_score._merged
    monkeypatch.setattr(lm_score, "_merged", lambda parts: seen.append(parts.where("slice = 0").agg(F.sum("n")).first()[0]) or merged(parts))
    lm_score.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2))
    assert sum(x or 0 for x in seen) == len(hashes)


# --- classifier ----------------------------------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    flipped = labels.withColumn("quality", F.when(classifier.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_scores(docs, flipped).agg(F.sum("score")).first() == quality_scores(docs, labels).agg(F.sum("score")).first()


def test_scores_are_means_over_features(spark, documents):
    texts = [r.text for r in documents.limit(20).collect()] + ["", "a", "a b"]
    table = np.random.default_rng(0).standard_normal(1 << classifier.BUCKET_BITS)
    got = classifier.logits(pa.array(texts), table, 0.25)
    for value, (buckets, shares) in zip(got, classifier.bags(pa.array(texts))):
        assert value == pytest.approx(0.25 + float(shares.astype(np.float64) @ table[buckets]), abs=1e-5)


def test_odd_labels(spark, odd, none, clash):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (9, 1), (12, 0), (15, 0), (16, 7), (16, 1)], "doc_id bigint, quality int")
    got = quality_scores(clash(odd, "score", "label", "weights", "n"), labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.score for r in quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(none, labels).count() == 0


# --- decontamination -----------------------------------------------------------------------------------------------

def normal(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if w]


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    r = random.Random(0)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randint(lo, 30))] for lo in (1, 0))
        assert (distance_within(a, b, 99)) == least_distance(a, b)


def test_contaminated(spark, documents, odd, none, clash):
    r = random.Random(2)
    items = [(k, prose(50 + k, r.randint(8, 60))) for k in range(12)] + [(90, "too short"), (91, None), (None, prose(1, 20)), (92, "")]
    rows = []
    for i in range(200):
        w = normal(items[i % 12][1])
        for _ in range(r.randint(0, len(w) // 5)):
            at, kind = r.randrange(len(w)), r.randrange(3)
            w[at:at + (kind != 1)] = ["other"] if kind else []
        rows.append((i, f"{prose(900 + i, 30)}, {' '.join(w).upper() if i % 3 else '. '.join(w)}! {prose(1900 + i, 30)}"))
    docs = clash(spark.createDataFrame(rows + [(500, None), (501, "")], "doc_id bigint, text string"), "matches", "item_id", "id", "t")
    got = {x.doc_id: {(m.item_id, m.distance) for m in x.matches} for x in contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for doc, text in rows:
        want = {(k, d) for k, t in items[:12] if (d := least_distance(normal(t), normal(text))) <= len(normal(t)) // 8}
        assert got[doc] == want
    assert got[500] == got[501] == set()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert contaminated(none, bench).count() == 0 and contaminated(odd, bench.limit(0)).where("contaminated").count() == 0


def test_blocks_of_items(spark, documents, sf_dir, monkeypatch):
    from fieldglass.llm import decontamination

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = contaminated(documents, bench).select("doc_id", "matches").orderBy("doc_id").collect()
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 2000)
    assert contaminated(documents, bench).select("doc_id", "matches").orderBy("doc_id").collect() == whole


def test_short_items_and_items_without_an_id(spark):
    """Items of one word up stand whole in a text or not at all; null ids match; several passes give what one gives."""
    long = prose(700, 24)
    items = [(k, " ".join(f"item{k}w{i}" for i in range(k))) for k in range(1, 8)] + [(None, long), (None, "lone words"), (8, "?!"), (9, None)]
    rows = [(k, f"before, {' '.join(f'Item{k}w{i}' for i in range(k))}! after") for k in range(1, 8)]
    rows += [(20, f"x {long} y"), (21, "lone, WORDS"), (22, "lone word"), (23, "item4w0 item4w1 item4w3"), (24, None), (25, "item1w0 " * 3), (25, "item1w0 " * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = Counter({(k, ((k, 0),)): 1 for k in range(1, 8)} | {(20, ((None, 0),)): 1, (21, ((None, 0),)): 1, (22, ()): 1, (23, ()): 1, (24, ()): 1, (25, ((1, 0),)): 2})
    for size in (None, 40):
        got = contaminated(docs, bench, block_bytes=size).collect()
        assert Counter((r.doc_id, tuple((m.item_id, m.distance) for m in r.matches)) for r in got) == want
        assert all(r.contaminated == bool(r.matches) for r in got)


# --- mixing --------------------------------------------------------------------------------------------------------

def targets(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, budget, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        budget -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


def check_mix(rows, got):
    size = lambda t: len(WORD.findall(t or ""))
    per = Counter()
    for _, t, s in rows:
        per[s] += size(t)
    want = targets(per)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((d, size(t), s) for d, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == per[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 0.5 + 1e-6


@pytest.mark.parametrize("length", [7, 100, 1024])
def test_mixed_counts(odd, odd_rows, length):
    got = mixed_counts(odd, length=length).collect()
    check_mix(odd_rows, got)
    again = mixed_counts(odd.repartition(5), length=length).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_of_documents(documents, none, clash):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    check_mix(rows, mixed_counts(clash(documents, "size", "start", "chunk", "sid", "target")).collect())
    assert mixed_counts(none).count() == 0 and mixed_blocks(none).count() == 0


def test_chunks_and_shards(documents, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_DOCS", 3)
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    check_mix(rows, mixed_counts(documents, length=16).collect())


def test_blocks_hold_the_words(odd, odd_rows):
    got = mixed_blocks(odd, length=50)
    rows = got.collect()
    counts = mixed_counts(odd, length=50).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    n = Counter()
    for r in rows:
        n[r.source] += r.n_words
        assert len(WORD.findall(r.text)) == r.n_words <= 50
    assert n == Counter({r.source: r.n for r in counts if r.n})
    vocabulary = {s: {w for _, t, x in odd_rows if x == s for w in WORD.findall(t or "")} for s in n}
    assert all(set(WORD.findall(r.text)) <= vocabulary[r.source] for r in rows)
    assert len({(r.source, r.slot) for r in rows}) == len(rows)


@pytest.mark.parametrize("cap", [4.0, 0.5])
def test_other_caps(spark, cap):
    rows = [(0, prose(1, 30), "a"), (1, prose(2, 2000), "b"), (2, prose(3, 40), "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.source: r for r in mixed_counts(docs, length=16, cap=cap).collect()}
    assert got["a"].target == cap * 30 and got["c"].target == cap * 40
    assert all(abs(r.taken - r.target) <= 0.5 for r in got.values())
    n = Counter()
    for r in mixed_blocks(docs, length=16, cap=cap).collect():
        n[r.source] += r.n_words
    assert n == Counter({s: r.taken for s, r in got.items()})


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        at = np.arange(n)
        for key in (1, 99):
            out = permuted(at, np.full(n, key), np.full(n, n))
            assert sorted(out.tolist()) == at.tolist()
            assert (permuted(out, np.full(n, key), np.full(n, n), back=True) == at).all()


def test_slots_give_exactly_the_words():
    for size in (1, 7, 20, 21, 100):
        for want in range(1, 2 * size + 1):
            slots, last = slots_of(size, want, 7, 5)
            n = -(-size // 7)
            j = np.arange(slots)
            block = permuted(j % n, mixing._epoch_key(np.full(slots, 5), j // n), np.full(slots, n))
            words = np.minimum(7, size - block * 7)
            if last >= 0:
                assert 0 < last <= words[-1]
                words[-1] = last
            assert words.sum() == want


# --- pipeline ------------------------------------------------------------------------------------------------------

def test_pipeline(spark, sf_dir, documents):
    import corpus_pipeline
    from fieldglass.llm.frames import settle

    from .test_dedup import joined, lines_left
    from .test_rules import verdicts

    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, sf_dir), "stage")
        seen[name] = docs
        if name != "mixing":
            assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
        rows = [tuple(r) for r in before.select("doc_id", "text", "source").collect()]
        if name == "quality rules":
            assert {r.doc_id for r in docs.collect()} == {v[0] for v in verdicts(rows) if v[-1]}
        elif name == "line dedup":
            assert {(r.doc_id, r.text, r.n_chars) for r in docs.collect()} == {(d, t, len(t)) for d, _, k, t in lines_left(rows) if t or not k}
        elif name == "near duplicates":
            assert {r.doc_id for r in docs.collect()} == {c for _, c, _ in joined(rows)}
        elif name == "benchmark decontamination":
            items = [normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            want = {d for d, t, _ in rows if not any(len(i) >= 8 and least_distance(i, normal(t)) <= len(i) // 8 for i in items)}
            assert {r.doc_id for r in docs.collect()} == want
        else:
            assert sum(r.n_words for r in docs.collect()) == pytest.approx(1.5 * sum(len(WORD.findall(t)) for _, t, _ in rows), abs=20)
