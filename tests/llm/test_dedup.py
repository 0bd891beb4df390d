"""Line dedup, suffix dedup, n-gram join, components."""

import gc
import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

import fieldglass.llm.decontamination as decontamination
import fieldglass.llm.line_dedup as line_dedup
import fieldglass.llm.ngram_join as ngram_join
import fieldglass.llm.suffix_dedup as suffix_dedup
from fieldglass.llm.graphs import components
from fieldglass.llm.line_dedup import drop_repeated_lines
from fieldglass.llm.ngram_join import first_of_each, near_duplicates
from fieldglass.llm.suffix_dedup import Suffixes, drop_repeated_bytes

from .conftest import prose

BLANKS = " \t\n\x0b\x0c\r"
LAST = 1 << 63


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def lines_left(rows):
    owner = {}
    for doc, text, *_ in rows:
        for x in (text or "").split("\n"):
            k = lower(x.strip(BLANKS))
            if len(k) >= 10:
                owner[k] = min(owner.get(k, LAST), LAST if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        parts = (text or "").split("\n")
        left = [x for x in parts if len(k := lower(x.strip(BLANKS))) < 10 or owner[k] == (LAST if doc is None else doc)]
        out.append((doc, len(parts), len(parts) - len(left), "\n".join(left)))
    return Counter(out)


def test_lines(odd, odd_rows, documents, none, clash):
    names = ("doc_id", "n_lines", "n_dropped", "kept_text")
    got = drop_repeated_lines(clash(odd, "pos", "keep", "doc", "t1", "h1", "kept_text")).select(*names).collect()
    assert Counter(map(tuple, got)) == lines_left(odd_rows)
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert Counter(map(tuple, drop_repeated_lines(documents).select(*names).collect())) == lines_left(rows)
    assert drop_repeated_lines(none).count() == 0


def test_a_line_of_most_documents(spark):
    hot = "the same long line everywhere"
    rows = [(i, "\n".join([f"own line number {i}", hot, hot.upper() + "  ", f"shared by ten {i // 10}"]), None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    got = drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert Counter(map(tuple, got)) == lines_left(rows)


def bytes_left(rows, length):
    seen = Counter()
    for _, text, *_ in rows:
        raw = (text or "").encode()
        seen.update(raw[i:i + length] for i in range(len(raw) - length + 1))
    out = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return Counter(out)


def digests(df):
    from pyspark.sql import functions as F

    got = df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return Counter(map(tuple, got))


def test_repeated_bytes(odd, odd_rows, documents, none, clash):
    assert digests(drop_repeated_bytes(clash(odd, "spans", "n_bytes", "start", "k1", "name"))) == bytes_left(odd_rows, 200)
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert digests(drop_repeated_bytes(documents)) == bytes_left(rows, 200)
    assert drop_repeated_bytes(none).count() == 0


def tangled(seed, n):
    """Texts of pieces that many share, cut at random places, periodic parts among them."""
    r = random.Random(seed)
    pieces = ["".join(r.choice("abé") for _ in range(r.randint(5, 60))) for _ in range(12)] + ["ab" * 30, "a" * 45, "xyz" * 20]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            p = r.choice(pieces)
            a = r.randint(0, len(p) // 2)
            parts.append(p[a:a + r.randint(1, len(p))] + r.choice(["", "", "q", str(i)]))
        out.append((i, "".join(parts), None))
    return out


@pytest.mark.parametrize("seed, group", [(1, 1000), (2, 3), (3, 1), (4, 5)])
def test_tangled_bytes(spark, seed, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_RUNS", group)
    rows = tangled(seed, 150)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = drop_repeated_bytes(docs, length=24, short=8)
    assert digests(got) == bytes_left(rows, 24)


def test_suffix_order():
    data = np.frombuffer(("abracadabra" * 30 + prose(3, 200) + "a" * 300).encode(), np.uint8)
    for limit in (10, 64):
        starts = np.arange(len(data) - limit)
        order = Suffixes(data, limit).sort(np.random.default_rng(0).permutation(starts))
        cut = [data[i:i + limit].tobytes() for i in order]
        assert cut == sorted(cut) and sorted(order.tolist()) == starts.tolist()
    a, b = np.array([0, 0, 5]), np.array([11, 1, 5])
    assert Suffixes(data, 64).common(a, b).tolist() == [64, 0, 64]


def letters(n, size):
    raw = np.random.default_rng(5).integers(97, 123, n * size, np.uint8).tobytes().decode()
    return [raw[k * size: (k + 1) * size] for k in range(n)]


def peak_mb(step, make, tasks=3):
    """The most MB of Python's own while tasks run one after another, each with the step as it travels, before cycles are looked for."""
    blob = cloudpickle.dumps(step)
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for _ in range(tasks):
            for _ in cloudpickle.loads(blob)(make()):
                pass
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()
        gc.enable()


def test_bytes_take_little_memory():
    texts = letters(4000, 2000)
    keys, runs = pa.array(range(4000)), [[{"name": k // 4, "start": 9, "n": 500, "shared": False}] for k in range(4000)]
    rows = pa.RecordBatch.from_arrays([keys, keys, pa.array(texts), pa.array(runs)], names=["k1", "k2", "text", "runs"])
    assert peak_mb(suffix_dedup._runs(200, 48), lambda: iter([rows])) < 80
    assert peak_mb(suffix_dedup._cut_runs(200), lambda: iter([rows])) < 6
    cut = pa.Table.from_batches(suffix_dedup._cut_runs(200)(iter([rows]))).combine_chunks().to_batches()
    assert [x.decode() for x in cut[0].column("raw").to_pylist()] == [x[9:708] for x in texts]
    assert peak_mb(suffix_dedup._group(200), lambda: iter(cut)) < 100


def test_bytes_left_of_many_blocks(spark):
    texts = [*letters(900, 2000), None, "", "é" * 400]
    spans = [[{"start": 100, "n": 1}, {"start": 250, "n": 51}] if k % 3 == 0 else None if k % 3 == 1 else [] for k in range(900)] + [None] * 3
    got = suffix_dedup._without(200).func(pa.array(texts), pa.array(spans)).to_pylist()
    for text, own, row in zip(texts, spans, got):
        raw = (text or "").encode()
        left = raw[:100] + raw[500:] if own else raw
        assert row == {"n_bytes": len(raw), "n_removed": len(raw) - len(left), "n_spans": 1 if own else 0, "kept": left}


def shingle_set(text):
    w = [x for x in (text or "").replace("\x0b", " ").split() if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def joined(rows):
    texts = {t or "" for _, t, *_ in rows}
    sets = {t: shingle_set(t) for t in texts}
    links = defaultdict(set)
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b), links[b].add(a)
    name = {}
    for t in texts:
        if t not in name:
            group, todo = set(), [t]
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += links[x]
            ids = [d for d, u, *_ in rows if (u or "") in group and d is not None]
            name |= {x: min(ids, default=None) for x in group}
    return Counter((d, name[t or ""], len(links[t or ""])) for d, t, *_ in rows)


def test_near_duplicates(odd, odd_rows, documents, none, clash):
    names = ("doc_id", "class_id", "n_links")
    got = near_duplicates(clash(odd, "size", "keys", "node", "rep", "class_id")).select(*names).collect()
    assert Counter(map(tuple, got)) == joined(odd_rows)
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert Counter(map(tuple, near_duplicates(documents).select(*names).collect())) == joined(rows)
    assert near_duplicates(none).count() == 0 and first_of_each(none).count() == 0


@pytest.mark.parametrize("nodes", [1024, 16])
def test_a_large_group_of_near_copies(spark, nodes, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", nodes)
    r = random.Random(5)
    stem, rows = prose(9, 120).split(), []
    for i in range(120):
        w = list(stem)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"edit{r.randrange(40)}"
        rows.append((i, " ".join(w), None))
    rows += [(1000 + i, prose(100 + i, 80), None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    got = near_duplicates(docs).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == joined(rows)


def test_first_of_each(odd, odd_rows, spark):
    """One row of each class; classes are told apart by their node, as different ones may be named by one least id."""
    kept = [r.doc_id for r in first_of_each(odd).collect()]
    classes = near_duplicates(odd).select("class_id", "class_t1", "class_t2").distinct().collect()
    assert Counter(kept) == Counter(r.class_id for r in classes)
    assert {r.class_id for r in classes} == {c for _, c, _ in joined(odd_rows)}


def test_first_of_each_keeps_every_class(spark):
    own = [prose(300 + i, 60) for i in range(8)]
    rows = [(None, own[0]), (None, own[1]), (None, own[1]), (None, own[2] + " end"), (None, own[2]),  # three classes without an id
            (5, own[3]), (5, own[4]), (6, own[4]), (5, own[5]), (7, own[6]), (8, own[6] + " end"), (None, own[6]), (9, own[7])]
    docs = spark.createDataFrame([(*x, None) for x in rows], "doc_id bigint, text string, source string").repartition(3)
    kept = [(r.doc_id, r.text) for r in first_of_each(docs).collect()]
    of = lambda t: next(i for i, x in enumerate(own) if t.startswith(x))
    assert Counter((d, of(t)) for d, t in kept) == Counter([(None, 0), (None, 1), (None, 2), (5, 3), (5, 4), (5, 5), (7, 6), (9, 7)])


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(2000 + r.randrange(300), 2000 + r.randrange(300)) for _ in range(200)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_words_and_lines_take_little_memory():
    texts, keys = pa.array([f"{x}\n{x[:40]}" for x in letters(4000, 2000)]), pa.array(range(4000))
    rows = pa.RecordBatch.from_arrays([keys, keys, keys, texts], names=["doc", "t1", "t2", "text"])
    assert peak_mb(decontamination.hashed_words, lambda: texts) < 60
    assert peak_mb(line_dedup._hash_lines(10), lambda: iter([rows])) < 90
    assert peak_mb(ngram_join.shingles, lambda: texts) < 60
