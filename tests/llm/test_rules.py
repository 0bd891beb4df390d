"""URL filters, quality rules, license scans."""

import re
from collections import Counter

import numpy as np
import pytest

from fieldglass.llm.blocks import PRIME, Ranges
from fieldglass.llm.license_rules import BASE, rules
from fieldglass.llm.license_scan import license_labels
from fieldglass.llm.line_dedup import drop_repeated_lines
from fieldglass.llm.quality_rules import quality_verdicts
from fieldglass.llm.queries import URL_RULES
from fieldglass.llm.url_filters import HOST_WORDS, rule_table, url_verdicts

WORD = re.compile("[^\x20\x09-\x0d]+")


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judge(url, known):
    host, path = split_url(url)
    best = None
    for rule, verdict in known:
        h, p = rule.split("/", 1)[0], rule[len(rule.split("/", 1)[0]):]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    if best:
        return host, path, *best
    return host, path, None, "block" if set(re.split(r"[.\-]", host)) & set(HOST_WORDS) else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com/", "https://WWW.Example.COM/en/x?y#z", "ftp://example.com/en",
    "http://example.com/en/a", "http://x.www.example.com/en/", "http://notexample.com/en/", "http://.net/es/1", "http://a.net/ES/1", "http://a.net/fr/",
    "http://a..net/es/?q", "http://free-bets.org/", "x://y://example.com/en/", "http://com", "http://com?q=/", "http://ñ.com/é", "http://org#a",
    "http://a.net/es/" + "p/" * 20000, "line\nhttp://b.net/fr/\nz", "http://ads.b.com/x", "http://b.net/es/é😀",
]


def test_url_verdicts(spark, clash):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(3, URLS[9])] * 3 + [(None, URLS[7])]
    pages = clash(spark.createDataFrame(rows, "page_id bigint, url string"), "rule", "host", "prefix", "digest", "expression", "best")
    got = url_verdicts(pages, rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, got)) == Counter((k, *judge(u, URL_RULES)) for k, u in rows)


def test_url_lists_and_empty_tables(spark):
    known = [("example.com/en", "block"), ("example.com/en", "allow"), ("a.example.com/", "allow"), ("example.com/e", "allow"), ("org", "block")]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(
        ["http://example.com/english", "http://a.example.com/en", "http://x.org", "http://example.com/e"])], "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_verdicts(pages, rule_table(spark, known, ())).collect()}
    assert got == {0: ("example.com/en", "block"), 1: ("a.example.com/", "allow"), 2: ("org", "block"), 3: ("example.com/e", "allow")}
    assert url_verdicts(pages, rule_table(spark, [])).where("rule IS NOT NULL").count() == 0
    assert url_verdicts(pages.limit(0), rule_table(spark, known)).count() == 0


def counts(text):
    text = text or ""
    found = WORD.findall(text)
    lines = text.split("\n")
    full = [x for x in lines if WORD.search(x)]
    windows = Counter(tuple(found[i:i + 8]) for i in range(len(found) - 7))
    covered = {i + k for i in range(len(found) - 7) if windows[tuple(found[i:i + 8])] > 1 for k in range(8)}
    return len(found), sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(full) - len(set(full)), len(covered)


def verdicts(rows, limit=0.5):
    table = []
    for doc, text, host in rows:
        c = counts(text)
        base = c[0] < 20 or 100 * c[5] > 30 * c[0]
        table.append((doc, host, c, base, base or 10 * c[2] > c[1] or 100 * c[4] > 30 * c[3]))
    n, k = Counter(r[1] for r in table), Counter(r[1] for r in table if r[4])
    total = sum(n.values())
    mean = sum(k.values()) / total
    spread = max(sum(k[h] ** 2 / n[h] for h in n) / total - mean ** 2 - mean * (1 - mean) * len(n) / total, 0)
    weight = min(max(mean * (1 - mean) / spread - 1, 1), 1e6) if spread else 1e6
    bad = {h for h in n if (k[h] + mean * weight) / (n[h] + weight) > limit}
    return Counter((doc, *c, base, not failed and host not in bad) for doc, host, c, base, failed in table)


NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_quality_verdicts(odd, odd_rows, documents, none, clash):
    got = quality_verdicts(clash(odd, "kept", "failed", "docs", "n_words")).select(*NAMES)
    assert Counter(map(tuple, got.collect())) == verdicts(odd_rows)
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    assert Counter(map(tuple, quality_verdicts(documents).select(*NAMES).collect())) == verdicts(rows)
    assert quality_verdicts(none).count() == 0


def test_a_bad_host_loses_all(spark):
    junk, clean = "&&& ### $$$ " * 10, " ".join(f"clean{i}" for i in range(30))
    rows = [(i, junk, "bad") for i in range(50)] + [(50, clean, "bad")] + [(100 + i, clean + f" {i}", f"good{i % 5}") for i in range(100)]
    kept = {r.doc_id for r in quality_verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("kept").collect()}
    assert kept == set(range(100, 200))


LICENSES = [
    None, "", "plain words", "MIT License", "the MIT license. The mit-license; MIT  \n LICENSE", "submit license", "mit licenses",
    "GNU General Public License, version 3 or later", "under the Apache License, Version 2.0", "CC BY", "CC-BY-SA 4.0", "cc by cc by nc 3.0",
    "licensed under the GNU General Public License", "Permission is hereby granted, free of charge, to any person obtaining a copy", "émit license",
    "SPDX-License-Identifier: MIT", "all rights reserved", "gnu general public license " * 300, "BSD 3-Clause", "public domain",
]


def base(text):
    found = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    places, labels = [], set()
    for pattern, label in BASE:
        phrase = pattern.replace("!", "").split()
        here = [i for i in range(len(found)) if found[i:i + len(phrase)] == phrase]
        places += here
        labels |= {label} if here else set()
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_phrases(spark, documents, odd, none, clash):
    rows = [(k, t) for k, t in enumerate(LICENSES)] + [(3, LICENSES[3])] * 2 + [(None, LICENSES[7])]
    rows += [tuple(r) for r in documents.select("doc_id", "text").collect()]
    docs = clash(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), "labels", "rule", "key", "words", "hit", "start")
    got = license_labels(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert Counter(map(tuple, got)) == Counter((k, *base(t)) for k, t in rows)
    assert license_labels(odd).where("n_base > 0 OR score > 0").count() == 0
    assert license_labels(none).count() == 0


def test_rules_and_suppression(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(LICENSES)], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in license_labels(docs).collect()}
    assert got[7] == "gpl,gpl-3-or-later" and got[8] == "apache,apache-2.0" and got[10] == "cc-by,cc-by-sa-4.0"
    assert got[11] == "cc-by,cc-by-nc-3.0" and got[13] == "mit" and got[16] == "proprietary" and got[18] == "bsd-3-clause"
    assert got[2] == got[5] == got[6] == got[14] == "" and got[15] == "mit"
    assert len(rules()) >= 300


@pytest.mark.parametrize("rule", rules()[::37], ids=lambda r: r.rule)
def test_rules_are_patterns(rule):
    re.compile(rule.before), re.compile(rule.after)
    assert rule.keyword.isalnum() and 0 < rule.weight <= 1


def thue_morse(n):
    text = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_hashes_tell_built_texts_apart(spark, n):
    """Texts whose polynomials agree modulo 2**64 for every odd base: as lines, they are different ones."""
    one, other = thue_morse(n)
    rows = [(1, one, "a"), (2, other, "a"), (3, f"{one}\n{other}", "b"), (4, " ".join([one, other] * 4 + [other, one] * 4), "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert {r.doc_id: r.n_dropped for r in drop_repeated_lines(docs.where("doc_id < 3")).collect()} == {1: 0, 2: 0}
    got = {r.doc_id: r for r in quality_verdicts(docs).collect()}
    assert got[3].n_dup_lines == 0 and got[4].n_repeat_words == 0


def test_range_hashes():
    """Ranges modulo the prime against Python's integers; longer ranges than a stretch; the same in any block."""
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    data[100:400] = data[3000:3300]
    for stretch in (1 << 24, 64):
        Ranges.STRETCH, before = stretch, Ranges.STRETCH
        try:
            a, b = Ranges(data).of(np.array([100, 120, 7, 9]), np.array([400, 121, 7, 2000])), Ranges(data[90:]).of(np.array([2910, 2930, 0]), np.array([3210, 2931, 0]))
        finally:
            Ranges.STRETCH = before
        assert a[:3].tolist() == b.tolist() and a[2] == 0
        base = int(np.random.default_rng([1, 61]).integers(1 << 59, (1 << 61) - 2))
        assert int(a[3]) == sum((int(x) + 1) * pow(base, i, int(PRIME)) for i, x in enumerate(data[9:2000])) % int(PRIME)
