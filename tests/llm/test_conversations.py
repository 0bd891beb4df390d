"""Prefix trie of conversations against a brute-force trie."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fieldglass.llm import conversation_trie
from fieldglass.llm.conversation_trie import NODE, id_digests, last_turns, prefix_trie, spliced, turn_table

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def conversations_of(rows):
    """Turns in order; of equal numbers by the id that the docstring names."""
    def key(row):
        _, turn, role, text = row
        digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16]
        return turn is not None, turn or 0, digest, str(len(WORD.findall(text or "")))

    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=key):
        own[row[0]].append((row[2] or "", row[3] or ""))
    return own


def rebuilt_of(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(c - 20 * int(c / 20)), [])
        out[c] = tuple(base[:h] + own[c][h:])
    return out


def brute(rebuilt):
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        words = (len(own) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += words
            leaves[p[:d]] += kids[p] == 0
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if rebuilt[c] == p).encode()).hexdigest()
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def trie(turns, members=None, block=8):
    nodes, ends = prefix_trie(turns, members, block)
    found = nodes.join(id_digests(ends), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends"))
    return Counter(map(tuple, found.collect()))


def made(seed, n, longest):
    r = random.Random(seed)
    rows, stem = [], [("user", f"opening {i} of many words here") for i in range(longest)]
    for c in range(n):
        length = r.choice([1, 2, 3, 5, longest])
        cut = r.randint(0, length)
        turns = stem[:cut] + [(r.choice(["user", "assistant", None]), r.choice(["a", "b b", "", None])) for _ in range(length - cut)]
        rows += [(c * r.choice([1, 1, 3]) + 1000 * (c % 2), i - 1, *t) for i, t in enumerate(turns)]
    return rows


ODD = [(1, None, "user", "null turn first"), (1, 0, None, None), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, 0, "user", "nobody's"),
       (20, 0, "user", "x"), (21, 5, "user", "own one"), (21, 6, "user", "own two"), (40, 1, "user", "x " * 50_000), (45, 1, None, "y"),
       (-7, 3, "user", "negative"), (-7, 4, "", "more"), (2**62, 1, "user", "far"), (60, 0, "user", "x"), (61, 0, "user", "x")]


def test_odd_rows(spark):
    """Null ids, turns, roles and texts; ties; repeated rows; turnless rebuilt conversations; extra columns with clashing names."""
    table = spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumns({c: F.lit("mine") for c in ("pos", "turn_id", "m", "part", "local")})
    turns, members = spliced(turn_table(table))
    assert trie(turns, members) == brute(rebuilt_of(conversations_of(ODD)))


def test_long_conversations_in_small_blocks(spark):
    """Blocks of two turns, windows of three blocks: several levels of block ends."""
    rows = made(1, 60, 45)
    own = conversations_of(rows)
    turns = turn_table(spark.createDataFrame(rows, SCHEMA).repartition(4))
    want = brute({c: tuple(t) for c, t in own.items()})
    window, conversation_trie.WINDOW = conversation_trie.WINDOW, 3
    try:
        assert trie(turns, block=2) == want
    finally:
        conversation_trie.WINDOW = window
    assert trie(turns, block=8) == want


def test_one_conversation_over_many_partitions(spark):
    rows = [(5, i, "user", f"turn {i % 7}") for i in range(500)] + [(6, 0, "user", "turn 0")]
    got = turn_table(spark.createDataFrame(rows, SCHEMA).repartition(6)).where("conv_id = 5").orderBy("pos").select("pos").collect()
    assert [r.pos for r in got] == list(range(1, 501))
    assert trie(turn_table(spark.createDataFrame(rows, SCHEMA))) == brute({c: tuple(t) for c, t in conversations_of(rows).items()})


def test_pieces_of_ids(spark):
    """A node at which most conversations end is put together from pieces of several partitions."""
    rows = [(0, 0, 0, c) for c in range(3000)] + [(1, 7, 8, c) for c in range(5)] + [(2, 7, -8, 3000)]
    ends = spark.createDataFrame(rows, "depth bigint, x1 bigint, x2 bigint, conv_id bigint")
    piece, conversation_trie.PIECE = conversation_trie.PIECE, 64
    try:
        got = {(r.depth, r.x1, r.x2): r.digest for r in id_digests(ends).collect()}
    finally:
        conversation_trie.PIECE = piece
    want = {k: hashlib.sha256(",".join(str(r[3]) for r in rows if r[:3] == k).encode()).hexdigest() for k in {r[:3] for r in rows}}
    assert got == want


def test_empty_and_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie(*spliced(turn_table(none))) == Counter()
    turns = turn_table(spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "bot", "you"), (2, 0, "user", "hello")], SCHEMA), keep=["role", "text"])
    nodes, _ = prefix_trie(turns)
    got = {(r.depth, r.n_convs, r.role, r.text) for r in last_turns(nodes, turns).collect()}
    assert got == {(0, 2, None, None), (1, 2, "user", "hello"), (2, 1, "bot", "you")}
