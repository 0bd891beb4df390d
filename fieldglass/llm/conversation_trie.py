"""Conversation prefix trie: ROLLUP over positional turn-id columns aggregates all prefixes of a block together.

A conversation is laid out in blocks of a few turns, one turn id a column. ``GROUP BY block, prior node, ROLLUP(t1, .. tK)``
gives every prefix that ends in a block, and ``grouping_id`` its length; longer conversations go on in further rows, keyed
by the node in which their prior block ended. A node's key is the exclusive-or of a 128-bit hash of each (place, turn), so
the prior node of any block follows from sums over blocks, and a parent's key from its child's.

Sums over subtrees take the same way back: a second ROLLUP adds the nodes of a block to their prefixes. What lies below
a block's end is summed first, over the tree of block ends, whose K-fold blocks are rolled up in the same manner; so the
number of rounds is the logarithm of the longest conversation to the base K.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldglass.llm.frames import if_small, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: turns of a block
BLOCK = 8
#: blocks whose hashes one window adds up
WINDOW = 64
#: ids of one end node that are joined to one piece of text
PIECE = 65536

WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "x1", "x2"]


# --- turns ---------------------------------------------------------------------------------------------------------

def turn_id(role: Column, text: Column) -> Column:
    """128 bits of SHA-256 over role and text (null as empty), then the text's number of words in digits."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.unhex(F.substring(digest, 1, 32)), F.regexp_count(text, F.lit(WORD)).cast("string").cast("binary"))


def words_of(turn: Column) -> Column:
    return F.substring(turn, 17, 20).cast("string").cast("long")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the turns of a sorted partition in their conversations, counted within the partition."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        at = np.arange(len(conv))
        new = np.ones(len(conv), bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = conv[0] != last
        begin = np.maximum.accumulate(np.where(new, at, -1))
        pos = np.where(begin < 0, at + n + 1, at - begin + 1)
        last, n = conv[-1], int(pos[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, np.int32)), pa.array(pos), *batch.columns],
                                         names=["part", "local", *batch.schema.names])


def turn_table(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               keep: Sequence[str] = ()) -> DataFrame:
    """(conv_id, pos, turn_id, columns to ``keep``), written: turns numbered from 1 in each conversation, null turns first.

    Turns with the same number are ordered by their id. Rows are range-partitioned by conversation and turn, so a conversation
    with a third of all rows is numbered by many tasks; counts of the partitions (one row each) put their parts together.
    Rows without a conversation id belong to none.
    """
    parts = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), turn_id(F.col(role), F.col(text)).alias("turn_id"),
        *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_id")]
    schema = "part int, local bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = settle(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_number, schema), "turns")
    edges = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "local")).alias("last"))
    so_far = Window.partitionBy("last.conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("part")  # one row for each partition
    edges = edges.withColumn("sum", F.sum("last.local").over(so_far))
    carried = edges.withColumns({"prior": F.lag("last.conv_id").over(before), "ahead": F.lag("sum").over(before)}).where("prior = first")
    offsets = carried.select(F.col("part").alias("of_part"), F.col("first").alias("of_conv"), "ahead")
    placed = local.join(F.broadcast(offsets), (F.col("part") == F.col("of_part")) & (F.col("conv_id") == F.col("of_conv")), "left")
    return settle(placed.select("conv_id", (F.col("local") + F.coalesce("ahead", F.lit(0))).alias("pos"), "turn_id",
                                *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)]), "placed-turns")


def spliced(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversation ids) where the first h turns of each conversation c are those of conversation c - c % ``every``.

    h is the CRC-32 of c's digits modulo ``most``. A shorter or absent conversation gives what it has, and c's own turns
    after its first h follow.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    lengths = settle(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "lengths")
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    convs = lengths.select("conv_id", base, h.alias("h"))
    heads = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "turn_id")
    opening = convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "turn_id")
    given = lengths.select(F.col("conv_id").alias("base"), "n")
    short = convs.join(given, "base", "left").select("conv_id", (F.col("h") - F.least("h", F.coalesce("n", F.lit(0)))).alias("short"))
    short = if_small(settle(short.where("short > 0"), "short-openings"))
    own = turns.where(F.col("pos") > h).join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") - F.coalesce("short", F.lit(0))).alias("pos"), "turn_id")
    return opening.unionByName(own), lengths.select("conv_id")


# --- blocks and nodes ----------------------------------------------------------------------------------------------

def _turns_of(block: int) -> list[str]:
    return [f"t{i + 1}" for i in range(block)]


def _hashes(place: Column, turn: Column) -> tuple[Column, Column]:
    """What a turn adds to the keys of the nodes below it."""
    return tuple(F.when(turn.isNotNull(), F.xxhash64(F.lit(k), place, turn)).otherwise(F.lit(0).cast("long")) for k in (1, 2))


def _xor(first: Column, *more: Column) -> Column:
    for c in more:
        first = first.bitwiseXOR(c)
    return first


def _key_after(block: int, taken: Column) -> tuple[Column, Column]:
    """The key of the node ``taken`` turns into a block."""
    added = [_hashes(F.col("m") * block + i + 1, F.when(F.lit(i) < taken, F.col(t))) for i, t in enumerate(_turns_of(block))]
    return _xor(F.col("p1"), *[a for a, _ in added]), _xor(F.col("p2"), *[b for _, b in added])


def _before(rows: DataFrame, most: int) -> DataFrame:
    """Rows (conv_id, i, a1, a2) with b1, b2: the exclusive-or of a conversation's rows of smaller i, by groups of bounded size."""
    rows = rows.withColumn("g", F.expr(f"i div {WINDOW}"))
    ahead = Window.partitionBy("conv_id", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"b{k}": F.coalesce(F.bit_xor(f"a{k}").over(ahead), F.lit(0).cast("long")) for k in (1, 2)})
    if most < WINDOW:
        return rows.drop("g")
    sums = settle(rows.groupBy("conv_id", F.col("g").alias("i")).agg(F.bit_xor("a1").alias("a1"), F.bit_xor("a2").alias("a2")), "block-sums")
    over = _before(sums, most // WINDOW).select("conv_id", F.col("i").alias("g"), F.col("b1").alias("c1"), F.col("b2").alias("c2"))
    return rows.join(over, ["conv_id", "g"]).withColumns({f"b{k}": _xor(F.col(f"b{k}"), F.col(f"c{k}")) for k in (1, 2)}).drop("g", "c1", "c2")


def _blocks(turns: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(conv_id, m, p1, p2, t1.., e): blocks with the key of the node before them and their number of turns; the largest m."""
    rows = turns.groupBy("conv_id", F.expr(f"(pos - 1) div {block}").alias("m")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn_id"))).alias("own"))
    rows = rows.select("conv_id", "m", F.size("own").alias("e"), *[F.get("own", F.lit(i))["turn_id"].alias(t) for i, t in enumerate(_turns_of(block))])
    added = [_hashes(F.col("m") * block + i + 1, F.col(t)) for i, t in enumerate(_turns_of(block))]
    rows = settle(rows.withColumns({"a1": _xor(*[a for a, _ in added]), "a2": _xor(*[b for _, b in added])}), "blocks")
    most = rows.agg(F.max("m")).first()[0] or 0
    zero = F.lit(0).cast("long")
    if not most:
        return rows.withColumns({"p1": zero, "p2": zero}).drop("a1", "a2"), 0
    keyed = _before(rows.withColumnRenamed("m", "i"), most).withColumnsRenamed({"i": "m", "b1": "p1", "b2": "p2"})
    return settle(keyed.drop("a1", "a2"), "keyed-blocks"), most


def _rolled(rows: DataFrame, columns: Sequence[str], sums: str) -> DataFrame:
    """All prefixes of ``columns`` under each (m, p1, p2), with ``d``, how many columns a prefix has; prefixes of rows that end earlier go."""
    listed = ", ".join(columns)
    rolled = rows.sparkSession.sql(
        f"SELECT m, p1, p2, {listed}, {len(columns)} - bit_count(grouping_id()) AS d, {sums} FROM {{rows}} GROUP BY m, p1, p2, ROLLUP({listed})",
        rows=rows)
    return rolled.where(F.expr(f"d = 0 OR get(array({listed}), d - 1) IS NOT NULL"))


def _below(paths: DataFrame, weights: DataFrame, most: int, block: int) -> DataFrame:
    """(m, p1, p2, w, l): the weights of each block end and of all block ends below it, added up.

    ``paths`` has the block ends (conv_id, m, p1, p2), m from 1 to ``most``, that each conversation passes.
    """
    q = [f"q{i + 1}" for i in range(block)]
    step = F.expr(f"(i - 1) div {block}")
    ends = paths.select("conv_id", F.col("m").alias("i"), F.struct("p1", "p2").alias("q"))
    upper = settle(paths.where(F.col("m") % block == 0).select("conv_id", F.expr(f"m div {block}").alias("m"), "p1", "p2"), "upper-ends")
    grouped = ends.groupBy("conv_id", step.alias("m")).agg(F.sort_array(F.collect_list(F.struct("i", "q"))).alias("own"))
    grouped = grouped.select("conv_id", "m", *[F.get("own", F.lit(i))["q"].alias(c) for i, c in enumerate(q)])
    keyed = grouped.join(upper, ["conv_id", "m"], "left").withColumns({p: F.coalesce(p, F.lit(0).cast("long")) for p in ("p1", "p2")})
    nodes = _rolled(keyed, q, "count(1) AS n").where("d > 0").drop("n")
    own = F.get(F.array(*q), F.col("d") - 1)
    nodes = nodes.withColumns({"i": F.col("m") * block + F.col("d"), "x1": own["p1"], "x2": own["p2"]})
    named = weights.select(F.col("m").alias("i"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), "w", "l")
    nodes = settle(nodes.join(named, ["i", "x1", "x2"], "left").fillna(0, ["w", "l"]), "ends")
    total = _with_below(nodes, upper, most // block, block)
    rolled = _rolled(total, q, "sum(w) AS w, sum(l) AS l").where("d > 0")
    return rolled.select((F.col("m") * block + F.col("d")).alias("m"), own["p1"].alias("p1"), own["p2"].alias("p2"), "w", "l")


def _with_below(nodes: DataFrame, paths: DataFrame, most: int, block: int) -> DataFrame:
    """``nodes`` (m, p1, p2, d, x1, x2, w, l, ..) where those at a block's end also have the weights of all blocks below."""
    if not most:
        return nodes
    sums = settle(nodes.where("m > 0").groupBy("m", "p1", "p2").agg(F.sum("w").alias("w"), F.sum("l").alias("l")), "block-weights")
    below = _below(paths, sums, most, block).select(
        (F.col("m") - 1).alias("m_"), F.col("p1").alias("x1_"), F.col("p2").alias("x2_"), F.col("w").alias("w_"), F.col("l").alias("l_"))
    at_end = (F.col("d") == block) & (F.col("m") == F.col("m_")) & (F.col("x1") == F.col("x1_")) & (F.col("x2") == F.col("x2_"))
    return nodes.join(below, at_end, "left").withColumns({k: F.col(k) + F.coalesce(f"{k}_", F.lit(0)) for k in ("w", "l")}).drop("m_", "x1_", "x2_", "w_", "l_")


def prefix_trie(turns: DataFrame, members: DataFrame | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the conversations in ``turns`` (conv_id, pos from 1, turn_id); ``members`` names those without turns as well.

    Nodes: depth, x1, x2 (the key), conv_id (smallest member), parent_conv_id (root: null), n_convs, n_children, n_leaves and
    saved_tokens (over the subtree, each node's words times its members but one). Ends: the key of the node at which each
    conv_id ends. ``last_turns`` gives nodes their texts.

    Null roles and texts count as empty; equal turns of one conversation count each; turns of one number are ordered by id;
    rows without a conversation belong to none (``turn_table``). Conversations of any length go on in further blocks, and no
    task gets more than a block of one. Without conversations there is no root and both tables are empty.
    """
    rows, most = _blocks(turns, block)
    t = _turns_of(block)
    d = F.col("d")
    nodes = _rolled(rows, t, "count(1) AS n_convs, min(conv_id) AS conv_id").where("d > 0")
    x1, x2 = _key_after(block, d)
    last = F.get(F.array(*t), d - 1)
    nodes = nodes.withColumns({"depth": F.col("m") * block + d, "x1": x1, "x2": x2})
    h1, h2 = _hashes(F.col("depth"), last)
    nodes = settle(nodes.withColumns({"y1": _xor(F.col("x1"), h1), "y2": _xor(F.col("x2"), h2), "w": (F.col("n_convs") - 1) * words_of(last)}), "nodes")

    everyone = turns.select("conv_id") if members is None else turns.select("conv_id").unionByName(members.select("conv_id"))
    everyone = settle(everyone.distinct(), "members")
    top = everyone.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).first()

    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("conv_id").alias("parent_conv_id"))
    kids = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("y1").alias("x1"), F.col("y2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    deep = nodes.where("depth > 1").join(parent, ["depth", "y1", "y2"], "left")
    first = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(top["conv_id"]).cast("long"))
    linked = deep.unionByName(first).join(kids, NODE, "left").fillna(0, ["n_children"])
    linked = settle(linked.withColumn("l", (F.col("n_children") == 0).cast("long")), "linked-nodes")

    paths = rows.where("m > 0").select("conv_id", "m", "p1", "p2")
    own = "min(conv_id) AS conv_id, max(n_convs) AS n_convs, min_by(parent_conv_id, d) AS parent_conv_id, min_by(n_children, d) AS n_children"
    total = _rolled(_with_below(linked, paths, most, block).select("m", "p1", "p2", *t, "d", "conv_id", "n_convs", "parent_conv_id", "n_children", "w", "l")
                    .withColumnRenamed("d", "own_d"), t, own.replace(", d)", ", own_d)") + ", sum(w) AS saved_tokens, sum(l) AS n_leaves, "
                    f"count_if(own_d = 1) AS openings")
    total = settle(total.where("d > 0 OR m = 0"), "subtrees")
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    below_root = total.where("d > 0").select(
        (F.col("m") * block + d).alias("depth"), x1.alias("x1"), x2.alias("x2"), "conv_id", "parent_conv_id", *counts)
    zero = F.lit(0).cast("long")
    root = total.where("d = 0").agg(F.coalesce(F.sum("openings"), zero).alias("n_children"), F.coalesce(F.sum("n_leaves"), zero).alias("n_leaves"),
                                    F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"))
    root = root.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), F.lit(top["conv_id"]).cast("long").alias("conv_id"),
                       F.lit(None).cast("long").alias("parent_conv_id"), F.lit(top["n_convs"]).cast("long").alias("n_convs"), "n_children",
                       F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens").where(F.lit(top["n_convs"] > 0))
    e1, e2 = _key_after(block, F.col("e"))
    reached = rows.select("conv_id", F.struct((F.col("m") * block + F.col("e")).alias("depth"), e1.alias("x1"), e2.alias("x2")).alias("end"))
    ends = everyone.join(reached.groupBy("conv_id").agg(F.max("end").alias("end")), "conv_id", "left")
    ends = ends.select(*[F.coalesce(F.col("end")[c], zero).alias(c) for c in NODE], "conv_id")
    return root.unionByName(below_root), ends


def last_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the other columns of ``turns`` (conv_id, pos, ..) for each node's last turn; the root has none."""
    named = turns.withColumnsRenamed({"conv_id": "turn_conv", "pos": "turn_pos"})
    return nodes.join(named, (F.col("conv_id") == F.col("turn_conv")) & (F.col("depth") == F.col("turn_pos")), "left").drop("turn_conv", "turn_pos")


# --- lists of members ----------------------------------------------------------------------------------------------

def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the nodes whose ids lie within the partition; pieces of text of those that may go on beyond it, or are long."""
    names = [*NODE, "at", "piece", "digest"]
    key, ids, opening, pieced = None, [], True, False

    def row(whole: bool):
        text = ",".join(map(str, ids))
        return (*key, ids[0], None, hashlib.sha256(text.encode()).hexdigest()) if whole else (*key, ids[0], text, None)

    def made(out):
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        out = []
        for *own, conv in zip(*(c.to_pylist() for c in batch.columns)):
            own = tuple(own)
            if own != key:
                if key is not None:
                    out.append(row(not opening and not pieced))
                    opening = False
                key, ids, pieced = own, [], False
            elif len(ids) >= PIECE:
                out.append(row(False))
                ids, pieced = [], True
            ids.append(conv)
        if out:
            yield made(out)
    if key is not None:
        yield made([row(False)])


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, in order, one piece in memory at a time."""
    key, digest, out = None, None, []
    for batch in batches:
        for d, x1, x2, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if (d, x1, x2) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (d, x1, x2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
    if key is not None:
        out.append((*key, digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 3 + [pa.string()])], names=[*NODE, "digest"])


def id_digests(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, digest): SHA-256 of the ids that end at each node, ascending, comma-joined.

    Ids are range-partitioned, so a node at which a third of all conversations end is spread over many tasks. Its digest is
    one sequence by definition; the task that makes it streams pieces of up to ``PIECE`` ids.
    """
    parts = max(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [*NODE, "conv_id"]
    done = settle(ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _sum_up, "depth bigint, x1 bigint, x2 bigint, at bigint, piece string, digest string"), "id-pieces")
    pieces = done.where("digest IS NULL").repartition(*NODE).sortWithinPartitions(*NODE, "at").select(*NODE, "piece")
    late = pieces.mapInArrow(_put_together, "depth bigint, x1 bigint, x2 bigint, digest string")
    return done.where("digest IS NOT NULL").select(*NODE, "digest").unionByName(late)
