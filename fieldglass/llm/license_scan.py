"""License scans: ordered signature rules behind a keyword prefilter; overlapping detections are resolved.

Only documents that a cheap test lets through are taken apart into words; each keyword in them is joined with the rules
that it opens, and the words around it decide. Detections inside a longer one, or equal to one of a better rule, go.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldglass.llm.frames import lower_ascii, same, text_key, unused
from fieldglass.llm.license_rules import Rule, rules

#: words on each side of a keyword that a rule may look at
REACH = 16

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), BREAK, -1), lambda w: w != "")


def _spelled(found: Column) -> Column:
    """Words as one string, each written " w "."""
    return F.when(F.size(found) > 0, F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))).otherwise(F.lit(""))


def _count(spelled: Column) -> Column:
    return F.regexp_count(spelled, F.lit(" ")) / F.lit(2)


def detections(docs: DataFrame, text: str = "text", key: str = "doc_id", known: Sequence[Rule] | None = None) -> DataFrame:
    """(key, t1, t2, rule, label, base, priority, weight, start, stop): detections left after suppression.

    ``start`` and ``stop`` count words from 0. Base rules are never suppressed.
    """
    known = list(known or rules())
    keywords = sorted({r.keyword for r in known})
    table = docs.sparkSession.createDataFrame(
        [(r.rule, r.keyword, r.before, r.after, r.label, r.base, r.priority, float(r.weight)) for r in known],
        "rule string, keyword string, before string, after string, label string, base boolean, priority int, weight double")
    t1, t2 = text_key(F.col(text))
    letter = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    gate = f"(?i)(?<!{letter})(?:{'|'.join(keywords)})(?!{letter})"
    words_in = (
        docs.where(F.col(text).rlike(gate))
        .select(F.col(key).alias("key"), t1.alias("t1"), t2.alias("t2"), _words_of(F.col(text)).alias("words"))
    )
    wanted = F.array(*map(F.lit, keywords))
    marked = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("keyword"))),
                      lambda x: F.array_contains(wanted, x["keyword"]))
    near = (
        words_in.withColumn("hit", F.explode(marked))
        .withColumn("at", F.col("hit.at"))
        .select("key", "t1", "t2", "at", F.col("hit.keyword").alias("keyword"),
                _spelled(F.slice("words", F.greatest(F.col("at") - REACH, F.lit(0)) + 1, F.least("at", F.lit(REACH)))).alias("left"),
                _spelled(F.slice("words", F.col("at") + 2, F.lit(REACH))).alias("right"))
    )
    # The rules are this module's own few hundred rows.
    hits = (
        near.join(F.broadcast(table), "keyword")
        .where("left rlike before AND right rlike after")
        .withColumn("start", (F.col("at") - _count(F.expr("regexp_extract(left, before, 1)"))).cast("long"))
        .withColumn("stop", (F.col("at") + 1 + _count(F.expr("regexp_extract(right, after, 1)"))).cast("long"))
        .select("key", "t1", "t2", "rule", "label", "base", "priority", "weight", "start", "stop").distinct()
    )
    ahead = (Window.partitionBy("key", "t1", "t2", "base").orderBy("start", F.desc("stop"), "priority")
             .rowsBetween(Window.unboundedPreceding, -1))
    return (
        hits.withColumn("reach", F.max("stop").over(ahead))
        .where(F.col("base") | F.col("reach").isNull() | (F.col("reach") < F.col("stop"))).drop("reach")
    )


def _labels(only: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(only, F.col("label")))), ",")


def license_labels(docs: DataFrame, text: str = "text", key: str = "doc_id", known: Sequence[Rule] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score; such columns are replaced.

    ``score`` is the weight of the best detection left, 0 without any. Null and empty texts have no words, no labels
    (empty strings) and score 0. Repeated rows get the same result; an empty table gives an empty one.
    Very long texts are scanned whole. Other columns are kept, whatever their names.
    """
    docs = docs.drop("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    own_1, own_2, found_key, found_1, found_2 = unused(docs, "_t1", "_t2", "_key", "_f1", "_f2")
    found = (
        detections(docs, text, key, known).groupBy(F.col("key").alias(found_key), F.col("t1").alias(found_1), F.col("t2").alias(found_2))
        .agg(F.count(F.when(F.col("base"), 1)).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
             F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"), _labels(F.col("base")).alias("base_labels"),
             _labels(F.lit(True)).alias("labels"), F.max("weight").alias("score"))
    )
    t1, t2 = text_key(F.col(text))
    counted = docs.withColumns({own_1: t1, own_2: t2,
                                "n_words": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")})
    joined = counted.join(found, same(F.col(key), F.col(found_key)) & (F.col(own_1) == F.col(found_1)) & (F.col(own_2) == F.col(found_2)), "left")
    return joined.select(
        *[docs[c] for c in docs.columns], "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
