"""URL filters: rules on hosts and paths, found by short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.frames import if_small, lower_ascii, settle, unused

# Words that condemn a host when no rule speaks for or against it.
HOST_WORDS = (
    "ads", "adserver", "banner", "bet", "bets", "betting", "casino", "clickbait", "gambling", "jackpot", "lottery",
    "malware", "phishing", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "tracking", "xxx",
)

ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 2)


def _prefix(expression: Column) -> Column:
    """The short hash that rules and urls are joined on: 32 bits."""
    return F.xxhash64(expression).bitwiseAND(F.lit(0xFFFFFFFF))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]], words: Sequence[str] = HOST_WORDS) -> DataFrame:
    """Rules (``host/path``, verdict) and blocked host words as (rule, verdict, kind).

    A rule of a list file can be read into the same columns with ``spark.read``.
    """
    rows = [(rule, verdict, "rule") for rule, verdict in rules] + [(f"#{w}", "block", "word") for w in words]
    return spark.createDataFrame(rows, "rule string, verdict string, kind string")


def _listed(rules: DataFrame) -> tuple[DataFrame, list[int], list[int]]:
    """The rules with hashes, one row for each expression (block wins a tie), and the shapes they have.

    The shapes are the distinct numbers of host labels and path lengths: as many as a URL has characters at most.
    """
    host = F.regexp_extract("rule", "(?s)^([^/]*)", 1)
    table = settle(
        rules.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull())
        .withColumn("expression", F.concat(lower_ascii(host), F.substr("rule", F.length(host) + 1)))
        .groupBy("expression", "kind").agg(F.max("verdict").alias("verdict"))
        .withColumn("labels", F.size(F.split(F.regexp_extract("expression", "(?s)^([^/]*)", 1), r"\.")))
        .withColumn("path_length", F.length(F.regexp_extract("expression", "(?s)^[^/]*(.*)$", 1)))
        .withColumn("prefix", _prefix(F.col("expression")))
        .withColumn("digest", F.sha2("expression", 256)), "url-rules")
    shapes = table.where("kind = 'rule'").agg(F.collect_set("labels"), F.collect_set("path_length")).first()
    return table, sorted(shapes[0]), sorted(shapes[1])


def _expressions(labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Host suffixes times path prefixes in the rules' shapes, and the words of the host."""
    parts = F.split("host", r"\.")
    counts = F.filter(F.array(*map(F.lit, labels)).cast("array<int>"), lambda n: n <= F.size(parts))
    suffixes = F.transform(counts, lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))
    found = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    marks = F.transform(F.split("host", r"[.\-]"), lambda w: F.concat(F.lit("#"), w))
    return F.array_distinct(F.concat(found, marks))


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    Each distinct (host, path) is expanded into host-suffix and path-prefix expressions, joined with the rules on
    32-bit hashes and confirmed by SHA-256. The longest rule wins, then the longer host. Without a rule, a listed word
    among the host's words blocks; else ``default`` holds (``rule`` is null in both cases).

    Null urls and urls without ``://`` have an empty host and path and get ``default``. Repeated rows stay, each with
    its verdict; an empty table or an empty rule list gives no matches. Verdicts are worked out once for a distinct
    address, so a URL that fills a third of the table is one row until the join back, which adaptive execution splits.
    Matches equal in both lengths are one rule; listed with two verdicts it blocks. Very long urls are judged whole. Other
    columns are kept, whatever their names.
    """
    listed, labels, lengths = _listed(rules)
    own_host, own_path, best = unused(pages, "_host", "_path", "_best")
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    found = (
        pages.select("host", "path").distinct()
        .withColumn("expression", F.explode(_expressions(labels, lengths)))
        .withColumn("prefix", _prefix(F.col("expression")))
        .join(if_small(listed.select("prefix", "digest", "verdict", "kind")), "prefix")
        .where(F.sha2("expression", 256) == F.col("digest"))
        .groupBy(F.col("host").alias(own_host), F.col("path").alias(own_path))
        .agg(F.max(F.struct((F.col("kind") == "rule").alias("is_rule"), F.length("expression").alias("long"),
                            F.length(F.substring_index("expression", "/", 1)).alias("host_long"), "verdict",
                            "expression")).alias(best))
    )
    return (
        pages.join(found, (F.col("host") == F.col(own_host)) & (F.col("path") == F.col(own_path)), "left")
        .withColumn("rule", F.when(F.col(f"{best}.is_rule"), F.col(f"{best}.expression")))
        .withColumn("verdict", F.coalesce(f"{best}.verdict", F.lit(default)))
        .drop(own_host, own_path, best)
    )
