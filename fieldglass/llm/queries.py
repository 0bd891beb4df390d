"""The registered queries opN_<name> over the given tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.classifier import quality_scores
from fieldglass.llm.conversation_trie import NODE, id_digests, prefix_trie, spliced, turn_table
from fieldglass.llm.decontamination import contaminated
from fieldglass.llm.language_id import languages_of
from fieldglass.llm.license_scan import license_labels
from fieldglass.llm.line_dedup import drop_repeated_lines
from fieldglass.llm.lm_score import lm_scores
from fieldglass.llm.mixing import mixed_counts
from fieldglass.llm.ngram_join import near_duplicates
from fieldglass.llm.oracles import ORACLES
from fieldglass.llm.quality_rules import quality_verdicts
from fieldglass.llm.suffix_dedup import drop_repeated_bytes
from fieldglass.llm.url_filters import rule_table, url_verdicts
from fieldglass.llm.vector_codes import codebooks_digest, vector_codes

# The rules of the url query.
URL_RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_verdicts(pages, rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs).select("doc_id", "lm_score", "n_tokens", "log_likelihood")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "text_id", "n_copies", "n_links")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_labels(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "contaminated", F.col("matches.item_id").alias("item_ids"), F.array_min("matches.distance").alias("distance"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = spliced(turn_table(_table(spark, sf_dir, "conversations")))
    nodes, ends = prefix_trie(turns, members)
    found = nodes.join(id_digests(ends), NODE, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages_of(docs).select("doc_id", "held_out", "lang_pred", "score")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_url_filters, op2_source_mixing, op3_quality_rules, op4_lm_scoring, op5_suffix_dedup, op6_ngram_join, op7_license_scan,
             op8_decontamination, op9_line_dedup, op10_quality_classifier, op11_conversation_trie, op12_language_id, op13_vector_codes)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
