"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm import collocations, hilbert, jaccard, katz, mixing, neardup, packing, ranked_search, repetition, secrets, sentence_pieces, urls, warc
from ridelens.llm.common import documents, stage, table
from ridelens.llm.oracle import ORACLE


def op1_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: the curve's order is cut into 40 runs of equal counts."""
    out = hilbert.hilbert_shards(documents(spark, sf_dir), 40)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9."""
    return jaccard.jaccard_components(documents(spark, sf_dir), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_coverage(documents(spark, sf_dir).select("doc_id", "text"))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, then reads every record back through the index."""
    return warc.read_records(warc.write_archives(table(spark, sf_dir, "pages")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op8_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents, once per epoch, by the production tree and weights."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    docs = stage(mixing.tree_columns(docs).drop("text"), "tokens")
    return mixing.mix_sources(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding with the public 32k model."""
    return sentence_pieces.encoding_digests(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for every benchmark item, 50 places."""
    return ranked_search.ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of 2 to 5 words that occur 100 times or more, 2,000 a language."""
    return collocations.collocations(documents(spark, sf_dir))


def base_of_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op5, which SQL can express."""
    return op5_repetition_coverage(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_of_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op6, which SQL can express."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_of_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of op7, and the verdict where a rule gives it."""
    verdict = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return op7_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", verdict.alias("rule_verdict"))


QUERIES = {f.__name__: f for f in (
    op1_rotation_codes, op2_hilbert_shards, op3_warc_bundles, op4_jaccard_join, op5_repetition_coverage,
    op6_secret_scan, op7_url_filter, op8_katz_scores, op9_best_fit_packing, op10_source_mixing, op11_sentence_pieces,
    op12_ranked_search, op13_collocations, base_of_op5, base_of_op6, base_of_op7)}
__all__ = ["QUERIES", "ORACLE"]
