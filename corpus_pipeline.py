"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Defined cases, for every stage: an empty table gives an empty table; columns beside those of documents, whatever
their names, come out as they went in (the last stage returns pieces, not documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm import jaccard, mixing, packing, repetition, secrets
from ridelens.llm.common import documents, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go; null, empty and short texts are among them. Repeated rows are
    judged each by itself."""
    return repetition.keep_clean(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8): that of the least id, one
    row of it. Rows without words or without an id all stay."""
    return jaccard.keep_one(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars`` follows; no row goes, and rows without secrets do not change."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the budgeted tree, once for every epoch in which they are chosen. Null langs and sources are
    nodes of the tree; a null text has no tokens."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "lang", "source",
                       mixing.word_tokens(F.col("text")).alias("n_tokens"))
    return mixing.mix_sources(rows).select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens; a null text is the end token alone."""
    return packing.best_fit_packing(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", deduplicate), ("secret_scans", remove_secrets),
          ("mix_to_target_weights", mix), ("best_fit_packing", pack)]

#: shingle search, tokenizer and packing have no SQL form; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and reread as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
