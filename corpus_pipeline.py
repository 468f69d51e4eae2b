"""Documents to packed training sequences: quality rules, line dedup, near-dedup, secret redaction, packing.

In every stage null ids and texts, empty texts, ties, repeated rows, empty tables and further columns are allowed: a null or empty text fails the
quality rules; a null text stays null in the stages that change texts; of equal rows near-dedup keeps one; further columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, line_dedup, packing, quality, secrets, simhash
from tidewell.llm.common import discard, materialise, table

#: Near-duplicate detection has no SQL form, so there is no SQL for the whole; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null languages and sources are groups of their own."""
    return quality.judge(docs).where("__q_kept").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, counted over a source's different texts; ``n_chars`` follows where the table has it."""
    out = line_dedup.dedup_lines(docs, copies_once=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__ld_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays: the one with the smallest id, null ids last."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of token ids, with the documents' pieces that they hold; a null or empty text is its end mark alone."""
    return packing.pack_documents(docs, vocabulary=bpe.VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_boilerplate),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each stage's result is written as a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
