"""The queries of this subpackage, one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, embeddings, fim, hmm, html_text, line_dedup, oracles, packing, pii, quality, secrets, simhash, winnowing
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents"), keep_cols=["doc_id", "source"])
    preview = F.concat(F.substring("__s_cand", 1, 4), F.lit("..."))
    return rows.select("doc_id", "source", F.col("__s_ord").alias("ord"), preview.alias("preview"), F.sha2("__s_cand", 256).alias("cand_sha256"), *[F.col(f"__s_{f}").alias(f) for f in secrets.FEATURES], F.col("__s_vote").alias("vote"), F.col("__s_secret").alias("is_secret"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.hex("__sim_fp")).alias("fingerprint"), F.col("__sim_component").alias("component_id"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.digests(table(spark, sf_dir, "documents"), keep_cols=["doc_id"])
    return rows.select("doc_id", "__b.n_tokens", "__b.ids_sha256", "__b.decoded_sha256")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(table(spark, sf_dir, "documents"), keep_cols=["doc_id"])
    return rows.select("doc_id", *[F.col(f"__q.{c}").alias(c) for c in quality.COUNTS], F.col("__q_base_failed").alias("base_failed"), F.col("__q_kept").alias("kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", F.col("__ld_n_lines").alias("n_lines"), F.col("__ld_n_dropped").alias("n_dropped"), "text")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.extract(table(spark, sf_dir, "pages"), keep_cols=["page_id", "url"])
    return rows.select("page_id", "url", F.col("__h_text").alias("text"), F.length("__h_text").cast("long").alias("n_chars"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest are of the base spans; ``spans`` has those and the network's."""
    rows = pii.find(table(spark, sf_dir, "documents"), keep_cols=["doc_id"])
    return rows.select("doc_id", *[f"__pii.{c}" for c in pii.SPANS.names])


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.align(table(spark, sf_dir, "documents"), keep_cols=["doc_id"], with_groups=False, with_links=False)
    return rows.select("doc_id", *[f"__al.{c}" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(table(spark, sf_dir, "documents"), keep_cols=["doc_id"])
    output, form = F.col("__fim.output"), F.col("__fim.form")
    hashed = [F.sha2(output, 256).alias("output_sha256"), F.sha2(fim.restore(output, form), 256).alias("restored_sha256")]
    return rows.select("doc_id", *[f"__fim.{c}" for c in ("n", "form", "prefix_chars", "middle_chars")], *hashed)


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep_cols=["doc_id"])
    items = F.col("__bd.items")
    return rows.select("doc_id", "__bd.n_words", "__bd.n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("__bd.n_hit") > 0).alias("contaminated"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
