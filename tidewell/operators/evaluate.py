"""Retrieval measures: rank of the first gold document, recall, MRR, found, per kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_K, RECALL_K, POOL = 10, 3, 20


def validate(questions: DataFrame, gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, problem): questions without gold, and gold ids that the corpus lacks.  ``questions(qid)``, ``gold(qid, rowid)``, ``corpus(rowid)``."""
    none = questions.join(gold, "qid", "left_anti").select("qid", F.lit("no gold document").alias("problem"))
    unknown = gold.join(corpus, "rowid", "left_anti").select("qid", F.concat(F.lit("not in the corpus: "), F.col("rowid").cast("string")).alias("problem"))
    return none.unionByName(unknown)


def first_gold_rank(questions: DataFrame, ranked: DataFrame, gold: DataFrame, depth: int = TOP_K) -> DataFrame:
    """``questions`` with ``first_rank``: the smallest rank within ``depth`` whose document is gold, else null."""
    hits = ranked.where(F.col("rank") <= depth).join(gold, ["qid", "rowid"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first_rank"))
    return questions.join(hits, "qid", "left")


def score(ranks: DataFrame, by: str | None = None) -> DataFrame:
    """Recall at 3, MRR, found and the number of questions, overall (kind ``all``) and per ``by``; misses count in all."""
    measures = [
        F.round(F.avg(F.when(F.col("first_rank") <= RECALL_K, 1.0).otherwise(0.0)), 6).alias("recall_at_3"),
        F.round(F.sum(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))) / F.count(F.lit(1)), 6).alias("mrr"),
        F.count("first_rank").alias("found"),
        F.count(F.lit(1)).alias("n"),
    ]
    if by is None:
        return ranks.agg(*measures).select(F.lit("all").alias("kind"), "*")
    return ranks.rollup(by).agg(F.grouping(by).alias("whole"), *measures).select(F.when(F.col("whole") == 1, "all").otherwise(F.col(by)).alias("kind"), "recall_at_3", "mrr", "found", "n")


def misses(ranks: DataFrame) -> DataFrame:
    return ranks.where(F.col("first_rank").isNull() | (F.col("first_rank") > RECALL_K))
