"""Reranking of candidates by an injected scorer of (query, text) pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .topk import best

TEXT_CHARS = 2000
Scorer = Callable[[list[tuple[str, str]]], list[float]]


class Unavailable(RuntimeError):
    """No model to rerank with."""


def overlap(query: Column, text: Column) -> Column:
    """Distinct words that query and text share: a scorer made of column expressions."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.size(F.array_intersect(words(query), words(F.substring(text, 1, TEXT_CHARS)))).cast("double")


def rerank(candidates: DataFrame, top_k: int = 5, score: Scorer | Column | None = None, strict: bool = False) -> DataFrame:
    """``candidates(qid, rank, query, content, ...)`` ordered by the scorer, best ``top_k`` per query, with ``rerank_score``.

    Without a scorer, the first ``top_k`` go through unscored, or, if ``strict``, an error.  A scorer that fails for a batch
    leaves its rows unscored in their order, or, if ``strict``, fails the query; so does one that returns another count.
    """
    if score is None:
        if strict:
            raise Unavailable("no scorer given")
        return best(candidates.withColumn("rerank_score", F.lit(None).cast("double")), top_k, F.col("rank"), rank="new_rank")
    if isinstance(score, Column):
        scored = candidates.withColumn("rerank_score", score)
    else:

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for query, text in batches:
                pairs = [(q or "", (t or "")[:TEXT_CHARS]) for q, t in zip(query, text)]
                try:
                    got = [float(x) for x in score(pairs)]
                    if len(got) != len(pairs):
                        raise ValueError(f"{len(got)} scores for {len(pairs)} candidates")
                except Exception:
                    if strict:
                        raise
                    got = [None] * len(pairs)
                yield pd.Series(got, dtype="float64")

        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        scored = candidates.withColumn("rerank_score", F.pandas_udf(run, T.DoubleType())("query", "content"))
    return best(scored, top_k, F.desc_nulls_last("rerank_score"), F.col("rank"), rank="new_rank")


def cross_encoder(model_name: str, offline: bool = False) -> Scorer:
    """A cross-encoder's ``predict``, loaded once per Python worker."""
    held: list = []

    def score(pairs: list[tuple[str, str]]) -> list[float]:
        if not held:
            from sentence_transformers import CrossEncoder

            held.append(CrossEncoder(model_name, local_files_only=offline))
        return held[0].predict(pairs)

    return score


def available() -> bool:
    import importlib.util

    return importlib.util.find_spec("sentence_transformers") is not None
