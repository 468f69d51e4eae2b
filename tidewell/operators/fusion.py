"""Reciprocal rank fusion, the hybrid search with priors, and the weighted in-memory hybrid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import header_date, requested_date
from .bm25 import okapi_scores, search_fts
from .index import Index
from .topk import best
from .vector import search_cosine, search_l2

RRF_K, POOL, RECENCY, IMPORTANCE, HALF_LIFE, NO_DATE_DAYS = 60, 20, 0.15, 0.05, 90.0, 3650.0
# Words that ask for what is recent.
TEMPORAL = r"(?i)\b(recent|latest|current|now|today|yesterday|actuel|maintenant|aujourd'hui|hier)\b"


def rrf_term(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def rrf_scores(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, key, score, place) of ``rankings(qid, list_id, rank, key)``: a key repeated in a list counts each time; ``place`` is the order of first sight."""
    seen = F.struct("list_id", "rank")
    out = rankings.groupBy("qid", "key").agg(F.sum(rrf_term(F.col("rank"), k)).alias("score"), F.min(seen).alias("seen"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("seen"))).drop("seen")


def recency(mtime: Column, metadata: Column, now: Column) -> Column:
    """exp(-age/90 days) of mtime, else of the metadata's timestamp, else of ten years; the future counts as now."""
    stamp = F.unix_micros(F.try_to_timestamp(F.get_json_object(metadata, "$.timestamp"))) / 1e6
    seen = F.when(F.coalesce(mtime, F.lit(0.0)) != 0, mtime).otherwise(stamp)
    days = F.when(seen.isNull(), F.lit(NO_DATE_DAYS)).otherwise(F.greatest(F.lit(0.0), (now - seen) / 86400.0))
    return F.exp(-days / HALF_LIFE)


def importance(metadata: Column) -> Column:
    """The metadata's importance within [0, 1]; 0.5 where it is missing or no number."""
    value = F.get_json_object(metadata, "$.importance").try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(~F.isnan(value), value), F.lit(0.5))))


def _fused(vec: DataFrame | None, fts: DataFrame, k: int) -> DataFrame:
    """Both ranked lists as one row per (qid, rowid), with the ranks and the sum of their terms."""
    right = fts.select("qid", "rowid", F.col("rank").alias("fts_rank"))
    if vec is None:
        both = right.withColumn("vec_rank", F.lit(None).cast("int"))
    else:
        both = vec.select("qid", "rowid", F.col("rank").alias("vec_rank")).join(right, ["qid", "rowid"], "full_outer")
    terms = [F.coalesce(rrf_term(F.col(c), k), F.lit(0.0)) for c in ("vec_rank", "fts_rank")]
    return both.withColumn("rrf_score", terms[0] + terms[1])


def dated_rowids(chunks: DataFrame, dates: DataFrame) -> DataFrame:
    """(qid, rowid): the session chunks whose header has the date that a query asks for, seen in the first 512 characters."""
    sessions = chunks.where(F.col("type").isin("session", "episode")).select("rowid", "type", F.substring("content", 1, 512).alias("head"))
    headed = sessions.withColumn("day", header_date(F.col("type"), F.col("head"))).where("day is not null")
    return headed.join(dates, headed["day"] == dates["date"]).select("qid", "rowid")


def search_hybrid(queries: DataFrame, chunks: DataFrame, now: float, k: int = 5, pool: int = POOL, rrf_k: int = RRF_K, recency_weight: float = RECENCY, importance_weight: float = IMPORTANCE, allowed: Column | None = None, vectors: bool = True, dated: bool = False, index: DataFrame | Index | None = None) -> DataFrame:
    """Vector and full-text lists of depth ``pool`` fused, with recency and importance as small bonuses; one row per hit.

    ``queries`` has qid, text and embedding.  With ``dated``, a query that names one session date ranks the chunks
    of that session first, by their own fusion.  Equal scores keep vector hits first.  ``index`` is the stored index of the chunks, or their rowid and content alone, where there is one.
    """
    vec = search_l2(queries.where("embedding is not null"), chunks, pool, allowed) if vectors else None
    may = None if allowed is None else chunks.where(allowed).select("rowid")
    words = chunks if index is None else index
    fused = _fused(vec, search_fts(queries, words, pool, allowed=may), rrf_k).withColumn("session_date_match", F.lit(False))
    if dated:
        dates = queries.select("qid", requested_date(F.col("text")).alias("date")).where("date is not null")
        hits = dated_rowids(chunks, dates)
        restricted = _restricted(queries, chunks, words, hits, pool, rrf_k, vectors).withColumn("session_date_match", F.lit(True))
        fused = fused.join(restricted.select("qid", "rowid"), ["qid", "rowid"], "left_anti").unionByName(restricted)
    rows = fused.join(chunks.select("rowid", "id", "source", "type", "content", "mtime", "metadata"), "rowid").join(queries.select("qid", F.col("text").rlike(TEMPORAL).alias("temporal")), "qid")
    rows = rows.withColumns({"recency_score": recency(F.col("mtime"), F.col("metadata"), F.lit(now)), "importance_score": importance(F.col("metadata"))})
    weight = F.when(F.col("temporal"), 2 * recency_weight).otherwise(recency_weight)
    bonus = F.lit(1.0 / (rrf_k + 1)) * (weight * F.col("recency_score") + importance_weight * F.col("importance_score"))
    rows = rows.withColumn("final_score", F.round(F.col("rrf_score") + bonus, 9))
    place = F.coalesce(F.col("vec_rank"), pool + F.col("fts_rank"))
    return best(rows, k, F.desc("session_date_match"), F.desc("final_score"), place, F.col("rowid")).drop("temporal")


def _restricted(queries: DataFrame, chunks: DataFrame, words: DataFrame | Index, hits: DataFrame, pool: int, rrf_k: int, vectors: bool) -> DataFrame:
    """The fusion of both searches over each query's own set of chunks; statistics stay those of the whole index."""
    fts = search_fts(queries, words, pool, allowed=hits)
    vec = None
    if vectors:
        from ..functions.vectors import l2

        own = hits.join(queries.where("embedding is not null").select("qid", F.col("embedding").alias("q")), "qid").join(chunks.where("embedding is not null").select("rowid", "embedding"), "rowid")
        vec = best(own.select("qid", "rowid", F.round(l2(F.col("embedding"), F.col("q")), 6).alias("distance")), pool, F.col("distance"), F.col("rowid"))
    return _fused(vec, fts, rrf_k)


def search_weighted(queries: DataFrame, chunks: DataFrame, top_k: int = 10, min_score: float = 0.0, bm25_weight: float = 0.4, vector_weight: float = 0.6, index: DataFrame | Index | None = None) -> DataFrame:
    """In-memory hybrid: the best 2k of each side, each divided by its maximum, added with weights; scores returned are the normalised ones."""
    words = best(okapi_scores(queries, chunks if index is None else index, 2 * top_k).withColumn("s", F.round("score", 6)), 2 * top_k, F.desc("s"), F.col("rowid")).select("qid", "rowid", F.col("s").alias("bm25"))
    near = search_cosine(queries.where("embedding is not null"), chunks, 2 * top_k).where("similarity > 0").select("qid", "rowid", F.col("similarity").alias("vec"))
    both = words.join(near, ["qid", "rowid"], "full_outer")
    per_query = Window.partitionBy("qid")
    share = lambda c: F.coalesce(F.col(c) / F.max(c).over(per_query), F.lit(0.0))
    scored = both.select("qid", "rowid", share("bm25").alias("bm25_score"), share("vec").alias("vector_score"))
    scored = scored.withColumn("combined_score", F.round(bm25_weight * F.col("bm25_score") + vector_weight * F.col("vector_score"), 6)).where(F.col("combined_score") >= min_score)
    return best(scored, top_k, F.desc("combined_score"), F.col("rowid")).select("qid", "rank", "rowid", F.round("bm25_score", 6).alias("bm25_score"), F.round("vector_score", 6).alias("vector_score"), "combined_score")
