"""Exact nearest neighbours of a batch of queries, with filters before the cut.

The queries are the small side: their number is checked, and within the limit they travel with the
task as one matrix, against which chunks are multiplied in tiles of a fixed number of values.  A task keeps the best k per
query, ties by rowid; the cut over all tasks follows.  Beyond the limit the queries go in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import BROADCAST_QUERIES, best

#: Chunks, and distances, that are made at a time.
ROWS, VALUES = 4096, 1_000_000


def id_prefix(prefix: str) -> Column:
    """SQL LIKE of the prefix, ASCII letters in either case; ``%`` and ``_`` in it are wildcards."""
    return F.col("id").ilike(prefix + "%")


def of_type(types: str | Iterable[str] | None) -> Column | None:
    """The filter for chunks of one type, given as a string, or of several; none or no types let all pass."""
    wanted = [types] if isinstance(types, str) else list(types or ())
    return F.col("type").isin(wanted) if wanted else None


def _l2(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * (x @ q.T), 0))


def _cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Zero where a norm is zero."""
    norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
    return np.where(norms == 0, 0.0, (x @ q.T) / np.where(norms == 0, 1.0, norms))


def _scan(ids: np.ndarray, q: np.ndarray, k: int, measure, sign: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.iinfo(np.int64).max
        top, who = np.full((len(q), k), np.inf), np.full((len(q), k), none)
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at : at + ROWS]
                rowid, x = part["rowid"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype(np.float64)
                if x.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors of {x.shape[1]} and {q.shape[1]} numbers")
                step = max(1, VALUES // len(x))
                for lo in range(0, len(q), step):
                    values = sign * np.round(measure(x, q[lo : lo + step]), 6) + 0.0
                    reached = values <= top[lo : lo + step, -1]
                    for c in np.nonzero(reached.any(0))[0]:
                        r = np.nonzero(reached[:, c])[0]
                        value, ident = np.concatenate([top[lo + c], values[r, c]]), np.concatenate([who[lo + c], rowid[r]])
                        first = np.lexsort((ident, value))[:k]
                        top[lo + c], who[lo + c] = value[first], ident[first]
        r, c = np.nonzero(who != none)
        yield pd.DataFrame({"qid": ids[r], "rowid": who[r, c], "value": sign * top[r, c] + 0.0})

    return run


def _nearest(queries: DataFrame, chunks: DataFrame, k: int, allowed: Column | None, measure, sign: int) -> DataFrame:
    rows = chunks.where(F.col("embedding").isNotNull())
    rows = (rows if allowed is None else rows.where(allowed)).select("rowid", "embedding")
    asked = queries.where(F.col("embedding").isNotNull()).select("qid", "embedding")
    blocks = -(-asked.count() // BROADCAST_QUERIES)
    found = []
    for b in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)).orderBy("qid").collect()
        if part:
            ids, q = np.array([r["qid"] for r in part], np.int64), np.array([r["embedding"] for r in part], np.float64)
            found.append(rows.mapInPandas(_scan(ids, q, k, measure, sign), "qid long, rowid long, value double"))
    if not found:
        return chunks.sparkSession.createDataFrame([], "qid long, rowid long, value double")
    return reduce(DataFrame.unionByName, found)


def search_l2(queries: DataFrame, chunks: DataFrame, k: int = 5, allowed: Column | None = None) -> DataFrame:
    """(qid, rank, rowid, distance): the ``k`` chunks nearest to each query, to 6 places, ties by rowid; chunks without a vector never occur."""
    found = _nearest(queries, chunks, k, allowed, _l2, 1).withColumnRenamed("value", "distance")
    return best(found, k, F.col("distance"), F.col("rowid")).select("qid", "rank", "rowid", "distance")


def search_cosine(queries: DataFrame, chunks: DataFrame, k: int = 5, allowed: Column | None = None) -> DataFrame:
    """(qid, rank, rowid, similarity), the most similar first; zero vectors have similarity 0."""
    found = _nearest(queries, chunks, k, allowed, _cosine, -1).withColumnRenamed("value", "similarity")
    return best(found, k, F.desc("similarity"), F.col("rowid")).select("qid", "rank", "rowid", "similarity")
