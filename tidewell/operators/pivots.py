"""Exact nearest neighbours that leave vectors unread: stored by nearest pivot, with each pivot's radius.

A query is no nearer to any vector of a pivot than its distance to the pivot less the pivot's radius.  A first pass reads the pivots nearest to
each query, as many as hold ``k`` vectors; the ``k``-th distance found then bounds the second, which reads those pivots alone whose bound
stays below it.  Pivots are folders, so that a pass lists and opens only those that some query needs, and a vector meets only the queries that need its pivot.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .topk import BROADCAST_QUERIES, best

#: Pivots at most; vectors about that settle where they are; rounds of moving them.
MOST_PIVOTS, SAMPLE, ROUNDS = 1024, 20_000, 8
#: Distances are compared to 6 places.
SLACK = 2e-6


class Pivots(NamedTuple):
    """Vectors on disk by pivot."""

    spark: SparkSession
    path: str
    centers: np.ndarray
    radii: np.ndarray
    counts: np.ndarray

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0))


def _centers(sample: np.ndarray, m: int) -> np.ndarray:
    """``m`` places in the middle of their own part of the sample; they only steer, whatever they are results are exact."""
    centers = sample[np.random.default_rng(1).permutation(len(sample))[:m]]
    for _ in range(ROUNDS):
        own = _distances(sample, centers).argmin(1)
        counts = np.bincount(own, minlength=m)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def write_pivots(chunks: DataFrame, path: str) -> Pivots:
    """Store the vectors of ``chunks(rowid, embedding, ..)`` by pivot under ``path``, with all their columns; chunks without a vector are left out.

    Pivots grow with the root of the vectors and come from a bounded sample by hash; every vector is assigned, and the radii are those of all vectors.
    """
    spark = chunks.sparkSession
    rows = chunks.where(F.col("embedding").isNotNull())
    n = rows.count()
    least = min((1 << 63) - 1, (1 << 63) * SAMPLE // max(n, 1))
    found = rows.where(F.shiftrightunsigned(F.xxhash64("rowid"), 1) <= least).select("rowid", "embedding").orderBy("rowid").toPandas()
    sample = np.array(found["embedding"].tolist(), np.float64) if len(found) else np.zeros((1, 1))
    centers = _centers(sample, max(1, min(MOST_PIVOTS, len(sample), int(n**0.5))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), centers)
                own = d.argmin(1)
                yield pdf.assign(away=d[np.arange(len(own)), own], pivot=own.astype(np.int32))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInPandas(assign, f"{fields}, away double, pivot int")
    placed.repartition("pivot", F.pmod(F.xxhash64("rowid"), F.lit(8))).write.partitionBy("pivot").parquet(path)
    radii, counts = np.zeros(len(centers)), np.zeros(len(centers), np.int64)
    if n:
        for r in spark.read.parquet(path).groupBy("pivot").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
            radii[r["pivot"]], counts[r["pivot"]] = r["radius"], r["n"]
    return Pivots(spark, path, centers, radii, counts)


def _scan(index: Pivots, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int, allowed: Column | None) -> DataFrame:
    """(qid, rowid, distance) of the vectors of each pivot with the queries that want it: the best ``k`` of a batch and all that tie with the last."""
    needed = np.flatnonzero(wanted.any(0))
    of, index_centers = {int(p): np.flatnonzero(wanted[:, p]) for p in needed}, index.centers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for pivot, part in pdf.groupby("pivot"):
                mine = of[int(pivot)]
                # Seen from the pivot numbers are small, and so are their errors.
                center = index_centers[pivot]
                d = np.round(_distances(np.stack(part["embedding"].to_numpy()).astype(np.float64) - center, q[mine] - center), 6) + 0.0
                last = np.partition(d, min(k, len(d)) - 1, axis=0)[min(k, len(d)) - 1]
                r, c = np.nonzero(d <= last[None])
                yield pd.DataFrame({"qid": ids[mine][c], "rowid": part["rowid"].to_numpy()[r], "distance": d[r, c]})

    rows = index.vectors().where(F.col("pivot").isin(needed.tolist()))
    return (rows if allowed is None else rows.where(allowed)).select("rowid", "embedding", "pivot").mapInPandas(run, "qid long, rowid long, distance double")


def search_pivots(queries: DataFrame, index: Pivots, k: int = 5, allowed: Column | None = None, report: dict | None = None) -> DataFrame:
    """(qid, rank, rowid, distance) as ``vector.search_l2`` gives it; ``report`` gets the ``share`` of all pairs of a query and a vector that were compared.

    Queries are bounded: more than ``BROADCAST_QUERIES`` are an error, to be asked in several batches.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("qid", "embedding").orderBy("qid").limit(BROADCAST_QUERIES + 1).collect()
    if len(asked) > BROADCAST_QUERIES:
        raise ValueError(f"more than {BROADCAST_QUERIES} queries")
    if not asked or not index.counts.any():
        return index.spark.createDataFrame([], "qid long, rank int, rowid long, distance double")
    ids, q = np.array([r["qid"] for r in asked], np.int64), np.array([r["embedding"] for r in asked], np.float64)
    to = _distances(q, index.centers)
    order = to.argsort(1)
    before = np.cumsum(index.counts[order], axis=1) - index.counts[order]
    first = np.zeros(to.shape, bool)
    np.put_along_axis(first, order, before < k, axis=1)
    first &= index.counts > 0
    found = best(_scan(index, ids, q, first, k, allowed), k, F.col("distance"), F.col("rowid")).select("qid", "rowid", "distance")
    limit = {r["qid"]: r["d"] for r in found.groupBy("qid").agg(F.max("distance").alias("d"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect()}
    reach = np.array([limit.get(int(i), np.inf) for i in ids])
    second = (to - index.radii[None] <= reach[:, None] + SLACK) & ~first & (index.counts > 0)
    if report is not None:
        report["share"] = float(((first | second) * index.counts).sum() / (len(ids) * index.counts.sum()))
    if second.any():
        found = found.unionByName(_scan(index, ids, q, second, k, allowed))
    return best(found, k, F.col("distance"), F.col("rowid")).select("qid", "rank", "rowid", "distance")
