"""Best k per query, and the size check before queries are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries up to which a batch goes to every executor.
BROADCAST_QUERIES = 20_000


def best(df: DataFrame, k: int, *order: Column, by: str = "qid", rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each ``by`` in ``order``, numbered from 1; Spark cuts before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def small(queries: DataFrame) -> DataFrame:
    """``queries`` marked for broadcast if there are few enough."""
    return F.broadcast(queries) if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else queries
