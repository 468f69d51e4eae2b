"""Differences between two snapshots of the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync(old: DataFrame, new: DataFrame, key: str = "task_id") -> DataFrame:
    """(key, change): ``added``, ``removed``, ``changed`` or ``kept`` (an unchanged task keeps its job and its schedule)."""
    cols = [c for c in new.columns if c != key]
    a = old.select(F.col(key), F.struct(*cols).alias("__old"))
    b = new.select(F.col(key), F.struct(*cols).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "kept").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))
