"""Shared plumbing of the training-data operators: tables, shipping, spanning forests, components."""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import discard, materialise

#: Rows of narrow tables for which a file of their own is worth while.
ROWS_A_FILE = 100_000

_shipped: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        if os.path.isdir(root):
            zipped = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tidewell-zip-"), "tidewell"), "zip", root, "tidewell")
            spark.sparkContext.addPyFile(zipped)
            _shipped[app] = zipped


def forest(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Those links that join two groups so far apart; ``label`` holds the groups and is updated."""
    out = []
    while len(i):
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if not len(i):
            break
        # One link per smaller group at a time: hook the larger label to the smaller one.
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        _, first = np.unique(high, return_index=True)
        to = np.arange(len(label))
        to[high[first]] = low[first]
        while (to[to] != to).any():
            to = to[to]
        out += list(zip(i[first].tolist(), j[first].tolist()))
        label[:] = to[label]
    return out


def packed_in(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than its ``rows`` are worth, so that small tables are few files."""
    return df.coalesce(max(8, rows // ROWS_A_FILE))


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """Components of an undirected graph given by ``edges(u, v)``: rows (node, component).

    ``component`` is the smallest node of the component; nodes without an edge to another
    node don't occur.  Each round hooks every node to its smallest neighbour, follows two
    pointers and replaces the graph by its image, so the node count falls geometrically.
    Neighbourhoods are only ever reduced with ``min``, never gathered.
    """
    pair = lambda a, b: [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]
    n = edges.count()
    left = materialise(packed_in(edges.where("u <> v").select(*pair("u", "v")).distinct(), n), f"{tag}-edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = materialise(packed_in(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), n), f"{tag}-hook")
        jump = hook
        for _ in range(2):
            step = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jump = jump.join(step, "p").select("u", F.col("q").alias("p"))
        jump = materialise(packed_in(jump, n), f"{tag}-jump")
        discard(hook)
        if labels is None:
            after = jump.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            moved = jump.select(F.col("u").alias("component"), F.col("p").alias("to"))
            after = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        after = materialise(packed_in(after, n), f"{tag}-labels")
        image = left.join(jump.select("u", F.col("p").alias("pu")), "u").join(jump.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
        image = materialise(packed_in(image.where("pu <> pv").select(*pair("pu", "pv")).distinct(), n), f"{tag}-edges")
        for old in (left, jump, labels):
            discard(old)
        left, labels = image, after
    discard(left)
    return labels if labels is not None else edges.sparkSession.createDataFrame([], "node long, component long")


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots and blanks included."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]
