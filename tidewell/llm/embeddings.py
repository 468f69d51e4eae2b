"""Embedding near-duplicates by int8 tiles with error bounds.

Equal vectors of a label are one representative with a weight.  A label's representatives are dealt into
tiles (``TILE`` to ``MOST_TILE`` rows); each pair of tiles meets in one task.  Rows travel in the type that they are stored in.  There the unit vectors are
rounded to whole multiples of a step of their own (-127..127) and multiplied as whole numbers, which is
exact.  With x = x' + e and y = y' + f, x.y differs from x'.y' by at most |x'||f| + |e||y|, and only
pairs whose product plus that bound reaches the threshold are computed again in double precision.
A task returns link weights per representative and a spanning forest of its links, not the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, forest, materialise, ship

THRESHOLD, BLOCK, PAIRS = 0.98, 256, 50_000
#: Rows of a tile: TILE_SHARE times the square root of a label's rows, within these bounds; each row is sent once a tile of its label.
TILE, MOST_TILE, TILE_SHARE = 2048, 16_384, 16
BROADCAST_LABELS = 100_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rounded rows as float32 whole numbers, their steps, the norms of the rounded vectors and of the errors, of unit rows ``x``."""
    step = np.abs(x).max(1) / 127
    q = np.rint(x / step[:, None])
    back = q * step[:, None]
    return q.astype(np.float32 if x.shape[1] <= 1000 else np.float64), step, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def tile_links(a: np.ndarray, b: np.ndarray | None, threshold: float):
    """Index pairs (i, j) of rows of ``a`` and ``b`` (or i < j within ``a``) with cosine at ``threshold`` or more, block by block."""
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    same = b is None
    b = a if same else b
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    qa, sa, ra, ea = quantise(unit(a))
    qb, sb, rb, eb = quantise(unit(b))
    for at in range(0, len(a), BLOCK):
        rows = slice(at, at + BLOCK)
        near = (qa[rows] @ qb.T) * np.outer(sa[rows], sb)
        near += np.outer(ra[rows], eb) + ea[rows][:, None] + 1e-9
        i, j = np.nonzero(near >= threshold)
        i += at
        if same:
            i, j = i[j > i], j[j > i]
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            found = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= threshold
            yield x[found], y[found]


def _meet(threshold: float):
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = pdf["i"].iloc[0], pdf["j"].iloc[0]
        if ti != tj:
            pdf = pd.concat([pdf[pdf["tile"] == ti], pdf[pdf["tile"] == tj]], ignore_index=True)
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        rid, weight = pdf["rid"].to_numpy(np.int64), pdf["weight"].to_numpy(np.int64)
        n_first = len(pdf) if ti == tj else int((pdf["tile"] == ti).sum())
        links, label, kept = np.zeros(len(pdf), np.int64), np.arange(len(pdf)), []
        if 0 < n_first and (ti == tj or n_first < len(pdf)):
            for i, j in tile_links(x[:n_first], None if ti == tj else x[n_first:], threshold):
                j = j if ti == tj else j + n_first
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                kept += forest(i, j, label)
        some = np.flatnonzero(links)
        out = [(int(rid[k]), int(links[k]), None) for k in some] + [(int(rid[i]), 0, int(rid[j])) for i, j in kept]
        return pd.DataFrame({"rid": [r[0] for r in out], "links": [r[1] for r in out], "other": pd.array([r[2] for r in out], dtype="Int64")})

    return meet


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link with others of the same non-null label and the same dimension.  Null, empty and zero vectors and those with null or
    non-finite components link with nothing: n_links 0, their own id as component, kept.  Equal vectors, also under equal ids, are rows of their own.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding"))
    fine = F.expr("label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(double(x)) and abs(double(x)) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    reps = rows.where("fine").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    reps = materialise(reps.withColumns({"rid": F.monotonically_increasing_id(), "dim": F.size("embedding")}), "emb-reps")
    tile = F.greatest(F.lit(TILE), F.least(F.lit(MOST_TILE), F.sqrt("count") * TILE_SHARE))
    heavy = materialise(reps.groupBy("label", "dim").count().where(F.col("count") > TILE).select("label", "dim", F.ceil(F.col("count") / tile).cast("int").alias("g")), "emb-heavy")
    if heavy.count() <= BROADCAST_LABELS:
        heavy = F.broadcast(heavy)
    dealt = reps.join(heavy, ["label", "dim"], "left").withColumn("g", F.coalesce("g", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rid"), "g").cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("label", "dim", F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"), "tile", "rid", "weight", "embedding")
    met = materialise(dealt.groupBy("label", "dim", "i", "j").applyInPandas(_meet(threshold), "rid long, links long, other long"), "emb-met")
    links = met.groupBy("rid").agg(F.sum("links").alias("links"))
    found = connected_components(met.where("other is not null").select(F.col("rid").alias("u"), F.col("other").alias("v")), "emb")
    full = reps.join(links, "rid", "left").join(found.withColumnRenamed("node", "rid"), "rid", "left")
    full = materialise(full.select("label", "embedding", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("root")), "emb-full")
    for done in (heavy, met, reps, found):
        discard(done)
    least = full.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(full.join(least, "root").select(F.col("label").alias("l"), F.col("embedding").alias("e"), "n_links", "component_id"), "emb-classes")
    joined = rows.join(classes, F.col("fine") & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
