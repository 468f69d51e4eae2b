"""Writes of the store as relations in, relation out: upsert, replace, delete, vector reuse, ledger, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.masking import mask
from ..functions.vectors import Embedder, embed_udf, finite
from ..schema import REQUIRED


#: Rows numbered in one task; rowids whose hashes are hashed together.
SLAB_ROWS, LEDGER_BLOCK = 1_000_000, 4096


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def checked(chunks: DataFrame, dim: int | None = None) -> DataFrame:
    """``chunks``, failing on rows without a required value or with a vector of another size or of non-finite numbers."""
    missing = None
    for c in REQUIRED:
        missing = F.col(c).isNull() if missing is None else missing | F.col(c).isNull()
    out = chunks.withColumn("id", F.when(missing, F.raise_error(F.lit("a chunk lacks id, source, type or content"))).otherwise(F.col("id")))
    if dim is not None and "embedding" in chunks.columns:
        wrong = F.col("embedding").isNotNull() & ((F.size("embedding") != dim) | ~finite(F.col("embedding")))
        out = out.withColumn("embedding", F.when(wrong, F.raise_error(F.lit(f"a vector is not {dim} finite numbers"))).otherwise(F.col("embedding")))
    return out


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def consecutive(rows: DataFrame, order: str, after: int, slab: int = SLAB_ROWS) -> DataFrame:
    """``rows`` with ``rowid`` from ``after`` + 1 on, in the order of the distinct numbers ``order``.

    Rows are numbered within slabs of about ``slab``, whose bounds are quantiles and whose offsets are the exact counts of the slabs before.
    """
    n = rows.count()
    bounds = sorted(set(rows.approxQuantile(order, [k * slab / n for k in range(1, -(-n // slab))], 0.001))) if n > slab else []
    cut = rows.withColumn("__slab", sum((F.col(order) > b).cast("int") for b in bounds) if len(bounds) < 64 else F.expr(f"size(filter(array({','.join(map(repr, bounds))}), b -> {order} > b))")) if bounds else rows.withColumn("__slab", F.lit(0))
    offsets, total = {}, after
    for r in cut.groupBy("__slab").count().orderBy("__slab").collect() if bounds else []:
        offsets[r["__slab"]], total = total, total + r["count"]
    start = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("__slab")] if offsets else F.lit(after)
    place = F.row_number().over(Window.partitionBy("__slab").orderBy(order))
    return cut.withColumn("rowid", (start + place).cast("long")).drop("__slab")


def changes(store: DataFrame, batch: DataFrame, dim: int | None = None, redact: bool = True, top: int | None = None) -> DataFrame:
    """The rows that ``batch`` (with ``batch_seq``) brings: the last row of an id wins, keeps the stored rowid and created_at; without a vector the old one goes.

    New ids take rowids after ``top``, by default the store's largest one, in order of arrival.
    """
    rows = keep_last(checked(batch, dim), "id", "batch_seq")
    content = mask(F.col("content")) if redact else F.col("content")
    rows = rows.withColumn("content", content).withColumn("content_hash", F.coalesce(F.col("content_hash") if "content_hash" in rows.columns else F.lit(None).cast("string"), content_hash(F.col("content"))))
    old = store.select("id", F.col("rowid").alias("__rowid"), F.col("created_at").alias("__created"))
    new = rows.drop("rowid").join(old, "id", "left")
    # Only rows that are new to the store are numbered.
    top = store.agg(F.coalesce(F.max("rowid"), F.lit(0))).first()[0] if top is None else top
    numbered = consecutive(new.where("__rowid is null"), "batch_seq", top)
    kept = new.where("__rowid is not null").withColumn("rowid", F.col("__rowid"))
    merged = kept.unionByName(numbered.select(*kept.columns)).withColumn("created_at", F.coalesce("__created", "created_at"))
    return merged.select(*store.columns)


def upsert(store: DataFrame, batch: DataFrame, dim: int | None = None, redact: bool = True) -> DataFrame:
    """``store`` after ``batch``, see ``changes``."""
    return store.join(batch.select("id"), "id", "left_anti").unionByName(changes(store, batch, dim, redact))


def delete_source(store: DataFrame, source: str) -> DataFrame:
    return store.where(~F.col("source").eqNullSafe(F.lit(source)))


def check_source(chunks: DataFrame, source: str) -> DataFrame:
    """``chunks`` of exactly one source with distinct ids; anything else is an error."""
    row = chunks.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.count_if(~F.col("source").eqNullSafe(F.lit(source))).alias("other")).first()
    if not row["n"] or row["other"] or row["ids"] != row["n"]:
        raise ValueError("replace needs chunks of one source with distinct ids")
    return chunks


def replace_source(store: DataFrame, source: str, chunks: DataFrame, dim: int | None = None, redact: bool = True) -> DataFrame:
    """``store`` with the chunks of ``source`` replaced by ``chunks``."""
    return upsert(delete_source(store, source), check_source(chunks, source), dim, redact)


def vectors_by_hash(store: DataFrame, source: Column | None = None) -> DataFrame:
    """(content_hash, embedding): of equal hashes the vector of the largest rowid."""
    rows = store if source is None else store.where(F.col("source") == source)
    rows = rows.where(F.col("content_hash").isNotNull() & F.col("embedding").isNotNull())
    return rows.groupBy("content_hash").agg(F.max_by("embedding", "rowid").alias("embedding"))


def embed_missing(chunks: DataFrame, known: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """``chunks`` with vectors: those of equal content hashes are used again, and only the other texts reach the embedder; ``reused`` tells."""
    joined = chunks.drop("embedding").join(known, "content_hash", "left")
    old = joined.where("embedding is not null").withColumn("reused", F.lit(True))
    new = joined.where("embedding is null").withColumn("reused", F.lit(False))
    if embedder is not None:
        new = new.withColumn("embedding", embed_udf(embedder)("content"))
    return old.unionByName(new)


def ledger_upsert(ledger: DataFrame, source: str, type_: str, hash_: str, chunk_count: int, now: float) -> DataFrame:
    spark = ledger.sparkSession
    row = spark.createDataFrame([(source, type_, float(now), hash_, int(chunk_count))], ledger.schema)
    return ledger.where(~F.col("source").eqNullSafe(F.lit(source))).unionByName(row)


def source_ledger(store: DataFrame, now: float) -> DataFrame:
    """One ledger row per source: the hash over hashes of blocks of ``LEDGER_BLOCK`` rowids, each over its chunks' hashes in order of rowid."""
    joined = lambda key: F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct(key, "h")))["h"], ""), 256)
    rows = store.select("source", "type", "rowid", F.col("content_hash").alias("h"), F.expr(f"rowid div {LEDGER_BLOCK}").alias("block"))
    blocks = rows.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"), F.min("type").alias("type"), joined("rowid").alias("h"))
    parts = blocks.groupBy("source").agg(F.sum("n").alias("chunk_count"), F.min("type").alias("type"), joined("block").alias("content_hash"))
    return parts.select("source", "type", F.lit(float(now)).alias("last_indexed"), "content_hash", "chunk_count")


def is_indexed(ledger: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(source, hash)`` with ``indexed``: whether the ledger has that source at that hash."""
    have = ledger.select("source", F.col("content_hash").alias("__have"))
    return asked.join(have, "source", "left").withColumn("indexed", F.col("hash").eqNullSafe(F.col("__have")) & F.col("hash").isNotNull()).drop("__have")


def stats(store: DataFrame) -> DataFrame:
    return store.groupBy("type").agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("vectors"))


def health(store: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, vectors, orphans (vectors beyond the chunks) and ok (unique ids and few orphans)."""
    c = store.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("id").alias("ids")).withColumn("one", F.lit(1))
    v = vectors.agg(F.count(F.lit(1)).alias("vectors")).withColumn("one", F.lit(1))
    out = c.join(v, "one").withColumn("orphans", F.col("vectors") - F.least("vectors", "chunks"))
    ok = (F.col("ids") == F.col("chunks")) & (F.col("orphans") <= F.greatest(F.lit(2), F.floor(F.col("chunks") / 1000)))
    return out.select("chunks", "vectors", "orphans", ok.alias("ok"))
