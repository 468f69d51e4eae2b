"""The full-text index: terms, postings and statistics as relations, and stored in parts that only grow and merge.

A part holds one write's chunks in three tables: ``postings``, a row for a term and a slab of rowids with all its postings there, in folders by the term's
hash and sorted by term, so that a search reads the folders and row groups of its terms alone; ``terms``, what the write changed in
each term's number of chunks; and ``forward``, each chunk's terms.  Chunks that a write replaces or deletes are listed in its ``gone``: their postings in
earlier parts no longer count, their terms are subtracted.  So a write touches nothing of the parts before it, and statistics are sums over
parts.  ``Index.merged`` makes one part of all from the forward tables, without tokenising.

A row of postings carries its largest term frequency and its least chunk length, of which any average length makes a bound for its BM25 parts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fts_terms, okapi_tokens
from ..tables import freeing_shuffles

#: Rowids to a row of postings; folders by hash of the term; tokens to a file of postings.
SLAB, BUCKETS, TOKENS_A_FILE = 4096, 16, 4_000_000
#: Terms up to which a search's filter names them, and rows of terms or of gone chunks up to which they are broadcast.
NAMED_TERMS, BROADCAST_ROWS = 1000, 500_000

BLOCKS = "part int, term string, slab long, rows long, top_tf int, least_dl int, posts array<struct<rowid: long, tf: int, dl: int, at: array<int>>>, bucket int"


def tokens_of(chunks: DataFrame, tokenise: Callable[[Column], Column] = fts_terms) -> DataFrame:
    """(rowid, terms) of ``chunks(rowid, content)``."""
    return chunks.select("rowid", tokenise(F.coalesce("content", F.lit(""))).alias("terms"))


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def slabs(posts: DataFrame, key: str = "term") -> DataFrame:
    """Blocks of ``posts(key, rowid, tf, dl, at)``: at most ``SLAB`` postings to a row."""
    return posts.groupBy(key, F.expr(f"rowid div {SLAB}").alias("slab")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("tf").cast("int").alias("top_tf"), F.min("dl").cast("int").alias("least_dl"), F.sort_array(F.collect_list(F.struct("rowid", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"), "at"))).alias("posts"),
    )


def restricted(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` of some ``terms(term)``: by name where they are few, else by a join, whose side is broadcast up to a number of rows."""
    n = terms.limit(BROADCAST_ROWS + 1).count()
    if n <= NAMED_TERMS:
        return rows.where(F.col("term").isin([r["term"] for r in terms.collect()]))
    return rows.join(F.broadcast(terms) if n <= BROADCAST_ROWS else terms, "term", "left_semi")


def blocks_of(tokens: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The postings of ``tokens(rowid, terms)`` as blocks, of all terms or of some."""
    each = tokens.select("rowid", F.size("terms").alias("dl"), F.posexplode("terms").alias("at", "term"))
    each = each if terms is None else restricted(each, terms)
    posts = each.groupBy("term", "rowid").agg(F.first("dl").alias("dl"), F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("at")).alias("at"))
    return slabs(posts)


def blocks_by_slab(tokens: DataFrame, files: int) -> DataFrame:
    """The same of all terms; only the chunks' terms are shuffled, once, in ``files`` parts that hold whole slabs, in which all groups are made."""
    placed = tokens.withColumn("slab", F.expr(f"rowid div {SLAB}")).repartition(files, "slab")
    each = placed.select("slab", "rowid", F.size("terms").alias("dl"), F.posexplode("terms").alias("at", "term"))
    posts = each.groupBy("slab", "term", "rowid").agg(F.first("dl").cast("int").alias("dl"), F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("at")).alias("at"))
    return posts.groupBy("slab", "term").agg(
        F.count(F.lit(1)).alias("rows"), F.max("tf").alias("top_tf"), F.min("dl").alias("least_dl"), F.sort_array(F.collect_list(F.struct("rowid", "tf", "dl", "at"))).alias("posts"),
    )


class Part(NamedTuple):
    """A written part: its folder, its number, and what it adds to the numbers of chunks, tokens and gone chunks."""

    path: str
    seq: int
    docs: int
    tokens: int
    gone: int


class Loose:
    """Chunks without a stored index: postings of the asked terms are made in passing."""

    def __init__(self, chunks: DataFrame, tokenise: Callable[[Column], Column] = fts_terms):
        self.spark, self.tokens = chunks.sparkSession, tokens_of(chunks, tokenise)

    def sizes(self) -> tuple[int, int]:
        """Numbers of chunks and of tokens."""
        row = self.tokens.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("tokens")).first()
        return row["docs"], row["tokens"]

    def blocks(self, terms: DataFrame) -> DataFrame:
        return blocks_of(self.tokens, terms).withColumn("part", F.lit(0))

    def frequencies(self, terms: DataFrame) -> DataFrame | None:
        """(term, df), or None where the blocks' own numbers of rows have it."""
        return None

    def live(self, posts: DataFrame) -> DataFrame:
        """``posts(part, rowid, ..)`` without those of chunks that are gone."""
        return posts


class Index:
    """A stored index: its parts in order of writing.  An object names fixed parts, so it stays as it is whatever is written later."""

    def __init__(self, spark: SparkSession, parts: list[Part], tokenise: Callable[[Column], Column] = fts_terms):
        self.spark, self.parts, self.tokenise = spark, [Part(*p) for p in parts], tokenise

    def _read(self, table: str, schema: str, parts: list[Part] | None = None) -> DataFrame:
        read = [self.spark.read.schema(schema).parquet(f"{p.path}/{table}") for p in (self.parts if parts is None else parts)]
        return reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], schema)

    def sizes(self) -> tuple[int, int]:
        return sum(p.docs for p in self.parts), sum(p.tokens for p in self.parts)

    def _gone(self) -> DataFrame | None:
        """(rowid, until): chunks that parts before number ``until`` no longer hold."""
        parts = [p for p in self.parts if p.gone]
        if not parts:
            return None
        gone = self._read("gone", "rowid long, part int", parts).groupBy("rowid").agg(F.max("part").alias("until"))
        return F.broadcast(gone) if sum(p.gone for p in parts) <= BROADCAST_ROWS else gone

    def live(self, posts: DataFrame) -> DataFrame:
        gone = self._gone()
        return posts if gone is None else posts.join(gone, "rowid", "left").where("until is null or until <= part").drop("until")

    def forward(self) -> DataFrame:
        """(rowid, terms) of all chunks."""
        return self.live(self._read("forward", "part int, rowid long, terms array<string>")).select("rowid", "terms")

    def blocks(self, terms: DataFrame) -> DataFrame:
        """Blocks of some ``terms(term)``, gone chunks included; only their folders are read, and of those, where terms are few, their row groups."""
        return restricted(self._of_buckets("postings", BLOCKS, terms), terms)

    def _of_buckets(self, table: str, schema: str, terms: DataFrame) -> DataFrame:
        wanted = [r[0] for r in terms.select(bucket(F.col("term"))).distinct().collect()]
        return self._read(table, schema).where(F.col("bucket").isin(wanted))

    def frequencies(self, terms: DataFrame) -> DataFrame:
        changes = restricted(self._of_buckets("terms", "term string, df long, bucket int", terms), terms)
        return changes.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def all_frequencies(self) -> DataFrame:
        """(term, df) of the whole index."""
        return self._read("terms", "term string, df long, bucket int").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def _written(self, path: str, seq: int, tokens: DataFrame, sizes: tuple[int, int] | None, changes: Callable[[DataFrame], DataFrame], gone: int) -> Part:
        """The part at ``path``, of ``tokens(rowid, terms)``; ``changes`` makes the part's ``terms(term, df)`` of those that its own postings give."""
        tokens.select(F.lit(seq).alias("part"), "rowid", "terms").write.parquet(f"{path}/forward", compression="zstd")
        new = self.spark.read.schema("part int, rowid long, terms array<string>").parquet(f"{path}/forward")
        docs, n_tokens = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        held = blocks_by_slab(new, max(1, n_tokens // TOKENS_A_FILE)).withColumns({"part": F.lit(seq), "bucket": bucket(F.col("term"))}).sortWithinPartitions("bucket", "term", "slab")
        with freeing_shuffles(self.spark):
            held.select("part", "term", "slab", "rows", "top_tf", "least_dl", "posts", "bucket").write.partitionBy("bucket").parquet(f"{path}/postings", compression="zstd")
        own = self.spark.read.schema(BLOCKS).parquet(f"{path}/postings").groupBy("term").agg(F.sum("rows").alias("df"))
        changed = changes(own).withColumn("bucket", bucket(F.col("term")))
        files = max(1, 8 * n_tokens // TOKENS_A_FILE // 64)
        changed.repartitionByRange(files, "bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
        docs, n_tokens = sizes if sizes else (docs, n_tokens)
        return Part(path, seq, docs, n_tokens, gone)

    def _put_gone(self, gone: DataFrame, path: str, seq: int) -> DataFrame:
        gone.select("rowid", F.lit(seq).alias("part")).distinct().write.parquet(f"{path}/gone")
        return self.spark.read.schema("rowid long, part int").parquet(f"{path}/gone")

    def add(self, tokens: DataFrame, path: str, gone: DataFrame | None = None) -> Index:
        """The index with a further part at ``path``: ``tokens(rowid, terms)``, and without the chunks ``gone(rowid)``, which may come again among the tokens."""
        seq = max((p.seq for p in self.parts), default=0) + 1
        if gone is None or not self.parts:
            return Index(self.spark, [*self.parts, self._written(path, seq, tokens, None, lambda own: own, 0)], self.tokenise)
        listed = self._put_gone(gone, path, seq)
        n_gone = listed.count()
        lost = self.forward().join(F.broadcast(listed) if n_gone <= BROADCAST_ROWS else listed, "rowid", "left_semi")
        lost_docs, lost_tokens = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        minus = lost.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        part = self._written(path, seq, tokens, None, lambda own: own.unionByName(minus).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), n_gone)
        return Index(self.spark, [*self.parts, part._replace(docs=part.docs - lost_docs, tokens=part.tokens - lost_tokens)], self.tokenise)

    def merged(self, path: str, last: int | None = None) -> Index:
        """The same index with its ``last`` parts (by default all) as one, made of their forward tables; the parts before stay as they are."""
        old, late = (self.parts[:-last], self.parts[-last:]) if last is not None else ([], self.parts)
        some, seq = Index(self.spark, late, self.tokenise), max((p.seq for p in late), default=1)
        n_gone = 0
        if old and any(p.gone for p in late):
            # What these parts end in the parts before them.
            n_gone = self._put_gone(self._read("gone", "rowid long, part int", [p for p in late if p.gone]), path, seq).count()
        sums = self._read("terms", "term string, df long, bucket int", late).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        part = self._written(path, seq, some.forward(), some.sizes(), lambda own: sums, n_gone)
        return Index(self.spark, [*old, part], self.tokenise)


def write_index(chunks: DataFrame, path: str, tokenise: Callable[[Column], Column] = fts_terms) -> Index:
    """Store the index of ``chunks(rowid, content)`` as one part under ``path``."""
    return Index(chunks.sparkSession, [], tokenise).add(tokens_of(chunks, tokenise), path)


def lookup(index: Index, terms: list[str]) -> DataFrame:
    """(term, rowid, dl, positions) of some terms."""
    asked = index.spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string")
    posts = index.blocks(asked).select("part", "term", F.inline("posts"))
    return index.live(posts).select("term", "rowid", "dl", F.col("at").alias("positions"))


def term_frequencies(chunks: DataFrame, tokenise=fts_terms) -> DataFrame:
    """(rowid, term, tf, dl): one row per term and chunk; dl is the chunk's length in terms."""
    each = tokens_of(chunks, tokenise).select("rowid", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return each.groupBy("rowid", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def statistics(chunks: DataFrame, tokenise=fts_terms) -> DataFrame:
    """One row: n_docs and avgdl over all chunks."""
    return tokens_of(chunks, tokenise).agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("terms")).alias("avgdl"))


def index_summary(chunks: DataFrame) -> DataFrame:
    """One row: chunks, tokens, distinct terms, average length."""
    tf = term_frequencies(chunks)
    per_term = tf.groupBy("term").agg(F.sum("tf").alias("n")).agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_terms"))
    return statistics(chunks).withColumn("one", F.lit(1)).join(per_term.withColumn("one", F.lit(1)), "one").drop("one")


__all__ = ["Index", "Loose", "Part", "blocks_of", "fts_terms", "index_summary", "lookup", "okapi_tokens", "statistics", "term_frequencies", "write_index"]
