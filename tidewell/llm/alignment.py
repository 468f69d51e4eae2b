"""Cross-tokenizer alignment: groups and links between the tokens of two tokenizers, and how often corpus-wide.

Both tokenizers always part where a blank or a line feed follows a letter, digit, sign or punctuation mark.  So a text is cut there into segments,
different segments are tokenised once for the whole corpus, and aligned once, by relations alone: their tokens are exploded with their
places, windows sum their lengths into ends, an equi-join on segment and end finds the cuts, a running count of cuts numbers the groups, and the ends of
both sides in order give the links: between two neighbouring ends lie one token of each side, and no other pair overlaps there.
Texts get their segments' groups and links by joins: with the most frequent segments, up to a number of rows, by broadcast, with the others by a shuffle.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, quoted, ship

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Where segments begin.
SEAM = r"(?=[ \n])(?<=[\p{L}\p{N}\p{P}\p{S}])"
#: Rows that a join broadcasts at most, the most frequent ones, and characters of a segment among them.
HEAD_ROWS, HEAD_CHARS = 200_000, 48
#: A pair of ids as one number below 2^31: A's times this, and B's.
PAIR = 1 << 15
#: Segments tokenised at once, and those of them that are one text; shares of the rows that get their links one after the other.
ROWS, RUN, SHARES = 2000, 256, 3
#: Off: a join on (segment, end) may use a partitioning by segment; lists are gathered from sorted rows, not from a hash table that is sorted, and its sums again, once it is full.
_ALL_KEYS, _HASHED = "spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.execution.useObjectHashAggregateExec"

TOKENS = "seg string, n long, a array<int>, b array<int>"


def _byte_of() -> dict[str, int]:
    """The byte that each character of byte-level vocabularies stands for: itself if it is visible in Latin-1, else the next one from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in seen)}


class Tokenizers:
    """Tokenizer A (byte-level, JSON) and B (pieces with byte fallback), with their tokens' bytes."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        byte_of = _byte_of()
        with open(a_file, encoding="utf-8") as f:
            self.a_bytes = {i: bytes(map(byte_of.__getitem__, t)) for t, i in json.load(f)["model"]["vocab"].items() if all(c in byte_of for c in t)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.blank = self.b.piece_to_id("▁")
        self.b_bytes = {i: piece(i) for i in range(self.b.get_piece_size())}
        if len(self.b_bytes) > PAIR or max(self.a_bytes) * PAIR >= 1 << 31:
            raise ValueError("a pair of ids of these tokenizers is no 31-bit number")
        self.sizes = [np.array([len(known.get(i, b"")) for i in range(max(known) + 1)]) for known in (self.a_bytes, self.b_bytes)]

    def segments(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]] | tuple[None, None]]:
        """Ids by A and B for each segment; nothing where the bytes of either aren't the segment's.

        Segments that seams may part are tokenised as one text, which is cut at their ends; each by itself where that text isn't given back or not parted there.
        """
        runs = _runs(texts)
        for run, made in zip(runs, self._each(["".join(r) for r in runs])):
            yield from [made] if len(run) == 1 else self._cut(run, made) or self._each(run)

    def _cut(self, run: list[str], made: tuple[list[int], list[int]] | tuple[None, None]) -> list[tuple[list[int], list[int]]] | None:
        if made[0] is None:
            return None
        ends, sides = np.cumsum([len(t.encode()) for t in run]), []
        for ids, size in zip(made, self.sizes):
            at = np.cumsum(size[ids])
            last = np.searchsorted(at, ends)
            if (at[last] != ends).any():
                return None
            cuts = [0, *(last + 1).tolist()]
            sides.append([ids[i:j] for i, j in zip(cuts, cuts[1:])])
        return list(zip(*sides))

    def _each(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]] | tuple[None, None]]:
        # B adds a blank, but to nothing at all: it stands for the one that the segment begins with, or else goes again.
        for text, a, b in zip(texts, self.a.encode_batch_fast(texts, add_special_tokens=False), self.b.encode([t.removeprefix(" ") for t in texts], num_threads=1)):
            ids, raw = a.ids, text.encode()
            if text == " ":
                b = [self.blank]
            elif not text.startswith(" "):
                b = b[1:] if self.b_bytes[b[0]] == b" " else []
            same = b"".join(map(self.a_bytes.__getitem__, ids)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            yield (ids, b) if same else (None, None)


def _runs(texts: list[str]) -> list[list[str]]:
    """``texts`` in order, in runs of up to ``RUN`` with a seam between any two neighbours."""
    runs, open_ = [], False
    for t in texts:
        if open_ and len(runs[-1]) < RUN and t[:1] in (" ", "\n"):
            runs[-1].append(t)
        else:
            runs.append([t])
        open_ = unicodedata.category(t[-1])[0] in "LNPS"
    return runs


@lru_cache(maxsize=2)
def load(a_file: str = A_FILE, b_file: str = B_FILE) -> Tokenizers:
    return Tokenizers(a_file, b_file)


def segments_of(text: Column) -> Column:
    """The segments of a text with the blank before it; null for null and empty ones."""
    return F.when(F.length(text) > 0, F.split(F.concat(F.lit(" "), text), SEAM))


def _lists(values: list[list[int] | None]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(x or ()) for x in values]], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(x or () for x in values), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([x is None for x in values]))


def tokenise(segments: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """``segments(seg, n)`` with ``a`` and ``b``, the ids by both tokenizers, null where bytes don't agree."""
    ship(segments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(a_file, b_file)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                made = list(both.segments(batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[_lists([x[k] for x in made]) for k in (0, 1)]], ["seg", "n", "a", "b"])

    return segments.select("seg", "n").mapInArrow(run, TOKENS)


def lengths(spark: SparkSession, a_file: str = A_FILE, b_file: str = B_FILE) -> dict[str, DataFrame]:
    """For each side (token, len), the bytes of every token of its vocabulary."""
    both = load(a_file, b_file)
    return {side: F.broadcast(spark.createDataFrame([(i, len(x)) for i, x in known.items()], f"{side} int, len int")) for side, known in (("a", both.a_bytes), ("b", both.b_bytes))}


@contextmanager
def _off(spark: SparkSession, *settings: str) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in settings}
    for k in settings:
        spark.conf.set(k, "false")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _partial_keys(spark: SparkSession):
    return _off(spark, _ALL_KEYS, _HASHED)


def _ends(tokens: DataFrame, side: str, known: DataFrame) -> DataFrame:
    """(id, end, token) of one side: each token with the sum of the lengths up to it."""
    each = tokens.select("id", F.posexplode(side).alias("pos", side)).join(known, side)
    return each.select("id", F.sum("len").over(Window.partitionBy("id").orderBy("pos")).alias("end"), side)


def align_tokens(tokens: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """``tokens(id, a, b)`` and both sides' ``lengths`` to (id, n_a, n_b, n_groups, groups, links), one row for each id with tokens.

    ``groups`` is ``a1,a2|b1;a3|b2``; ``links`` has a number a * PAIR + b for each pair of overlapping tokens.

    Run within ``_partial_keys`` neither windows nor the join deal the exploded tokens out again; the joined ends are dealt out once.
    """
    tokens = tokens.repartition("id")
    ends = _ends(tokens, "a", known["a"]).join(_ends(tokens, "b", known["b"]), ["id", "end"], "full")
    # From the last end to the first: the token of a side at an end is the last one seen.
    back = Window.partitionBy("id").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    link = (F.last("a", True).over(back) * PAIR + F.last("b", True).over(back)).alias("link")
    # A group ends where tokens of both sides do.
    mark = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), ";").otherwise(",")
    # Strings are made after the shuffle that the windows need, so in a step of their own.
    each = ends.select("id", "end", "a", "b", link).select("*", *[F.concat(F.col(t).cast("string"), mark).alias(f"{t}s") for t in "ab"])
    counts = [F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.col("a") + F.col("b")).alias("n_groups")]
    each = each.groupBy("id").agg(*counts, F.sort_array(F.collect_list(F.struct("end", "link", "as", "bs"))).alias("e"))
    side = lambda t: F.split(F.array_join(f"e.{t}s", ""), ";")
    groups = F.zip_with(side("a"), side("b"), lambda x, y: F.concat(x, F.lit("|"), y))
    return each.select("id", *[F.col(c).cast("int").alias(c) for c in ("n_a", "n_b", "n_groups")], F.array_join(F.slice(groups, F.lit(1), F.col("n_groups").cast("int")), ";").alias("groups"), F.col("e.link").alias("links"))


def _head(table: DataFrame, n: str, rows: int = HEAD_ROWS) -> int:
    """The least power of the square root of two such that at most ``rows`` rows of ``table`` have ``n`` of it or more."""
    level = F.floor(2 * F.log2(n)).cast("int")
    many, least = 0, None
    for r in sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True):
        many += r["count"]
        if many > rows:
            break
        least = r["level"]
    return least if least is not None else 1 << 20


def _parts(table: DataFrame, key: str, n: str, fits: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent rows of ``table``, few enough for a broadcast, and the others, None if there are none."""
    fits = F.lit(True) if fits is None else fits
    level = F.floor(2 * F.log2(n)).cast("int")
    is_head = (level >= _head(table.where(fits), n)) & fits
    tail = table.where(~is_head)
    return table.where(is_head), None if tail.isEmpty() else tail


def _rest(rows: DataFrame, head: DataFrame, tail: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is none of the head's, joined with the tail, which has a row for each key."""
    return rows.join(F.broadcast(head.select(key)), key, "left_anti").join(tail.hint("shuffle_hash"), key)


def align(docs: DataFrame, text_col: str = "text", keep_cols: list[str] | None = None, with_groups: bool = True, a_file: str = A_FILE, b_file: str = B_FILE, with_links: bool = True) -> DataFrame:
    """The columns of ``docs`` (or ``keep_cols``) and ``__al``: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups, links.

    ``groups`` (null unless ``with_groups``) is ``a1,a2|b1;a3|b2``, ids in order; ``links`` (null unless ``with_links``) an array of a * PAIR + b, one for each pair of tokens that overlap.
    A pair's count is the number of rows of ``docs`` that hold it linked; ``count_sum`` sums it over a row's links, and ``n_best`` counts those whose
    count is the highest of their A id.  Null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens:
    zeros, empty groups and links.  Every row has its own result, repeated ones included; further columns pass through unread.
    """
    spark = docs.sparkSession
    cols = quoted(docs.columns if keep_cols is None else keep_cols)
    # Written once: rows keep their numbers however often they are read.
    texts = docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*cols).alias("__kept"), segments_of(F.col(text_col)).alias("__segs"))
    texts = materialise(texts.withColumn("__share", F.pmod(F.xxhash64("__row"), F.lit(SHARES)).cast("int")), "align-rows", by="__share", **{"parquet.enable.dictionary": "false"})
    known = materialise(texts.select(F.explode("__segs").alias("seg")).groupBy("seg").agg(F.count(F.lit(1)).alias("n")), "align-segments")
    tokens = materialise(tokenise(known, a_file, b_file).withColumn("id", F.monotonically_increasing_id()), "align-tokens")
    discard(known)
    with _partial_keys(spark):
        aligned = align_tokens(tokens.where("a is not null").select("id", "a", "b"), lengths(spark, a_file, b_file))
        table = materialise(tokens.select("id", "seg", "n").join(aligned, "id", "left").drop("id"), "align-table")
    discard(tokens)

    made = ["n_a", "n_b", "n_groups"]

    def gathered(part: DataFrame, to: str) -> DataFrame:
        sums = [F.sum(c).alias(f"{to}{c}") for c in made]
        return part.groupBy("__row").agg(*sums, F.count(F.when(F.col("groups").isNull(), 1)).alias(f"{to}bad"), F.collect_list(F.struct("pos", "groups", "links")).alias(f"{to}each"))

    each = lambda rows: rows.select("__row", F.posexplode("__segs").alias("pos", "seg"))
    frequent, rare = _parts(table, "seg", "n", F.length("seg") <= HEAD_CHARS)
    head, tail = frequent.drop("n"), rare.drop("n") if rare is not None else table.drop("n").limit(0)
    added = lambda c: F.coalesce(f"h_{c}", F.lit(0)) + F.coalesce(f"l_{c}", F.lit(0))

    def aligned_texts(own: DataFrame) -> DataFrame:
        """``own`` rows of the texts with their groups and links, a written table."""
        # Rare segments go first, and their shuffles with them; rows are dealt out only for the frequent ones, and stay in place from there on.
        late = materialise(gathered(_rest(each(own), head, tail, "seg"), "l_"), "align-rare")
        rows = gathered(each(own.select("__row", "__segs").repartition("__row")).join(F.broadcast(head), "seg"), "h_")
        rows = own.select("__row", "__kept").join(rows, "__row", "left").join(late, "__row", "left")
        both = F.concat(*[F.coalesce(c, F.array().cast(late.schema["l_each"].dataType)) for c in ("h_each", "l_each")])
        good = added("bad") == 0
        rows = rows.select("__row", "__kept", *[F.when(good, added(c)).otherwise(0).alias(c) for c in made], F.when(good, F.sort_array(both)).otherwise(F.array().cast(late.schema["l_each"].dataType)).alias("each"))
        rows = rows.select("__row", "__kept", *made, F.array_join("each.groups", ";").alias("groups"), F.flatten("each.links").alias("links"))
        digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        rows = materialise(rows.select("__row", "__kept", *made, F.size("links").cast("long").alias("n_links"), digest.alias("groups_sha256"), *[F.col("groups")] * with_groups, "links"), "align-texts")
        discard(late)
        return rows

    # A share of the rows at a time, read from a folder of its own, so that what lies on disk between two steps is a share of it too.
    shares = []
    with _off(spark, _HASHED):
        for k in range(SHARES):
            shares.append(aligned_texts(texts.where(F.col("__share") == k)))
            discard(texts, f"__share={k}")
    rows = reduce(DataFrame.unionByName, shares)
    for done in (table, texts):
        discard(done)

    counts = rows.select(F.explode(F.array_distinct("links")).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    best = F.col("n") == F.max("n").over(Window.partitionBy(F.expr(f"link div {PAIR}")))
    pairs = materialise(counts.select("link", "n", best.cast("int").alias("best")), "align-pairs")
    links = rows.select("__row", F.explode("links").alias("link"))
    frequent, rare = _parts(pairs, "link", "n")
    joined = links.join(F.broadcast(frequent), "link")
    if rare is not None:
        joined = joined.unionByName(_rest(links, frequent, rare, "link").select(joined.columns))
    sums = joined.groupBy("__row").agg(F.sum("n").alias("count_sum"), F.sum("best").alias("n_best"))
    out = rows.join(sums, "__row", "left")
    fields = [*made, "n_links", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256", F.col("groups") if with_groups else F.lit(None).cast("string").alias("groups"), F.col("links") if with_links else F.lit(None).cast("array<int>").alias("links")]
    return out.select(*[F.col("__kept").getField(c).alias(c) for c in (docs.columns if keep_cols is None else keep_cols)], F.struct(*fields).alias("__al"))
