"""Benchmark decontamination by winnowing: words of documents that lie in a window of an item's words.

A word gram's hash is kept where it is the least of some ``W`` grams side by side, in items as in documents.  So two texts that share ``K + W - 1``
words share a kept gram in them: kept grams are joined, and each hit is extended word by word until the texts differ or the
span is long enough.  Items shorter than that are one gram of their own length, and documents' grams of those lengths are looked up as well.

Documents send only grams that may be an item's: a bitmap of the items' hashes, of a size that is bounded whatever the benchmark's, goes to
every task.  What the bitmap lets through by chance the join drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, quoted, ship

#: Words of a gram; grams of which the least is kept.  Shared spans of ``SPAN`` words or more are found.
K, W = 7, 4
SPAN = K + W - 1
#: Bits of the bitmap, as powers of two: for each hash, and at least and at most for all (64 MB).
BITS_A_HASH, LEAST_BITS, MOST_BITS = 10, 18, 29
#: Bytes of a text handled at once; words remembered with their hashes.
BLOCK, REMEMBERED = 1 << 20, 500_000
#: Kept grams of items up to so many rows and characters are broadcast for the join.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 20_000_000

#: A kept gram: its hash, the words that a hit needs, the place of its first word, its words, and those before (nearest first) and after.
GRAM = T.StructType(
    [T.StructField("fp", T.LongType()), T.StructField("need", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("gram", T.StringType()), T.StructField("left", T.ArrayType(T.StringType())), T.StructField("right", T.ArrayType(T.StringType()))]
)
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("grams", T.ArrayType(GRAM))])

#: ASCII: letters in lower case, digits as they are, all else a blank; other bytes stay.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def hashes_of(words: list[bytes], memo: dict) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each ``k`` words side by side."""
    n = len(h) - k + 1
    if n < 1:
        return h[:0]
    g = np.full(n, k, np.uint64)
    for j in range(k):
        g *= np.uint64(0x9E3779B97F4A7C15)
        g += h[j : j + n]
        g ^= g >> np.uint64(31)
    g *= np.uint64(0xD6E8FEB86659FD93)
    return g ^ (g >> np.uint64(32))


def kept_grams(g: np.ndarray, w: int = W) -> np.ndarray:
    """Places of the hashes that are the least of some ``w`` side by side, all equal ones included."""
    if len(g) <= w:
        return np.flatnonzero(g == g.min()) if len(g) else np.arange(0)
    n = len(g) - w + 1
    least = g[:n].copy()
    for j in range(1, w):
        np.minimum(least, g[j : j + n], out=least)
    top = np.zeros(len(g), np.uint64)
    for j in range(w):
        np.maximum(top[j : j + n], least, out=top[j : j + n])
    return np.flatnonzero(g == top)


def _blocks(raw: bytes, carry: int) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first word, words) of a text in blocks; each begins with the last ``carry`` words of the one before."""
    folded, at, place, words = raw.translate(_FOLD), 0, 0, []
    while at < len(folded):
        end = folded.find(b" ", at + BLOCK)
        end = len(folded) if end < 0 else end
        kept = words[-carry:]
        place += len(words) - len(kept)
        words = kept + folded[at:end].split()
        at = end
        yield place, words


def _gram(words: list[bytes], at: int, k: int, need: int, h: int, place: int) -> tuple:
    text = lambda part: [x.decode("utf-8", "replace") for x in part]
    far = need - k
    return int(np.int64(np.uint64(h))), need, place + at, " ".join(text(words[at : at + k])), text(words[max(0, at - far) : at][::-1]), text(words[at + k : at + k + far])


def item_grams(raw: bytes, memo: dict) -> tuple[int, list[tuple]]:
    """Number of words and kept grams of an item."""
    words = raw.translate(_FOLD).split()
    h, n = hashes_of(words, memo), len(words)
    if n < SPAN:
        return n, [_gram(words, 0, n, n, gram_hashes(h, n)[0], 0)] if n else []
    g = gram_hashes(h, K)
    return n, [_gram(words, i, K, SPAN, g[i], 0) for i in kept_grams(g).tolist()]


def text_grams(raw: bytes, memo: dict, bits: np.ndarray, lengths: list[int]) -> tuple[int, list[tuple]]:
    """Number of words of a text, and those of its kept grams, and of all its grams of ``lengths``, whose bits are set."""
    mask, n, out = np.uint64(len(bits) * 8 - 1), 0, []

    def maybe(g: np.ndarray) -> np.ndarray:
        set_ = np.ones(len(g), bool)
        for x in (g & mask, (g >> np.uint64(32)) & mask):
            set_ &= (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return np.flatnonzero(set_)

    # So many words in common that a gram cut off from its neighbours in one block has them in the next.
    for place, words in _blocks(raw, 3 * SPAN):
        h, n = hashes_of(words, memo), place + len(words)
        if len(words) >= SPAN:
            g = gram_hashes(h, K)
            at = kept_grams(g)
            out += [_gram(words, i, K, SPAN, g[i], place) for i in at[maybe(g[at])].tolist()]
        for k in lengths:
            g = gram_hashes(h, k)
            out += [_gram(words, i, k, k, g[i], place) for i in maybe(g).tolist()]
    return n, out


def _grams_udf(find):
    def run(texts):
        memo = _Hashes()
        for batch in texts:
            rows = [find(bytes(x) if x is not None else b"", memo) for x in batch]
            yield pd.DataFrame({"n_words": [n for n, _ in rows], "grams": [[dict(zip(GRAM.names, g)) for g in grams] for _, grams in rows]})

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, FOUND)


def bitmap(grams: DataFrame) -> np.ndarray:
    """A bitmap of the hashes ``fp``, two bits for each: built by the executors in parts of 4 KB, at most 64 MB in all."""
    n = max(1, grams.count())
    power = min(MOST_BITS, max(LEAST_BITS, n.bit_length() + BITS_A_HASH))
    mask = (1 << power) - 1
    bit = grams.select(F.explode(F.array(F.col("fp").bitwiseAND(mask), F.shiftrightunsigned("fp", 32).bitwiseAND(mask))).alias("bit"))
    parts = bit.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
    out = np.zeros(1 << (power - 3), np.uint8)
    for part, bits in parts.toLocalIterator():
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(bytes(bits), np.uint8)[: len(out)]
    return out


def _alike(a: Column, b: Column) -> Column:
    """How many words are equal from the start."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs > 0, differs - 1).otherwise(F.greatest(F.size(a), F.size(b)))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep_cols: list[str] | None = None, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns of ``docs`` (or ``keep_cols``) and ``__bd``: n_words, n_hit, items.

    A word is hit if it lies in ``SPAN`` consecutive words of an item that occur in the text, or in a whole item of fewer words.  ``items`` are the ids, as
    strings in order, of the items with such windows.  Null, empty and wordless texts have no words and no hits, and such items none to find; of
    equal items each is listed; repeated ids are listed once; an item with a null id hits words but is not listed; each row of ``docs`` has its own result.
    """
    spark = docs.sparkSession
    ship(spark)
    each = benchmark.select(F.col(item_id).cast("string").alias("item"), F.explode(_grams_udf(item_grams)(F.col(item_text).cast("binary"))["grams"]).alias("g"))
    items = materialise(each.select("item", *[f"g.{c}" for c in GRAM.names if c != "pos"]).distinct(), "bench-items")
    lengths = sorted(r.need for r in items.where(F.col("need") < SPAN).select("need").distinct().collect())
    bits = spark.sparkContext.broadcast(bitmap(items.select("fp").distinct()))
    found = _grams_udf(lambda raw, memo: text_grams(raw, memo, bits.value, lengths))(F.col(text_col).cast("binary"))
    kept = docs.columns if keep_cols is None else keep_cols
    texts = materialise(docs.select(F.struct(*quoted(kept)).alias("__bd_kept"), found.alias("__bd_found"), F.monotonically_increasing_id().alias("__bd_row")), "bench-texts")

    mine = texts.select("__bd_row", F.explode("__bd_found.grams").alias("g")).select("__bd_row", *[f"g.{c}" for c in GRAM.names])
    theirs = items.select("item", "fp", "need", "gram", F.col("left").alias("left_i"), F.col("right").alias("right_i"))
    rows, chars = items.agg(F.count(F.lit(1)), F.sum(2 * F.length("gram") + F.length("item"))).first()
    theirs = F.broadcast(theirs) if rows <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_CHARS else theirs
    before, after = _alike(F.col("left"), F.col("left_i")), _alike(F.col("right"), F.col("right_i"))
    k = F.when(F.col("need") == SPAN, K).otherwise(F.col("need"))
    hits = mine.join(theirs, ["fp", "need", "gram"]).withColumns({"b": before, "a": after}).where(F.col("b") + k + F.col("a") >= F.col("need"))
    spans = hits.select("__bd_row", "item", (F.col("pos") - F.col("b")).alias("start"), (F.col("pos") + k + F.col("a")).alias("end"))
    so_far = F.max("end").over(Window.partitionBy("__bd_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(so_far, F.lit(0))))
    per_row = spans.withColumn("new", new).groupBy("__bd_row").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    result = F.struct(F.col("__bd_found.n_words").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return texts.join(per_row, "__bd_row", "left").select(*[F.col("__bd_kept").getField(c).alias(c) for c in kept], result.alias("__bd"))
