"""Byte-level BPE by backtracking over longest matches, and decoding.

Token bytes are read as Latin-1 text, so that one Aho-Corasick automaton finds, for each place of a
piece, the longest token that starts there.  Encoding goes left to right: take the longest token
whose pairing with the token before it is what merging would produce, else a shorter one,
else step back over a place that has proven a dead end.  Each place is tried with each token that starts
there once at most, so the time is linear in the piece.  Whether two tokens may stand side by side
is found by undoing their merges at the seam, and remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pieces up to this length are remembered, so many at a time; then the memory starts anew.
CACHED_CHARS, CACHED_PIECES = 48, 300_000
#: Pieces of a text handled at once.
BLOCK = 200_000


class Bpe:
    """A vocabulary of ranks (lower merges first) with the pattern that splits text into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        for token, i in ranks.items():
            if len(token) == 1:
                self.parts[i] = (i, i)
            elif len(halves := self._merge(token, i)) == 2:
                self.parts[i] = (ranks[halves[0]], ranks[halves[1]])
        self.automaton = ahocorasick.Automaton()
        for i in self.parts:
            self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        for i in self.parts:
            t = self.bytes[i]
            self.shorter[i] = next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if ranks.get(t[:k]) in self.parts), None)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memory = _Memory(self)
        self.lists = _Lists(self)
        #: The id after the last rank, free for an end mark.
        self.end = max(self.bytes, default=-1) + 1

    def _merge(self, token: bytes, below: int) -> list[bytes]:
        """Plain merging with ranks under ``below``."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves tokens ``a`` and ``b`` apart when they stand side by side."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        # The merge that was done last, on either side, is undone first; no seam merge may rank before the merges still standing.
        limit = 1 << 60
        while True:
            seam = self.ranks.get(self.bytes[a] + self.bytes[b])
            if seam is not None and seam < limit:
                return False
            single_a, single_b = self.size[a] == 1, self.size[b] == 1
            if single_a and single_b:
                return True
            if single_b or (not single_a and a > b):
                limit, a = a, self.parts[a][1]
            else:
                # On equal ranks the left seam merge comes first, hence one above the right token's rank.
                limit, b = b + 1, self.parts[b][0]

    def piece(self, text: str) -> list[int]:
        """The ids of one piece."""
        raw = text.encode("utf-8")
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        latin, n = raw.decode("latin-1"), len(raw)
        longest: list[int] = [0] * n
        size = self.size
        for end, i in self.automaton.iter(latin):
            longest[end + 1 - size[i]] = i
        alive = bytearray(b"\x01" * (n + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if alive[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            less = self.shorter[token]
            if less is not None:
                token = less
                continue
            alive[at] = 0
            token = out.pop()
            at -= size[token]

    def blocks(self, text: str) -> Iterator[list[tuple[str, bytes]]]:
        """Per block of pieces: (ids joined by commas, decoded bytes) of each piece."""
        if len(text) <= BLOCK:
            yield list(map(self.memory.__getitem__, self.pattern.findall(text)))
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, BLOCK)):
            yield list(map(self.memory.__getitem__, some))

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pattern.findall(text) for i in self.lists[p]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Token count, SHA-256 of the ids joined by commas, SHA-256 of the bytes decoded from them."""
        ids_hash, bytes_hash, n = hashlib.sha256(), hashlib.sha256(), 0
        for block in self.blocks(text):
            if block:
                ids = ",".join([x[0] for x in block])
                ids_hash.update((("," if n else "") + ids).encode())
                bytes_hash.update(b"".join([x[1] for x in block]))
                n += ids.count(",") + 1
        return n, ids_hash.hexdigest(), bytes_hash.hexdigest()


class _Memory(dict):
    """Pieces seen before, encoded and decoded."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, text: str) -> tuple[str, bytes]:
        ids = self.bpe.piece(text)
        made = (",".join(map(str, ids)), self.bpe.decode(ids))
        if len(text) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[text] = made
        return made


class _Lists(dict):
    """Ids of pieces seen before."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, text: str) -> list[int]:
        made = self.bpe.piece(text)
        if len(text) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[text] = made
        return made


@lru_cache(maxsize=2)
def load(path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Bpe:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Bpe(ranks, pattern)


def digest_column(path: str = VOCABULARY):
    """A pandas UDF: text to (n_tokens, ids_sha256, decoded_sha256)."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for s in texts:
            yield pd.DataFrame([bpe.digest(x or "") for x in s], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, kind)


def _series_udf(run, kind):
    run.__annotations__ = {"s": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def _new(df: DataFrame, name: str) -> None:
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {name} already; give another name")


def encode(docs: DataFrame, text_col: str = "text", to: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with the array of token ids of each whole text as column ``to``, which must be a new one; null and empty texts have no ids."""
    ship(docs.sparkSession)
    _new(docs, to)

    def run(s):
        bpe = load(path)
        for batch in s:
            yield pd.Series([bpe.encode(x or "") for x in batch])

    return docs.withColumn(to, _series_udf(run, T.ArrayType(T.IntegerType()))(F.col(text_col)))


def decode(rows: DataFrame, ids_col: str = "ids", to: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """``rows`` with the bytes of each array of ids as column ``to``, which must be a new one; null arrays decode to no bytes."""
    ship(rows.sparkSession)
    _new(rows, to)

    def run(s):
        bpe = load(path)
        for batch in s:
            yield pd.Series([bpe.decode([] if x is None else list(x)) for x in batch])

    return rows.withColumn(to, _series_udf(run, T.BinaryType())(F.col(ids_col)))


def digests(docs: DataFrame, text_col: str = "text", keep_cols: list[str] | None = None, path: str = VOCABULARY) -> DataFrame:
    """The columns of ``docs`` (or ``keep_cols``) and ``__b``: n_tokens, ids_sha256, decoded_sha256.  Null texts count as empty."""
    ship(docs.sparkSession)
    cols = docs.columns if keep_cols is None else keep_cols
    return docs.select(*cols, digest_column(path)(F.col(text_col)).alias("__b"))
