"""Fill-in-middle transformation: texts are cut at two units and their parts put in another order.

One pass over a text's bytes counts its units (``[A-Za-z]+|[^A-Za-z]``) and records the byte and code-point offset of every
``STEP``-th unit.  A cut looks its checkpoint up by binary search and rescans fewer than ``STEP`` units from there, so a text is read
once, whatever its length, and its index takes two numbers for ``STEP`` units.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, ship

#: Units between two checkpoints; bytes counted at once.
STEP, BLOCK = 256, 1 << 18
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are cut; of 100 cut ones so many have the suffix first.
CUT_PERCENT, SPM_PERCENT = 90, 20

RESULT = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.BinaryType())]
)

_UNIT = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xBF][\x80-\xBF]*")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes that go on with a character.
_MORE = bytes(range(0x80, 0xC0))


class Checkpoints:
    """Where the units of a text start: ``n`` units, and a sparse index to find any of them."""

    def __init__(self, raw: bytes, step: int = STEP, block: int = BLOCK):
        self.raw, self.n, self.chars = raw, 0, 0
        units, places, points = [], [], []
        before = False
        for at in range(0, len(raw), block):
            b = np.frombuffer(raw, np.uint8, min(block, len(raw) - at), at)
            letter, first = _LETTER[b], (b & 0xC0) != 0x80
            starts = first.copy()
            starts[1:] &= ~(letter[1:] & letter[:-1])
            starts[0] &= not (before and letter[0])
            before = bool(letter[-1])
            found, count = np.flatnonzero(starts), np.cumsum(first)
            some = found[-self.n % step :: step]
            units.append(self.n + -self.n % step + step * np.arange(len(some)))
            places.append(at + some)
            points.append(self.chars + count[some] - 1)
            self.n, self.chars = self.n + len(found), self.chars + int(count[-1])
        self.units, self.places, self.points = (np.concatenate(x).tolist() if x else [] for x in (units, places, points))

    def find(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset at which ``unit`` starts; the text's end for the number of its units."""
        if unit >= self.n:
            return len(self.raw), self.chars
        k = bisect_right(self.units, unit) - 1
        start = self.places[k]
        place = next(islice(_UNIT.finditer(self.raw, start), unit - self.units[k], None)).start()
        return place, self.points[k] + len(self.raw[start:place].translate(None, _MORE))


def rearrange(raw: bytes, key: str, marks: tuple[bytes, ...], cut_percent: int, spm_percent: int) -> tuple:
    """(units, form, code points of prefix and middle, output) of one text; ``key`` decides the form and the cuts."""
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(key.encode()).digest()[:16])
    index = Checkpoints(raw)
    if not raw or h3 % 100 >= cut_percent or any(m in raw for m in marks):
        return index.n, "plain", None, None, raw
    (p, p_chars), (m, m_chars) = map(index.find, sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
    prefix, middle, suffix = raw[:p], raw[p:m], raw[m:]
    before, after, inner = marks
    spm = h4 % 100 < spm_percent
    out = after + suffix + before + prefix if spm else before + prefix + after + suffix
    return index.n, "spm" if spm else "psm", p_chars, m_chars - p_chars, out + inner + middle


def _checked(marks: tuple[str, ...]) -> tuple[bytes, ...]:
    """Marks that can be told from any text around them: none begins as one of them ends, none lies in another."""
    if len(marks) != 3 or not all(marks) or len(set(marks)) != 3:
        raise ValueError("three different marks are needed: before the prefix, the suffix and the middle")
    for a in marks:
        for b in marks:
            if (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks {a!r} and {b!r} can overlap")
    return tuple(m.encode() for m in marks)


def transform(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_cols: list[str] | None = None, seed: int = 1, marks: tuple[str, str, str] = MARKS, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """The columns of ``docs`` (or ``keep_cols``) and ``__fim``: n (units), form, prefix_chars, middle_chars, output.

    The id and ``seed`` alone decide where a text is cut, so equal rows have equal results and a rerun repeats them.  Null and empty texts
    are plain, with 0 units and an empty output; texts that contain a mark are plain; a null id counts as an empty one.
    Whole texts are cut, of any length; further columns pass through unread.
    """
    ship(docs.sparkSession)
    raw_marks = _checked(marks)

    def run(batches):
        for texts, ids in batches:
            rows = [rearrange(bytes(t) if t is not None else b"", f"{seed}:{'' if i is None else i}", raw_marks, cut_percent, spm_percent) for t, i in zip(texts, ids)]
            yield pd.DataFrame({f: pd.Series(c, dtype=object) for f, c in zip(RESULT.names, zip(*rows) if rows else [[]] * 5)})

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    made = F.pandas_udf(run, RESULT)(F.col(text_col).cast("binary"), F.col(id_col).cast("string"))
    cols = quoted(docs.columns if keep_cols is None else keep_cols)
    out = docs.select(*cols, made.alias("__fim"))
    return out.select(*cols, F.col("__fim").withField("output", F.col("__fim.output").cast("string")).alias("__fim"))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made of: its parts between the marks, in their old order; null for null."""
    part = F.split(output, "|".join(re.escape(m) for m in marks), 4)
    joined = lambda *at: F.concat(*[part[k] for k in at])
    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).when(form == "plain", output)
