"""Variable-capacity best-fit packing of texts into training sequences.

Texts are counted in words, or in the token ids of a byte-level BPE vocabulary where one is given, with one end mark each, and cut
into pieces of the largest capacity and a rest.  Pieces are dealt into shards of about ``SHARD_ROWS`` rows or ``SHARD_BYTES`` bytes by a
hash of the row's number and the piece's, so that neither equal rows nor one very long text fill a shard, and each shard is
packed and its sequences are put together in one task.

Within a shard the permitted capacities are chosen jointly by the total cost of all its sequences.  Pieces go, longest first, into the open bin
that they leave the least room in; where none fits, a bin is opened.  One plan opens the size with the least cost per place,
looking ahead to what of the remaining pieces would fill it; further plans open one size throughout (or the least that
fits).  In the end each bin of a plan shrinks to the smallest capacity that holds its contents, and the cheapest plan is taken.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import ship

CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence: its places, a share that grows with the square (attention) and a fixed part.
SQUARE, FIXED = 1 / 16384, 16
SHARD_ROWS, SHARD_BYTES = 2000, 8_000_000
#: Places of the pieces that are handed on together.
BATCH_PLACES = 500_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MEMBERS = "array<struct<doc_id: long, piece: long, start: long, length: long, offset: long>>"


def cost(capacity: int) -> float:
    return capacity * (1 + capacity * SQUARE) + FIXED


def least_fit(n: int, capacities: tuple[int, ...]) -> int:
    return capacities[bisect_left(capacities, n)]


def _fill(room: int, rest: list[int], upto: int) -> int:
    """How much of ``room`` the first ``upto`` of the ascending lengths ``rest`` fill, the largest that fits first."""
    start = room
    while upto and room:
        upto = min(upto, bisect_right(rest, room))
        if upto:
            upto -= 1
            room -= rest[upto]
    return start - room


def _plan(ascending: list[int], order: list[int], capacities: tuple[int, ...], size: int | None) -> tuple[list[tuple[int, int]], list[int]]:
    """Bin and offset of the pieces, longest first, and what each bin holds.  ``size`` is the size to open, or None to look ahead."""
    room: list[tuple[int, int]] = []
    used: list[int] = []
    at: list[tuple[int, int]] = []
    left = len(ascending)
    for _ in order:
        left -= 1
        n = ascending[left]
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            fits = capacities[bisect_left(capacities, n) :]
            if size is not None:
                free = max(size, fits[0])
            else:
                held = {c: n + _fill(c - n, ascending, left) for c in fits}
                free = min(fits, key=lambda c: (cost(least_fit(held[c], capacities)) / held[c], c))
            b = len(used)
            used.append(0)
        at.append((b, used[b]))
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return at, used


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """Per piece of length 1 or more, in the order given: (bin, offset in the bin, the bin's final capacity).

    Ties go to the piece given first, the bin opened first and the first plan: the one that looks ahead, then those with one size, ascending.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    ascending = [lengths[i] for i in reversed(order)]
    best = None
    for size in (None, *capacities):
        at, used = _plan(ascending, order, capacities, size)
        final = [least_fit(u, capacities) for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, at, final
    out: list = [None] * len(lengths)
    for i, (b, offset) in zip(order, best[1]):
        out[i] = b, offset, best[2][b]
    return out


def word_pieces(text: str, most: int) -> list[tuple[int, str]]:
    """(length, text) of each piece of a text in words, its end mark being the last place; pieces keep the white space between their words."""
    n = len(text.encode("utf-8", "surrogatepass").split()) + 1
    if n <= most:
        return [(n, text)]
    cuts = [0, *(m.start() for k, m in enumerate(WORD.finditer(text)) if k and k % most == 0), len(text)]
    parts = [text[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    if (n - 1) % most == 0:
        parts.append("")
    return [(min(most, n - most * k), part) for k, part in enumerate(parts)]


def id_pieces(ids: list[int], end: int, most: int) -> list[tuple[int, np.ndarray]]:
    """(length, ids) of each piece of a text in token ids, its end mark being the last one."""
    whole = np.array([*ids, end], np.int32)
    return [(len(part), part) for part in (whole[a : a + most] for a in range(0, len(whole), most))]


def _pieces(most: int, vocabulary: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = bpe.load(vocabulary) if vocabulary else None
        for pdf in batches:
            out, size = [], 0
            for i, rid, text in zip(pdf["doc_id"].astype("Int64"), pdf["rid"], pdf["text"]):
                text = text or ""
                made = id_pieces(coder.encode(text), coder.end, most) if coder else word_pieces(text, most)
                out += [(i, rid, k, n, part) for k, (n, part) in enumerate(made)]
                size += sum(n for n, _ in made)
                if size >= BATCH_PLACES:
                    yield _piece_frame(out)
                    out, size = [], 0
            if out:
                yield _piece_frame(out)

    return run


def _piece_frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["doc_id", "rid", "piece", "length", "part"])
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    return pdf


def _pack_shard(most: int, ids: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rid", "piece"], kind="stable", ignore_index=True)
        shard = int(pdf["shard"].iloc[0])
        bins: dict[int, list] = {}
        for k, (b, offset, capacity) in enumerate(pack(pdf["length"].astype(int).tolist())):
            bins.setdefault(b, []).append((offset, k, capacity))
        doc, piece, length, part = (pdf[c].tolist() for c in ("doc_id", "piece", "length", "part"))
        out = []
        for b, held in sorted(bins.items()):
            held.sort()
            members = [{"doc_id": None if pd.isna(doc[k]) else int(doc[k]), "piece": piece[k], "start": piece[k] * most, "length": length[k], "offset": offset} for offset, k, _ in held]
            content = np.concatenate([part[k] for _, k, _ in held]) if ids else [part[k] for _, k, _ in held]
            out.append((shard * (1 << 24) + b, held[0][2], sum(length[k] for _, k, _ in held), members, content))
        return pd.DataFrame(out, columns=["bin_id", "capacity", "used", "members", "ids" if ids else "texts"])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per sequence: bin_id, capacity, used, members (doc_id, piece, start, length, offset) and the content in order.

    The content is ``texts``, one for each member (start and length count words, the end mark included), or, with the path of a ``vocabulary``,
    ``ids`` (start and length count ids; the end mark is the id after the last rank).  All texts are packed whole.  A null or empty text is its end mark
    alone.  Rows with null or repeated ids are packed as rows of their own.
    """
    ship(docs.sparkSession)
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    shards = max(1, -(-rows // SHARD_ROWS), -(-(size or 0) // SHARD_BYTES))
    most, part = max(CAPACITIES), "array<int>" if vocabulary else "string"
    numbered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    cut = numbered.mapInPandas(_pieces(most, vocabulary), f"doc_id long, rid long, piece long, length long, part {part}")
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("rid", "piece"), F.lit(shards)))
    content = "ids array<int>" if vocabulary else "texts array<string>"
    return dealt.groupBy("shard").applyInPandas(_pack_shard(most, bool(vocabulary)), f"bin_id long, capacity long, used long, members {MEMBERS}, {content}")
