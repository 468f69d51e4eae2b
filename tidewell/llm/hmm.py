"""Hidden Markov language model: exact sequence likelihood by the scaled forward recursion.

Words fall into classes: the end mark, ``BUCKETS`` classes of words by their last three bytes, and a class of its own for
each of the most frequent training words, whose number grows with the square root of the training tokens (``LEAST_TOP`` to
``MOST_TOP``).  Hidden states move by a transition matrix and emit classes; a class emits its words in proportion to their
training counts plus one, with one place for unknown words.

Texts are turned into blocks of about ``BLOCK_TOKENS`` tokens with a word list each, where a word is known by 96 bits of
hashes.  Words are counted, and their counts sent back to the blocks by a join, in ``SLICES`` parts by hash, one after the other;
each part's shuffle files go before the next one starts.

Baum-Welch starts from a model of a bounded sample of training text (``SAMPLE_PIECES`` pieces of up to ``SAMPLE_TOKENS``
tokens) and then runs over the whole training part until a round gains less than ``TOLERANCE`` of the log likelihood, ``ROUNDS``
rounds at most; expected counts are added up over partitions as whole multiples of a unit, so the sum doesn't depend on the order.

Sequences are cut into chunks of ``STEPS`` tokens that are swept side by side: a chunk's effect on the state weights is a matrix,
found from each state as a start, and the products of these matrices give each chunk the weights that it starts (and, backwards,
ends) with.  That is the same recursion, exact, without a step of Python for each token of a very long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, ship

STATES, BUCKETS, LEAST_TOP, MOST_TOP = 8, 256, 1024, 60_000
BLOCK_TOKENS, SLICE_TOKENS, STEPS, SCALE_EVERY, SLICES = 500_000, 500_000, 512, 8, 4
SAMPLE_PIECES, SAMPLE_TOKENS, SAMPLE_ROUNDS, ROUNDS, TOLERANCE = 400, 2000, 12, 3, 0.002
FOLDS, HELD_OUT = 7, 2
#: Words of a block are rows of its SLICES parts (``lid`` is a word's number in the block); part -1 has the texts.
BLOCKS = "block long, part int, ids array<long>, held array<boolean>, sizes array<int>, lids binary, own binary, lid array<int>, key1 array<long>, key2 array<long>, train array<int>"
KNOWN = "ids array<long>, held array<boolean>, sizes array<int>, lids binary, classes binary, counts binary"


def packed(a: np.ndarray) -> bytes:
    """An array as compressed bytes, the form in which blocks are kept and sent."""
    return zstandard.compress(a.tobytes(), 3)


def unpacked(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block of texts: their word numbers one after the other, and the words so numbered with their counts in training texts."""
    import uuid

    fresh = lambda: ([], [], [], [], _Numbers(), 0)
    ids, held, sizes, parts, number, total = fresh()

    def rows() -> pd.DataFrame:
        lids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        train = np.repeat(~np.array(held, bool), sizes)
        counts = np.bincount(lids[train], minlength=len(number)) if len(number) else np.zeros(0, np.int64)
        key1, key2 = keys(list(number))
        slot = key1.view(np.uint64) % SLICES
        block = uuid.uuid4().int >> 65
        out = [[block, -1, ids, held, sizes, packed(lids), packed(np.stack([counts, key2 >> 32]).astype(np.int32)), None, None, None, None]]
        for k in range(SLICES):
            lid = np.flatnonzero(slot == k)
            if len(lid):
                out.append([block, k, None, None, None, None, None, lid, key1[lid], key2[lid], counts[lid]])
        return pd.DataFrame(out, columns=["block", "part", "ids", "held", "sizes", "lids", "own", "lid", "key1", "key2", "train"])

    for pdf in batches:
        for i, h, text in zip(pdf["id"], pdf["held"], pdf["text"]):
            words = tokens(text)
            parts.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
            ids.append(None if pd.isna(i) else int(i))
            held.append(bool(h))
            sizes.append(len(words))
            total += len(words) + 1
            if total >= BLOCK_TOKENS:
                yield rows()
                ids, held, sizes, parts, number, total = fresh()
    if ids:
        yield rows()


class _Numbers(dict):
    """Words, numbered as they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that stand for each word: 64 bits of its XXH3, and 32 more beside its class among the less frequent words."""
    hashed = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2).astype(np.uint64)
    bucket: dict[bytes, int] = {}
    classes = np.array([bucket.get(w[-3:]) or bucket.setdefault(w[-3:], bucket_of(w)) for w in words], np.int64)
    return hashed[:, 0].view(np.int64), classes << 32 | (hashed[:, 1] >> np.uint64(32)).astype(np.int64)


def bucket_of(word: bytes) -> int:
    """The class of a word that is not among the most frequent ones."""
    return 1 + crc32(word[-3:]) % BUCKETS


class Cut(NamedTuple):
    """Sequences, lying one after the other, in chunks: each chunk's place, size, sequence and number within it; each sequence's first chunk and chunk count."""

    at: np.ndarray
    size: np.ndarray
    seq: np.ndarray
    nth: np.ndarray
    head: np.ndarray
    n: np.ndarray


def cut(sizes: np.ndarray) -> Cut:
    n = -(-sizes // STEPS)
    seq = np.repeat(np.arange(len(sizes)), n)
    head = np.cumsum(n) - n
    nth = np.arange(len(seq)) - head[seq]
    return Cut((np.cumsum(sizes) - sizes)[seq] + nth * STEPS, np.minimum(STEPS, sizes[seq] - nth * STEPS), seq, nth, head, n)


class Lay(NamedTuple):
    """Chunks side by side, longest first: their order, how many are longer than t for each t, and their classes place by place (all first places, all second ones, ...)."""

    order: np.ndarray
    active: list[int]
    classes: np.ndarray


def lay(at: np.ndarray, size: np.ndarray, classes: np.ndarray) -> Lay:
    order = np.argsort(-size, kind="stable")
    active = (len(size) - np.searchsorted(size[order][::-1], np.arange(size.max(initial=0)), side="right")).tolist()
    place = at[order]
    flat = np.concatenate([place[:n] + t for t, n in enumerate(active)]) if active else np.zeros(0, np.int64)
    return Lay(order, active, classes[flat])


def _sweep(pre: np.ndarray, x: Lay, model: dict, alphas: np.ndarray | None = None):
    """Run through chunks side by side; ``pre`` has the state weights before the first emission.  Weights are scaled to a sum of one at every SCALE_EVERY-th place.

    Returns the state weights at each chunk's end, scaled, the last scales, the logs of all scales, and the scales by t; fills ``alphas`` place by place.
    """
    emit, move = np.ascontiguousarray(model["emit"].T), model["move"]
    ends, logs, scales, at = np.array(pre[x.order]), np.zeros(len(x.order)), {}, 0
    for t, n in enumerate(x.active):
        alpha = emit.take(x.classes[at : at + n], axis=0)
        alpha *= ends if t == 0 else ends[:n] @ move
        if t % SCALE_EVERY == SCALE_EVERY - 1:
            scales[t] = scale = alpha.sum(1)
            alpha /= scale[:, None]
            logs[:n] += np.log(scale)
        ends[:n] = alpha
        if alphas is not None:
            alphas[at : at + n] = alpha
        at += n
    tails = ends.sum(1)
    ends /= tails[:, None]
    out = np.empty_like(ends), np.empty_like(tails), np.empty_like(logs)
    out[0][x.order], out[1][x.order], out[2][x.order] = ends, tails, logs + np.log(tails)
    return *out, scales


def _starts(classes: np.ndarray, c: Cut, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per chunk the weights before its first emission and its matrix (unused for first chunks); the sequences of several chunks, most chunks first."""
    k = len(model["start"])
    pre = np.tile(model["start"], (len(c.at), 1))
    through = np.zeros((len(c.at), k, k)) if (c.nth > 0).any() else np.zeros((0, k, k))
    several = np.flatnonzero(c.n > 1)
    several = several[np.argsort(-c.n[several], kind="stable")]
    if len(several):
        later = np.flatnonzero(c.nth > 0)
        ends, _, logs, _ = _sweep(np.tile(model["move"], (len(later), 1)), lay(np.repeat(c.at[later], k), np.repeat(c.size[later], k), classes), model)
        logs = logs.reshape(-1, k)
        through[later] = np.exp(logs - logs.max(1, keepdims=True))[:, :, None] * ends.reshape(-1, k, k)
        heads = c.head[several]
        a = _sweep(pre[heads], lay(c.at[heads], c.size[heads], classes), model)[0]
        for j in range(1, int(c.n.max())):
            here = c.head[several[c.n[several] > j]] + j
            a = a[: len(here)]
            pre[here] = a @ model["move"]
            a = np.einsum("ns,nst->nt", a, through[here])
            a /= a.sum(1, keepdims=True)
    return pre, through, several


def forward(classes: np.ndarray, sizes: np.ndarray, model: dict) -> np.ndarray:
    """Natural log likelihood of each sequence; sequences have a token or more."""
    c = cut(sizes)
    logs = _sweep(_starts(classes, c, model)[0], lay(c.at, c.size, classes), model)[2]
    return np.bincount(c.seq, weights=logs, minlength=len(sizes))


def slices(classes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of like length together, about ``SLICE_TOKENS`` places at a time: (their numbers, classes, sizes)."""
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes)
    upto = np.cumsum(sizes[order])
    cuts = np.flatnonzero(np.diff(upto // SLICE_TOKENS)) + 1
    for some in np.split(order, cuts):
        if len(some):
            yield some, np.concatenate([classes[ends[i] - sizes[i] : ends[i]] for i in some]), sizes[some]


def expected(classes: np.ndarray, sizes: np.ndarray, model: dict) -> np.ndarray:
    """Expected counts of starts, moves and emissions, one after the other, and last the log likelihood."""
    k, n_classes = model["emit"].shape
    start, move, emits, log = np.zeros(k), np.zeros((k, k)), np.zeros((k, n_classes)), 0.0
    if len(classes):
        c = cut(sizes)
        pre, through, several = _starts(classes, c, model)
        x, alphas = lay(c.at, c.size, classes), np.empty((len(classes), k))
        ends, tails, logs, scales = _sweep(pre, x, model, alphas)
        log = logs.sum()
        last = np.repeat(1 / tails[:, None], k, axis=1)
        for j in range(int(c.n.max()) - 1, 0, -1):
            here = c.head[several[c.n[several] > j]] + j
            b = np.einsum("nst,nt->ns", through[here], last[here])
            last[here - 1] = b / ((ends[here - 1] * b).sum(1) * tails[here - 1])[:, None]
        last = last[x.order]
        emit, back = np.ascontiguousarray(model["emit"].T), np.ascontiguousarray(model["move"].T)
        ahead, at = np.zeros((0, k)), len(x.classes)
        # ``ahead`` has the weights of the next place's states, its emission included.
        for t in range(len(x.active) - 1, -1, -1):
            n, later = x.active[t], len(ahead)
            at -= n
            beta = np.concatenate([ahead @ back, last[later:n]]) if later else last[:n]
            if later:
                move += alphas[at : at + later].T @ ahead
            ahead = emit.take(x.classes[at : at + n], axis=0)
            ahead *= beta
            if t in scales:
                ahead /= scales[t][:, None]
            alphas[at : at + n] *= beta
        nth = c.nth[x.order]
        move += ends[x.order[nth > 0] - 1].T @ ahead[nth > 0]
        start = alphas[: len(nth)][nth == 0].sum(0)
        move *= model["move"]
        for s in range(k):
            emits[s] = np.bincount(x.classes, weights=alphas[:, s], minlength=n_classes)
    return np.concatenate([start, move.ravel(), emits.ravel(), [log]])


def estimate(counts: np.ndarray, k: int) -> dict:
    """The model of expected counts, smoothed so that nothing is impossible."""
    norm = lambda x: x / x.sum(-1, keepdims=True)
    move, emits = counts[k : k + k * k].reshape(k, k), counts[k + k * k : -1].reshape(k, -1)
    whole = emits.sum(0) + 0.1
    return {"start": norm(counts[:k] + 1.0), "move": norm(move + 0.5), "emit": norm(emits + whole / whole.sum() * 50 + 1e-3)}


def first_model(classes: np.ndarray, sizes: np.ndarray, n_classes: int, seed: int = 5) -> dict:
    """Baum-Welch on a small sample from a random start with sticky states."""
    rng = np.random.default_rng(seed)
    k = STATES
    seen = np.bincount(classes, minlength=n_classes) + 0.5
    model = {"start": np.full(k, 1 / k), "move": np.full((k, k), 0.1 / (k - 1)), "emit": seen * (0.5 + rng.random((k, n_classes)))}
    np.fill_diagonal(model["move"], 0.9)
    model["emit"] /= model["emit"].sum(1, keepdims=True)
    for _ in range(SAMPLE_ROUNDS if len(classes) else 0):
        model = estimate(sum(expected(c, n, model) for _, c, n in slices(classes, sizes)), k)
    return model


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block with the training count and the class of each of its words.

    A word's own count and class hold, but for those that the block's other rows list: words that other blocks have too or that are frequent.
    """
    row = pdf[pdf["part"] < 0].iloc[0]
    counts, classes = unpacked(row["own"], np.int32).reshape(2, -1).astype(np.int64)
    for lid, c, top in pdf.loc[pdf["part"] >= 0, ["lid", "c", "top"]].itertuples(index=False):
        lid, top = np.asarray(lid, np.int64), np.asarray(top, np.int64)
        counts[lid] = c
        classes[lid[top > 0]] = top[top > 0]
    return pd.DataFrame({"ids": [row["ids"]], "held": [row["held"]], "sizes": [row["sizes"]], "lids": [row["lids"]], "classes": [packed(classes.astype(np.uint16))], "counts": [packed(counts)]})


def _with_end(lids: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class sequences with the end mark (class 0) after each text."""
    ends = np.cumsum(sizes + 1) - 1
    out = np.zeros(int((sizes + 1).sum()), np.int64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = classes[lids]
    return out, sizes + 1


def _sequences(row, training_only: bool):
    lids, sizes = unpacked(row.lids, np.uint32), np.array(row.sizes, np.int64)
    if training_only:
        train = ~np.array(row.held, bool)
        lids, sizes = lids[np.repeat(train, sizes)], sizes[train]
    return _with_end(lids, sizes, unpacked(row.classes, np.uint16).astype(np.int64))


def _expect(model: dict, unit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                for _, classes, sizes in slices(*_sequences(row, True)):
                    got = expected(classes, sizes, model)
                    total = got if total is None else total + got
        if total is not None:
            some = np.flatnonzero(total)
            yield pd.DataFrame({"at": some, "n": np.rint(total[some] * unit).astype(np.int64)})

    return run


def _score(model: dict, totals: np.ndarray, n_train: int, n_types: int, end_count: int):
    # Per class the tokens and words that share it; the end mark and the frequent words have a class each.
    bottom = np.log10(totals)
    base_bottom = np.log10(n_train + n_types + 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                lids, sizes = unpacked(row.lids, np.uint32), np.array(row.sizes, np.int64)
                counts, classes = unpacked(row.counts, np.int64), unpacked(row.classes, np.uint16).astype(np.int64)
                seq, with_end = _sequences(row, False)
                hidden = np.zeros(len(with_end))
                for some, part, lengths in slices(seq, with_end):
                    hidden[some] = forward(part, lengths, model) / np.log(10.0)
                log_counts = np.log10(counts + 1.0)
                within = np.where(classes > BUCKETS, 0.0, log_counts - bottom[np.minimum(classes, BUCKETS)])
                per = np.stack([log_counts, within, counts > 0])
                sums = np.zeros((3, len(sizes)))
                whose = np.repeat(np.arange(len(sizes)), sizes)
                for r in range(3):
                    sums[r] = np.bincount(whose, weights=per[r][lids], minlength=len(sizes)) if len(lids) else 0.0
                base = sums[0] + np.log10(end_count + 1.0) - with_end * base_bottom
                yield pd.DataFrame({
                    "doc_id": pd.array(list(row.ids), dtype="Int64"), "held_out": np.array(row.held, bool), "n_tokens": with_end, "n_known": sums[2].astype(np.int64) + int(end_count > 0),
                    "train_tokens": n_train, "base_score": base, "score": hidden + sums[1],
                })

    return run


def _frequent(counted: DataFrame, n_train: int) -> list:
    """The most frequent words (key1, key2, c), as many whole steps of frequency as the model has room for; a step is a 64th of a power of two."""
    room = min(max(LEAST_TOP, int(n_train**0.5)), MOST_TOP)
    low = F.expr("greatest(length(bin(c)) - 7, 0)")
    steps = counted.withColumn("low", low).select(F.expr("shiftleft(shiftright(c, low), low)").alias("step"))
    least, total = None, 0
    for r in sorted(steps.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > room:
            break
        least = r["step"]
    return [] if least is None else sorted(counted.where(F.col("c") >= least).collect(), key=lambda r: (-r["c"], r["key1"], r["key2"]))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(id as text) mod 7 is 2 are held out of training; a null id counts as an empty one.  Null and
    empty texts are their end mark alone.  Repeated rows count repeatedly.  Without training texts all words are unknown.
    """
    spark = docs.sparkSession
    ship(spark)
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (crc % FOLDS == HELD_OUT).alias("held"), F.col(text_col).alias("text"))
    blocks = materialise(rows.mapInPandas(_blocks, BLOCKS), "hmm-blocks", by="part", **{"parquet.enable.dictionary": "false"})
    texts, both = blocks.where("part = -1"), ["key1", "key2"]

    def words(k: int) -> DataFrame:
        w = blocks.where(F.col("part") == k).select("block", F.explode(F.arrays_zip("lid", "key1", "key2", "train")).alias("w"))
        return w.select("block", "w.lid", "w.key1", "w.key2", F.col("w.train").alias("n"))

    counted = [materialise(words(k).where("n > 0").groupBy(*both).agg(F.sum("n").alias("c")), "hmm-counts") for k in range(SLICES)]
    every = counted[0]
    for c in counted[1:]:
        every = every.unionByName(c)
    totals, types = np.ones(1 + BUCKETS), np.zeros(1 + BUCKETS)
    for r in every.groupBy(F.shiftright("key2", 32).cast("int").alias("bucket")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        totals[r["bucket"]], types[r["bucket"]] = r["c"] + 1, r["v"]
    end_count = int(texts.agg(F.sum(F.expr("size(filter(held, x -> not x))"))).first()[0] or 0)
    n_train, n_types = int(totals.sum()) - len(totals) + end_count, int(types.sum()) + (end_count > 0)
    top = _frequent(every, n_train)
    for r in top:
        totals[r["key2"] >> 32] -= r["c"]
        types[r["key2"] >> 32] -= 1
    totals += types
    totals[0] = 1.0
    n_classes = 1 + BUCKETS + len(top)

    # A word of one block has the block's own count; counts of the others come by a join, but for the frequent ones, which are at most MOST_TOP and in every block.
    listed = F.broadcast(spark.createDataFrame([(r["key1"], r["key2"], 1 + BUCKETS + k, r["c"]) for k, r in enumerate(top)], "key1 long, key2 long, top int, c long"))
    found = []
    for k in range(SLICES):
        # Frequent words have their count; they go through the join under keys of their own, which spread them and match nothing.
        asked = words(k).join(listed, both, "left").withColumn("key1", F.when(F.col("top").isNull(), F.col("key1")).otherwise(F.xxhash64("block", "lid")))
        known = asked.join(counted[k].withColumnRenamed("c", "sent"), both, "left").where("top is not null or sent <> n")
        known = known.select("block", "lid", F.coalesce("c", "sent").alias("c"), F.coalesce("top", F.lit(0)).alias("top"))
        per_block = known.groupBy("block").agg(F.collect_list(F.struct("lid", "c", "top")).alias("w")).select("block", "w.lid", "w.c", "w.top")
        found.append(materialise(per_block, "hmm-words"))
        discard(counted[k])
        discard(blocks, f"part={k}")
    meet = texts.select("block", "part", "ids", "held", "sizes", "lids", "own")
    for f in found:
        meet = meet.unionByName(f.withColumn("part", F.lit(0)), allowMissingColumns=True)
    known_blocks = materialise(meet.groupBy("block").applyInPandas(_resolve, KNOWN), "hmm-known")
    for done in (blocks, *found):
        discard(done)

    unit = 1 << max(0, min(20, 58 - n_train.bit_length()))
    model = first_model(*_sample(known_blocks), n_classes)
    before = None
    for _ in range(ROUNDS):
        sums = known_blocks.select("held", "sizes", "lids", "classes").mapInPandas(_expect(model, unit), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(STATES + STATES**2 + STATES * n_classes + 1)
        for r in sums:
            counts[r["at"]] = r["n"] / unit
        if not sums:
            break
        model = estimate(counts, STATES)
        if before is not None and counts[-1] - before < TOLERANCE * abs(before):
            break
        before = counts[-1]
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return known_blocks.mapInPandas(_score(model, totals, n_train, n_types, end_count), out)


def _pieces(least: int):
    """Training sequences, the longer ones in pieces of up to SAMPLE_TOKENS tokens: those whose hash is up to ``least``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                seq, sizes = _sequences(row, True)
                ends = np.cumsum(sizes)
                out = {}
                for e, n in zip(ends.tolist(), sizes.tolist()):
                    for a in range(e - n, e, SAMPLE_TOKENS):
                        x = seq[a : min(e, a + SAMPLE_TOKENS)].astype(np.int32).tobytes()
                        key = xxhash.xxh64_intdigest(x) >> 1
                        if key <= least:
                            out[x] = key
                yield pd.DataFrame({"key": list(out.values()), "seq": list(out)})

    return run


def _sample(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """About SAMPLE_PIECES different pieces of training sequences: twice that many pass a threshold on their hashes, those with the smallest hashes are taken."""
    counted = F.expr(f"aggregate(zip_with(sizes, held, (n, h) -> if(h, 0L, cast(ceil((n + 1) / {SAMPLE_TOKENS}) as bigint))), 0L, (a, x) -> a + x)")
    total = blocks.agg(F.sum(counted)).first()[0] or 0
    least = int(min(1.0, 2 * SAMPLE_PIECES / max(total, 1)) * ((1 << 63) - 1))
    rows = blocks.select("held", "sizes", "lids", "classes").mapInPandas(_pieces(least), "key long, seq binary").distinct().collect()
    seqs = [np.frombuffer(bytes(r["seq"]), np.int32).astype(np.int64) for r in sorted(rows, key=lambda r: (r["key"], bytes(r["seq"])))[:SAMPLE_PIECES]]
    return (np.concatenate(seqs) if seqs else np.zeros(0, np.int64)), np.array([len(s) for s in seqs], np.int64)
