"""SimHash near-duplicates, linked through vantage-point trees over Hamming distance.

A ``Kind`` says how texts become fingerprints and when two of them link.  ``NARROW`` has 64 bits over shingles of four words and
links at 4 or fewer differing bits.  ``WIDE`` has 256 bits over the set of a text's shingles of five words and links at 52 or fewer: differing
bits follow the angle between the shingle sets, so that 39 are expected at a Jaccard similarity of 0.8 and 128 for unrelated texts.
Links of WIDE are candidates: ``keep_one`` compares the shingle sets of both texts and drops those below ``SIMILARITY``.
The forest of candidates stands for links that it leaves out only as long as all of it holds, so where one is dropped, all texts of that group are compared with each other.

A fingerprint is cut into words.  If two fingerprints link, some word of theirs is likely to differ by ``reach`` bits at most, so
there is one vantage-point tree per word, searched with that radius, and the full distance then decides.  NARROW has two words
and reach 2, which misses nothing (4 bits can't put 3 into both halves).  WIDE has sixteen words and reach 1, which misses
nothing up to 31 differing bits, about 1 pair in 200 at 39 and 1 in 25 at 52.  Searching words matters: distances between whole random fingerprints
all lie so near to half the bits that a radius hardly prunes.

The trees are grown on the driver from a bounded sample of fingerprints and only steer where
rows go.  Every distinct fingerprint is a resident of one leaf of each tree, and a guest of
each leaf whose triangle bounds leave room for a link to a resident; a leaf's rows meet in
one task.  Guests meet residents only; a leaf with more than ``LEAF_CAP`` residents (or ``GUEST_CAP``
guests) is cut into chunks, and each pair of resident chunks and each resident with each guest chunk meet in a task of their own.
Inside a leaf only words that agree in one of ``reach`` + 1 parts are compared (words within reach agree in one).

Leaves hold about ``LEAF_SHARE`` times the square root of the number n of fingerprints: random words visit
leaves in numbers that grow with about the square root of n / leaf, so that rows sent grow as n**1.25 until leaves reach
LEAF_CAP (at some 70 million different fingerprints); beyond that copies for chunks add up to n**0.5 more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, discard, forest, materialise, packed_in, quoted, ship

SEED, LEAF_ROWS, LEAF_SHARE, LEAF_CAP, GUEST_CAP, SAMPLE = 42, 1024, 32, 262_144, 524_288, 32768
#: Characters and texts that meet in one task, twice as many in groups larger than that, when texts are compared in full.
CELL_CHARS, CELL_ROWS = 2_000_000, 4096
#: Rows and columns compared at once inside a leaf.
BLOCK_ROWS, BLOCK_COLS = 256, 1024


class Kind(NamedTuple):
    """Fingerprints (8 * ``longs`` bytes, highest bit first), cut into words of ``bits`` bits, linked at ``radius`` or fewer differing bits.

    Links are sought at each of ``steps`` in turn, the last of which is the radius, so that the spanning forest prefers near ones.
    """

    fingerprint: Callable[[str | None], bytes]
    longs: int
    bits: int
    reach: int
    steps: tuple[int, ...]

    @property
    def radius(self) -> int:
        return self.steps[-1]


def fingerprint(text: str | None, shingle: int = 4) -> bytes:
    """64 bits over shingles with repeats; zero for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts, seen = np.zeros(64, np.int64), 0
    for at in range(0, n, 65536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], ">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        seen += len(h)
    return np.packbits(2 * counts > seen).tobytes()


def _mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers, scattered."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


#: For each byte, its bits one to a byte: sums of up to 255 of them count eight bits at once.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The hashes of a text's different shingles, in order; fewer words are one shingle; none for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    each = np.array([xxhash.xxh64_intdigest(w, SEED) for w in number], np.uint64)[ids]
    n = max(1, len(words) - shingle + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(words))):
        h = _mixed(h + np.uint64(0x9E3779B97F4A7C15)) ^ each[k : k + n]
    return np.unique(h)


def wide_fingerprint(text: str | None, shingle: int = 5, longs: int = 4) -> bytes:
    """256 bits over the set of shingles; zero for a text without words."""
    h = shingle_set(text, shingle)
    if not len(h):
        return bytes(8 * longs)
    counts = np.zeros(64 * longs, np.int64)
    for at in range(0, len(h), 255 * 32):
        some = h[at : at + 255 * 32]
        spread = np.stack([_mixed(some + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) for k in range(longs)], axis=1)
        lanes = _LANES[spread.view(np.uint8)]
        for a in range(0, len(some), 255):
            counts += lanes[a : a + 255].sum(0).view(np.uint8)
    return np.packbits(2 * counts > len(h)).tobytes()


NARROW = Kind(fingerprint, 1, 32, 2, (4,))
WIDE = Kind(wide_fingerprint, 4, 16, 1, (26, 39, 52))
#: Least share of common shingles in all shingles of two near-duplicates, as a fraction.
SIMILARITY = (4, 5)


def fingerprint_column(kind: Kind, text: Column) -> Column:
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([kind.fingerprint(x) for x in s], dtype="object")

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.BinaryType())(text)


def unpack(raw: pd.Series, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as rows of 64-bit numbers, and as rows of words."""
    flat = b"".join(map(bytes, raw))
    return np.frombuffer(flat, np.uint64).reshape(-1, kind.longs), np.frombuffer(flat, f"u{kind.bits // 8}").reshape(-1, 64 * kind.longs // kind.bits)


def grow_tree(points: np.ndarray, total: int, radius: int, leaf_rows: int = LEAF_ROWS) -> list[tuple]:
    """A vantage-point tree over words: nodes (vantage, threshold, inner, outer); a leaf has vantage None.

    ``points`` stand for ``total`` rows; growth ends where a node stands for ``leaf_rows`` or fewer,
    or where no threshold splits its points.
    """
    nodes: list[tuple] = []
    rng = np.random.default_rng(SEED)

    def grow(at: np.ndarray) -> int:
        me = len(nodes)
        nodes.append((None, 0, 0, 0))
        if len(at) * total > leaf_rows * len(points) and len(at) >= 16:
            vantage = at[rng.integers(len(at))]
            d = np.bitwise_count(at ^ vantage).astype(np.int64)
            t = int(np.median(d))
            if (d > t).sum() == 0:
                t = int(d.max()) - radius - 1
            inner = d <= t
            if 0 < inner.sum() < len(at):
                nodes[me] = (int(vantage), t, grow(at[inner]), grow(at[~inner]))
        return me

    grow(points)
    return nodes


def leaves(words: np.ndarray, nodes: list[tuple], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leaves that each word visits: arrays (index of word, leaf, resident or guest)."""
    out: list[tuple] = []
    todo = [(0, np.arange(len(words)), np.ones(len(words), bool))]
    while todo:
        node, idx, home = todo.pop()
        if not len(idx):
            continue
        vantage, t, inner, outer = nodes[node]
        if vantage is None:
            out.append((idx, np.full(len(idx), node), home))
            continue
        d = np.bitwise_count(words[idx] ^ words.dtype.type(vantage)).astype(np.int64)
        inside = d <= t
        # A resident of the outer side visits the inner side if a resident there may lie within the radius; guests visit both sides so.
        go = np.where(home, inside | (d <= t + radius), d <= t + radius)
        todo.append((inner, idx[go], (home & inside)[go]))
        go = np.where(home, ~inside, d > t - radius)
        todo.append((outer, idx[go], (home & ~inside)[go]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3


def _route(trees: list[list[tuple]], kind: Kind):
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            node, raw = pdf["node"].to_numpy(np.int64), pdf["bits"].to_numpy()
            words = unpack(pdf["bits"], kind)[1]
            for side, nodes in enumerate(trees):
                for at in range(0, len(words), 2000):
                    idx, leaf, home = leaves(words[at : at + 2000, side], nodes, kind.reach)
                    yield pd.DataFrame({"leaf": leaf * len(trees) + side, "node": node[at + idx], "bits": raw[at + idx], "home": home.astype(bool)})

    return route


def leaf_links(bits: np.ndarray, words: np.ndarray, home: np.ndarray, kind: Kind) -> list[tuple[int, int]]:
    """Links of home rows with each other and with the rest whose words lie within reach, thinned to a spanning forest: index pairs."""
    label, out = np.arange(len(words)), []
    edges = [kind.bits * k // (kind.reach + 1) for k in range(kind.reach + 2)]
    groups = []
    for low, high in zip(edges[:-1], edges[1:]):
        key = (words >> words.dtype.type(low)) & words.dtype.type((1 << (high - low)) - 1)
        order = np.lexsort((~home, key))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]))
        groups += [order[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b - a > 1]
    for radius in kind.steps:
        for group in groups:
            n_home = int(home[group].sum())
            for i in range(0, n_home, BLOCK_ROWS):
                rows = group[i : min(n_home, i + BLOCK_ROWS)]
                for j in range(i, len(group), BLOCK_COLS):
                    cols = group[j : j + BLOCK_COLS]
                    near = np.bitwise_count(words[rows][:, None] ^ words[cols][None, :]) <= kind.reach
                    near &= label[rows][:, None] != label[cols][None, :]
                    x, y = np.nonzero(near)
                    x, y = rows[x], cols[y]
                    close = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= radius
                    if close.any():
                        out += forest(x[close], y[close], label)
    return out


def _meet(kind: Kind, sides: int):
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of one cell: residents of chunk ``i`` with those of chunk ``j`` (cell "rr"), or residents with guests ("rg"), or both ("all").

        Residents of one chunk meet each other again in its other cells, which costs less than to keep them apart.
        """
        node, side = pdf["node"].to_numpy(np.int64), int(pdf["leaf"].iloc[0]) % sides
        bits, words = unpack(pdf["bits"], kind)
        home, chunk = pdf["home"].to_numpy(bool), pdf["chunk"].to_numpy()
        cell, i, j = pdf["cell"].iloc[0], pdf["i"].iloc[0], pdf["j"].iloc[0]
        if cell == "rr" and i != j:
            home = chunk == i
        links = leaf_links(bits, np.ascontiguousarray(words[:, side]), home, kind)
        return pd.DataFrame([(int(node[a]), int(node[b])) for a, b in links], columns=["u", "v"], dtype="int64")

    return meet


def _cells(routed: DataFrame) -> DataFrame:
    """``routed`` with the cells in which each row takes part; all leaves but heavy ones are one cell."""
    per = routed.groupBy("leaf").agg(F.count_if("home").alias("residents"), F.count_if(~F.col("home")).alias("guests"))
    per = per.select("leaf", F.ceil(F.col("residents") / LEAF_CAP).cast("int").alias("gr"), F.greatest(F.lit(1), F.ceil(F.col("guests") / GUEST_CAP)).cast("int").alias("gg"))
    heavy = materialise(per.where("gr > 1 or gg > 1"), "vp-heavy")
    zero = F.lit(0)
    if heavy.isEmpty():
        return routed.withColumns({"cell": F.lit("all"), "chunk": zero, "i": zero, "j": zero})
    marked = routed.join(heavy, "leaf", "left")
    light = marked.where("gr is null").select("leaf", "node", "bits", "home", F.lit("all").alias("cell"), zero.alias("chunk"), zero.alias("i"), zero.alias("j"))
    many = marked.where("gr is not null").withColumn("chunk", F.pmod(F.xxhash64("node", "leaf"), F.when(F.col("home"), F.col("gr")).otherwise(F.col("gg"))).cast("int"))
    upto = lambda g: F.explode(F.sequence(zero, F.col(g) - 1)).alias("k")
    cols = ["leaf", "node", "bits", "home"]
    rr = many.where("home").select(*cols, "chunk", upto("gr")).select(*cols, F.lit("rr").alias("cell"), "chunk", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"))
    r_g = many.where("home").select(*cols, "chunk", upto("gg")).select(*cols, F.lit("rg").alias("cell"), "chunk", F.col("chunk").alias("i"), F.col("k").alias("j"))
    g_r = many.where("not home").select(*cols, "chunk", upto("gr")).select(*cols, F.lit("rg").alias("cell"), "chunk", F.col("k").alias("i"), F.col("chunk").alias("j"))
    return light.unionByName(rr).unionByName(r_g).unionByName(g_r)


def linked_fingerprints(distinct: DataFrame, kind: Kind) -> DataFrame:
    """Links (u, v) between the rows ``node, bits`` of distinct fingerprints that span the same components as all links found; a written table."""
    total = distinct.count()
    least = min((1 << 63) - 1, (1 << 63) * SAMPLE // max(total, 1))
    take = distinct.where(F.shiftrightunsigned(F.xxhash64("bits"), 1) <= least).select("bits").toPandas()["bits"]
    sample = unpack(take.sort_values(), kind)[1]
    leaf_rows = max(LEAF_ROWS, int(LEAF_SHARE * total**0.5))
    sides = 64 * kind.longs // kind.bits
    trees = [grow_tree(np.ascontiguousarray(sample[:, side]), total, kind.reach, leaf_rows) for side in range(sides)]
    routed = materialise(distinct.mapInPandas(_route(trees, kind), "leaf long, node long, bits binary, home boolean"), "vp-routed")
    links = materialise(_cells(routed).groupBy("leaf", "cell", "i", "j").applyInPandas(_meet(kind, sides), "u long, v long"), "vp-links")
    discard(routed)
    return links


def alike(a: str | None, b: str | None) -> bool:
    """Whether two texts' shingle sets have ``SIMILARITY`` or more in common; texts without shingles are alike."""
    x, y = shingle_set(a), shingle_set(b)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common * SIMILARITY[1] >= (len(x) + len(y) - common) * SIMILARITY[0]


def confirmed(links: DataFrame, nodes: DataFrame, marked: DataFrame, text_col: str) -> DataFrame:
    """The ``links(u, v)`` between whose texts ``alike`` holds; a node's text is that of its first row.  A written table.

    Texts go to the links that name them, by joins; a text with many links comes along with each of them.
    """
    pairs = materialise(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "simhash-pairs")
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes.select("node", F.col("first.rid").alias("__sim_rid")), "node")
    texts = materialise(marked.select("__sim_rid", F.col(text_col).alias("text")).join(ends.hint("merge"), "__sim_rid").select("node", "text"), "simhash-texts")

    def run(batches):
        for a, b in batches:
            yield pd.Series([alike(x, y) for x, y in zip(a, b)], dtype=bool)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    of = lambda side: texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
    both = pairs.join(of("u").hint("merge"), "u").join(of("v").hint("merge"), "v")
    kept = materialise(both.where(F.pandas_udf(run, T.BooleanType())("text_u", "text_v")).select("u", "v"), "simhash-confirmed")
    for done in (pairs, texts):
        discard(done)
    return kept


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (u, v) between texts of chunk ``i`` and those of chunk ``j`` whose shingle sets have ``SIMILARITY`` or more in common, thinned to a spanning forest."""
    sets = [shingle_set(x) for x in pdf["text"]]
    size = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    of = [ids[b - n : b] for b, n in zip(ends.tolist(), size.tolist())]
    chunk, node = pdf["chunk"].to_numpy(), pdf["node"].to_numpy(np.int64)
    # Texts without shingles have one node in all, so they link to none.
    rows, cols = (np.flatnonzero((chunk == pdf[c].iloc[0]) & (size > 0)) for c in ("i", "j"))
    links, label = [], np.arange(len(pdf))
    if len(cols):
        held, flat = np.zeros(len(ids), bool), np.concatenate([of[y] for y in cols.tolist()])
        starts = np.cumsum(size[cols]) - size[cols]
        for x in rows.tolist():
            held[of[x]] = True
            common = np.add.reduceat(held[flat], starts, dtype=np.int64)
            held[of[x]] = False
            near = common * SIMILARITY[1] >= (size[x] + size[cols] - common) * SIMILARITY[0]
            y = cols[near & (label[cols] != label[x])]
            if len(y):
                links += forest(np.full(len(y), x), y, label)
    return pd.DataFrame([(int(node[a]), int(node[b])) for a, b in links], columns=["u", "v"], dtype="int64")


def _text_cells(texts: DataFrame) -> DataFrame:
    """``texts(node, text, component)`` with the cells in which each takes part: small components share cells, large ones are cut into chunks, each pair of which is a cell."""
    per = texts.groupBy("component").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("rows"))
    share = F.greatest(F.col("chars") / CELL_CHARS, F.col("rows") / CELL_ROWS)
    per = per.select("component", share.alias("share"), F.greatest(F.lit(1), F.ceil(share)).cast("int").alias("chunks"))
    shared = 1 + int(per.where("chunks = 1").agg(F.sum("share")).first()[0] or 0)
    zero = F.lit(0)
    cell = F.when(F.col("chunks") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(shared)))
    cut = texts.join(per, "component").withColumns({"cell": cell, "chunk": F.pmod(F.xxhash64("node"), "chunks").cast("int")})
    each = cut.select("cell", "node", "text", "chunk", F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("k"))
    return each.select("cell", "node", "text", "chunk", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"))


def left_out(candidates: DataFrame, kept: DataFrame, nodes: DataFrame, marked: DataFrame, text_col: str) -> DataFrame | None:
    """Links (u, v) that hold in full but that the forest of ``candidates`` left out; a written table, or None where all candidates were ``kept``.

    A link is left out if its ends are in one component of the forest already.  Where all links of a component were kept nothing is missing;
    in the others all texts are compared with each other, which takes time by the square of the component but a bounded cell of it at once.
    """
    pairs = candidates.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    dropped = materialise(pairs.join(kept.hint("merge"), ["u", "v"], "left_anti").select(F.col("u").alias("node")).distinct(), "simhash-dropped")
    if dropped.isEmpty():
        return None
    groups = connected_components(candidates, "simhash-groups")
    split = groups.join(dropped, "node").select("component").distinct()
    ends = groups.join(split, "component").join(nodes.select("node", F.col("first.rid").alias("__sim_rid")), "node")
    texts = marked.select("__sim_rid", F.col(text_col).alias("text")).join(ends.hint("merge"), "__sim_rid")
    texts = materialise(texts.select("node", "text", "component"), "simhash-split")
    found = materialise(_text_cells(texts).groupBy("cell", "i", "j").applyInPandas(_compare, "u long, v long"), "simhash-left-out")
    for done in (dropped, groups, texts):
        discard(done)
    return found


def _classify(docs: DataFrame, id_col: str, text_col: str, kind: Kind, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """``docs`` as a table with fingerprint and row number, and the distinct fingerprints: bits, root, least id, and the row that stays first."""
    ship(docs.sparkSession)
    marked = materialise(docs.withColumns({"__sim_fp": fingerprint_column(kind, F.col(text_col)), "__sim_rid": F.monotonically_increasing_id()}), "simhash-docs")
    first = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("__sim_rid").alias("rid"))
    nodes = marked.groupBy(F.col("__sim_fp").alias("bits")).agg(F.min(id_col).alias("least"), F.min(first).alias("first"))
    rows = marked.count()
    nodes = materialise(packed_in(nodes, rows).withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")
    links, more = linked_fingerprints(nodes.select("node", "bits"), kind), None
    if confirm:
        candidates, links = links, confirmed(links, nodes, marked, text_col)
        more = left_out(candidates, links, nodes, marked, text_col)
        discard(candidates)
    found = connected_components(links.unionByName(more) if more is not None else links, "simhash")
    rooted = nodes.join(found, "node", "left").select("bits", "least", "first", F.coalesce("component", "node").alias("root"))
    rooted = materialise(packed_in(rooted, rows), "simhash-roots")
    for done in (nodes, links, more, found):
        discard(done)
    return marked, rooted


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: Kind = NARROW) -> DataFrame:
    """One row per row of ``docs``: all its columns plus ``__sim_fp`` (fingerprint), ``__sim_rid`` (a row number), ``__sim_component`` and ``__sim_root``.

    ``__sim_component`` is the smallest id reachable over links (null if all those ids are null); rows whose ids repeat
    stay separate rows.  Null and wordless texts have fingerprint zero and link like any other.  Other columns pass
    through unread; ``docs`` may be empty.
    """
    marked, rooted = _classify(docs, id_col, text_col, kind)
    least = rooted.groupBy("root").agg(F.min("least").alias("__sim_component"))
    classes = materialise(rooted.join(least, "root").select(F.col("bits").alias("__sim_fp"), "__sim_component", F.col("root").alias("__sim_root")), "simhash-classes")
    discard(rooted)
    return marked.join(classes, "__sim_fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: Kind = WIDE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id (null ids last) stays.

    Components are those of links that ``confirmed`` or ``left_out`` has compared in full: a chain of such links joins every row that goes to the one that stays.
    Null, empty and wordless texts count as copies of each other, so one of them stays.  Which row stays is settled without the
    texts; they are dealt out once, by row number, to meet the list of rows that stay.  That list grows with the documents, so it is never broadcast.
    """
    marked, rooted = _classify(docs, id_col, text_col, kind, confirm=True)
    stays = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("__sim_rid"))
    stays = materialise(packed_in(stays, marked.count()), "simhash-stays")
    discard(rooted)
    return marked.join(stays.hint("merge"), "__sim_rid", "left_semi").select(*quoted(docs.columns))
