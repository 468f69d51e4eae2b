import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import simhash

from . import fixtures


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 4:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, fp, least.get(root(k))) for k, (i, fp) in enumerate(fps)), key=str)


def test_against_brute_force(spark):
    df = fixtures.docs(spark)
    got = simhash.near_duplicates(df)
    assert set(df.columns) < set(got.columns)
    found = sorted(((r[0], int.from_bytes(r[1], "big"), r[2]) for r in got.select("doc_id", "__sim_fp", "__sim_component").collect()), key=str)
    assert found == plain_components([(r[0], r[1]) for r in fixtures.rows()])


def jaccard(a, b):
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_keeps_one_of_each_group_and_empty_table(spark):
    kept = simhash.keep_one(fixtures.docs(spark))
    assert kept.columns == fixtures.docs(spark).columns
    groups = {}
    for k, r in enumerate(fixtures.rows()):
        near = [g for g, others in groups.items() if any(jaccard(r[1], o[1]) >= 0.8 for o in others)]
        merged = [r] + [o for g in near for o in groups.pop(g)]
        groups[k] = merged
    least = sorted((min(((x[0] is None, x[0] or 0) for x in g)) for g in groups.values()), key=str)
    assert sorted(((r[0] is None, r[0] or 0) for r in kept.select("doc_id").collect()), key=str) == least
    assert simhash.keep_one(fixtures.empty(spark)).count() == 0
    assert simhash.near_duplicates(fixtures.empty(spark)).count() == 0
    assert simhash.near_duplicates(fixtures.empty(spark), kind=simhash.WIDE).count() == 0


def edited(words, share, r):
    """The words with so many of them replaced that about ``share`` of the five-word shingles stay."""
    out = list(words)
    for k in r.sample(range(len(out)), max(1, round(len(out) * (1 - share) / 5))):
        out[k] = fixtures.word(r) + "x"
    return out


def test_wide_fingerprints_follow_the_similarity_of_shingle_sets():
    """Of pairs at 0.85 or more nearly all link, at 0.8 to 0.85 most, at 0.6 or less hardly any; unrelated texts never."""
    r = random.Random(5)
    found = {}
    for k in range(600):
        words = [fixtures.word(r) + str(r.randint(0, 9)) for _ in range(r.randint(80, 400))]
        a, b = " ".join(words), " ".join(edited(words, r.uniform(0.6, 1.0), r))
        x, y = (np.frombuffer(simhash.wide_fingerprint(t), np.uint8) for t in (a, b))
        j = jaccard(a, b)
        found.setdefault("high" if j >= 0.85 else "at" if j >= 0.8 else "low" if j <= 0.6 else "", []).append(np.bitwise_count(x ^ y).sum() <= simhash.WIDE.radius)
    assert np.mean(found["high"]) > 0.99 and np.mean(found["at"]) > 0.95
    assert simhash.wide_fingerprint(None) == simhash.wide_fingerprint(" ") == bytes(32)
    assert simhash.wide_fingerprint("A b") == simhash.wide_fingerprint("a  B")


def test_near_dedup_deletes_from_a_similarity_of_08_on_and_never_below(spark):
    """Pairs of texts over the whole range of similarities, in steps of 0.05."""
    r = random.Random(11)
    rows, pairs = [], []
    for _ in range(700):
        words = [fixtures.word(r) + str(r.randint(0, 9)) for _ in range(r.choice([30, 120, 300]))]
        a, b = " ".join(words), " ".join(edited(words, r.uniform(0.55, 1.0), r))
        pairs.append((len(rows), jaccard(a, b)))
        rows += [(len(rows), a), (len(rows) + 1, b)]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = {}
    for k, j in pairs:
        assert k in kept
        gone.setdefault(int(j * 20 + 1e-9), []).append(k + 1 not in kept)
    assert len(gone) >= 8 and all(not any(x) for step, x in gone.items() if step < 16)
    assert all(np.mean(x) >= 0.95 for step, x in gone.items() if step >= 16), {k: np.mean(x) for k, x in gone.items()}


@pytest.mark.parametrize("chars, rows", [(2_000_000, 4096), (20_000, 4096), (2_000_000, 7)])
def test_links_that_the_forest_left_out_are_found(spark, monkeypatch, chars, rows):
    """Groups around a similarity of 0.8, where most candidates are dropped: what stays is what all pairs compared in full leave."""
    monkeypatch.setattr(simhash, "CELL_CHARS", chars, raising=False)
    monkeypatch.setattr(simhash, "CELL_ROWS", rows, raising=False)
    r = random.Random(21)
    texts = []
    for g in range(12):
        words = [fixtures.word(r) + str(r.randint(0, 9)) for _ in range(r.choice([60, 150]))]
        texts += [" ".join(edited(words, r.uniform(0.86, 0.92), r)) for _ in range(40 if g == 0 else r.randint(3, 15))]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    true = labels(len(texts), links)
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == sorted(set(true))
    assert len(texts) * 0.3 < len(set(true)) < len(texts) * 0.9


def test_wide_bits_are_majorities(monkeypatch):
    """The counting of bits eight at a time against one at a time, over more shingles than one batch."""
    r = random.Random(3)
    text = " ".join(fixtures.word(r) + str(i) for i in range(9000))
    words = text.split()
    each = [np.uint64(xxhash.xxh64_intdigest(w, 42)) for w in words]
    counts = np.zeros(256, int)
    with np.errstate(over="ignore"):
        for i in range(len(words) - 4):
            h = np.zeros(1, np.uint64)
            for k in range(5):
                h = simhash._mixed(h + np.uint64(0x9E3779B97F4A7C15)) ^ each[i + k]
            for k in range(4):
                m = int(simhash._mixed(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1))[0])
                counts[64 * k : 64 * k + 64] += np.unpackbits(np.frombuffer(m.to_bytes(8, "little"), np.uint8))
    assert np.packbits(2 * counts > len(words) - 4).tobytes() == simhash.wide_fingerprint(text)


def test_near_copies_of_texts_are_found_through_the_trees(spark, monkeypatch):
    """Groups of near copies and a hot group against brute force over all pairs of fingerprints."""
    monkeypatch.setattr(simhash, "LEAF_ROWS", 60)
    monkeypatch.setattr(simhash, "LEAF_SHARE", 1)
    monkeypatch.setattr(simhash, "LEAF_CAP", 50)
    monkeypatch.setattr(simhash, "GUEST_CAP", 70)
    r = random.Random(8)
    rows = []
    for g in range(60):
        words = [fixtures.word(r) + str(r.randint(0, 9)) for _ in range(150)]
        for _ in range(100 if g == 0 else r.randint(1, 5)):
            rows.append((len(rows), " ".join(edited(words, r.uniform(0.85, 1.0), r))))
    bits = np.array([np.frombuffer(simhash.wide_fingerprint(t), np.uint64) for _, t in rows])
    links = [(a, b) for a in range(len(rows)) for b in range(a) if np.bitwise_count(bits[a] ^ bits[b]).sum() <= simhash.WIDE.radius]
    true = labels(len(rows), links)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), kind=simhash.WIDE)
    found = dict(got.select("doc_id", "__sim_component").collect())
    assert [found[i] for i in range(len(rows))] == true


def test_xxhash_matches_the_engines(spark):
    assert spark.sql("select xxhash64('some words go here')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"some words go here", 42)


def all_links(fps, radius=4):
    out = set()
    for a in range(len(fps)):
        near = np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= radius
        out |= {(a, a + 1 + int(b)) for b in np.flatnonzero(near)}
    return out


def clusters(n_groups, size, n_single, seed):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n_single)]
    for _ in range(n_groups):
        at = r.getrandbits(64)
        for _ in range(size):
            for b in r.sample(range(64), r.randint(1, 3)):
                at ^= 1 << b
            out.append(at)
    return np.unique(np.array(out, np.uint64))


def labels(n, links):
    label = list(range(n))

    def root(k):
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    for a, b in links:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return [root(k) for k in range(n)]


@pytest.mark.parametrize("leaves", [64, 400])
def test_trees_lose_no_link(spark, monkeypatch, leaves):
    # Small leaves and chunks, so that guests, boundaries and chunk pairs all occur.
    monkeypatch.setattr(simhash, "LEAF_CAP", 40)
    fps = clusters(12, 60, 1500, 9)
    real = simhash.grow_tree
    monkeypatch.setattr(simhash, "GUEST_CAP", 50)
    monkeypatch.setattr(simhash, "grow_tree", lambda p, total, radius, leaf_rows: real(p, total, radius, leaf_rows=leaves))
    df = spark.createDataFrame([(k, int(x).to_bytes(8, "big")) for k, x in enumerate(fps)], "node long, bits binary")
    pairs = [tuple(x) for x in simhash.linked_fingerprints(df, simhash.NARROW).distinct().collect()]
    true = all_links(fps)
    assert {(min(p), max(p)) for p in pairs} <= true
    assert labels(len(fps), pairs) == labels(len(fps), true)


def test_every_close_pair_meets_in_a_leaf():
    r = np.random.default_rng(0)
    words = r.integers(0, 1 << 32, 3000, dtype=np.uint32)
    near = words ^ (np.uint32(1) << r.integers(0, 32, 3000, dtype=np.uint32)) ^ (np.uint32(1) << r.integers(0, 32, 3000, dtype=np.uint32))
    every = np.concatenate([words, near])
    idx, leaf, home = simhash.leaves(every, simhash.grow_tree(every, len(every), 2, 100), 2)
    assert home.sum() == len(every)
    at = {}
    for i, f, h in zip(idx, leaf, home):
        at.setdefault(i, set()).add((f, bool(h)))
    for k in range(3000):
        a, b = at[k], at[k + 3000]
        assert any((f, True) in a and ((f, True) in b or (f, False) in b) or (f, True) in b and (f, False) in a for f in {x[0] for x in a})


def test_components_of_a_chain(spark):
    from tidewell.llm.common import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)], "u long, v long")
    got = dict(connected_components(edges, "t").collect())
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert connected_components(edges.where("u < 0"), "t").count() == 0
