"""The full-text index on disk, strings in texts, numbering in slabs, facts against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import bm25, facts, index, store, strings


def prose(r, n):
    return " ".join(r.choice("alder birch cedar elder fir hazel larch maple oak pine rowan willow".split()) + str(r.randint(0, 3)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    return [(i, prose(r, r.randint(0, 30))) for i in range(120)] + [(120, None), (121, ""), (122, "Élan élan ELAN a_b")]


def plain_scores(chunks, queries):
    fold = lambda s: s.lower().replace("é", "e")
    toks = {i: re.findall(r"[a-z0-9]+", fold(t or "")) for i, t in chunks}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for q, text in queries:
        phrases = Counter(tuple(re.findall(r"[a-z0-9]+", fold(w))) for w in re.findall(r"\w{2,}", text))
        for p, times in phrases.items():
            f = {i: sum(t[k : k + len(p)] == list(p) for k in range(len(t) - len(p) + 1)) for i, t in toks.items()} if p else {}
            df = sum(x > 0 for x in f.values())
            idf = math.log((n - df + 0.5) / (df + 0.5)) if df else 0
            for i, x in f.items():
                if x:
                    out[q, i] = out.get((q, i), 0) - times * (idf if idf > 0 else 1e-6) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(toks[i]) / avg))
    return out


ASKED = [(1, "oak1 oak1 pine2"), (2, "birch0_cedar1 and élan"), (3, "nothing here"), (4, ""), (5, "oak1_oak2 a_b willow3"), (6, "oak1 oak2 oak3 pine0 pine1 pine2 elder0 elder1 fir0 fir3 oak1_pine2")]


def check_search(spark, source, texts, queries=ASKED, allowed=None):
    want = plain_scores(texts, queries)
    q = spark.createDataFrame(queries, "qid long, text string")
    got = {(r["qid"], r["rowid"]): r["score"] for r in bm25.fts_scores(q, source).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    for only in (None, allowed) if allowed is not None else (None,):
        top = {}
        for r in bm25.search_fts(q, source, 4, allowed=only).collect():
            top.setdefault(r["qid"], []).append((r["rank"], r["rowid"]))
        for n, _ in queries:
            ranked = sorted((round(s, 6), i) for (k, i), s in want.items() if k == n and (only is None or i % 2 == 0))
            assert sorted(top.get(n, [])) == [(k + 1, i) for k, (_, i) in enumerate(ranked[:4])]


@pytest.mark.parametrize("direct, first, slab, rows", [(50_000_000, 20_000, 4096, 500_000), (0, 5, 16, 500_000), (0, 1, 7, 0)])
def test_scores_against_plain_python(spark, monkeypatch, texts, direct, first, slab, rows):
    monkeypatch.setattr(bm25, "DIRECT_ROWS", direct)
    monkeypatch.setattr(bm25, "FIRST_ROWS", first)
    for module in (bm25, index):
        monkeypatch.setattr(module, "SLAB", slab)
        monkeypatch.setattr(module, "BROADCAST_ROWS", rows)
    c = spark.createDataFrame(texts, "rowid long, content string").withColumn("type", F.when(F.col("rowid") % 2 == 0, "a").otherwise("b"))
    check_search(spark, c, texts, allowed=F.col("type") == "a")
    q = spark.createDataFrame(ASKED, "qid long, text string")
    assert bm25.search_fts(q.limit(0), c).count() == 0 and bm25.search_fts(q, c.limit(0)).count() == 0


def relation(spark, texts):
    return spark.createDataFrame(texts, "rowid long, content string")


def same_statistics(a, b):
    assert a.sizes() == b.sizes()
    assert {tuple(r) for r in a.all_frequencies().collect()} == {tuple(r) for r in b.all_frequencies().collect()}


@pytest.mark.parametrize("named, rows", [(1000, 500_000), (0, 500_000), (0, 0)])
def test_a_stored_index_in_parts_gives_the_same_as_one_of_all(spark, tmp_path, monkeypatch, texts, named, rows):
    monkeypatch.setattr(index, "NAMED_TERMS", named)
    monkeypatch.setattr(bm25, "DIRECT_ROWS", 0 if named else 50_000_000)
    for module in (bm25, index):
        monkeypatch.setattr(module, "BROADCAST_ROWS", rows)
    old = index.write_index(relation(spark, texts), str(tmp_path / "1"))
    check_search(spark, old, texts, allowed=spark.range(0, 200, 2).withColumnRenamed("id", "rowid"))
    # Chunks change, go, come, and change again.
    changed = [(3, "oak1 oak1 pine2 new"), (4, None), (300, "oak1_oak2 willow3 elan")]
    two = old.add(index.tokens_of(relation(spark, changed)), str(tmp_path / "2"), spark.createDataFrame([(3,), (4,), (5,), (6,)], "rowid long"))
    three = two.add(index.tokens_of(relation(spark, [(3, "birch0 cedar1")])), str(tmp_path / "3"), spark.createDataFrame([(3,), (300,), (999,)], "rowid long"))
    for part, now in ((two, {**dict(texts), **dict(changed)}), (three, {**dict(texts), **dict(changed), 3: "birch0 cedar1"})):
        now = {i: t for i, t in now.items() if i not in (5, 6) and not (part is three and i == 300)}
        fresh = index.write_index(relation(spark, list(now.items())), str(tmp_path / f"fresh-{len(part.parts)}"))
        same_statistics(part, fresh)
        check_search(spark, part, list(now.items()))
    merged = three.merged(str(tmp_path / "merged"))
    assert len(merged.parts) == 1
    same_statistics(merged, fresh)
    check_search(spark, merged, list(now.items()))
    # An object names its own parts: what was written later does not change it.
    check_search(spark, old, texts)


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_a_small_write_writes_a_small_part(spark, tmp_path):
    r = random.Random(4)
    texts = [(i, prose(r, 60)) for i in range(20_000)]
    one = index.write_index(relation(spark, texts), str(tmp_path / "1"))
    new = [(i, prose(r, 60)) for i in range(0, 20_000, 100)]
    two = one.add(index.tokens_of(relation(spark, new)), str(tmp_path / "2"), spark.createDataFrame([(i,) for i, _ in new], "rowid long"))
    assert size(tmp_path / "2") < 0.05 * size(tmp_path / "1")
    assert two.sizes() == one.sizes()


def test_a_search_reads_its_terms_postings_alone(spark, tmp_path):
    r = random.Random(5)
    # A common vocabulary and, in every text, words of its own.
    texts = [(i, prose(r, 20) + "".join(f" own{i}x{k}" for k in range(60))) for i in range(4000)]
    one = index.write_index(relation(spark, texts), str(tmp_path / "1"))
    asked = spark.createDataFrame([("own7x3",), ("own99x5",)], "term string")
    blocks = one.blocks(asked)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "PartitionFilters: [isnotnull(bucket" in plan
    assert "PushedFilters: [In(term" in plan
    # The files of the terms' folders are all that is left of the postings.
    read = {r[0] for r in blocks.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(read) <= 2
    assert sum((tmp_path / f.split(f"{tmp_path}/")[1]).stat().st_size for f in read) < 0.25 * size(tmp_path / "1" / "postings")
    found = {(x["term"], x["rowid"]): x["positions"] for x in index.lookup(one, ["own7x3", "own99x5", "none"]).collect()}
    assert found == {("own7x3", 7): [23], ("own99x5", 99): [25]}


def test_strings_in_texts(spark, monkeypatch):
    rows = [("x", "abcabc"), ("y", None), ("z", ""), ("x", "bc"), ("w", "éa bc")]
    needles = ["abc", "bc", "", None, "zz", "a b", "bc"]
    for block in (500_000, 1):
        monkeypatch.setattr(strings, "NEEDLES", block)
        got = strings.occurrences(spark.createDataFrame(rows, "key string, text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
        assert sorted(map(tuple, got.collect())) == [("w", "a b"), ("w", "bc"), ("x", "abc"), ("x", "bc"), ("x", "bc")]
    assert strings.occurrences(spark.createDataFrame(rows, "key string, text string"), spark.createDataFrame([], "needle string")).count() == 0


def test_own_strings_in_texts(spark, monkeypatch):
    r = random.Random(9)
    texts = [(f"k{i % 3}", f"t{i}", "".join(r.choice("abé𝄞") for _ in range(r.randint(0, 60)))) for i in range(40)] + [(None, "t", "ab"), ("k0", "u", None)]
    pool = [t for _, _, t in texts if t]
    needles = [(f"k{r.randint(0, 3)}", t[a : a + r.randint(1, 40)]) for t in r.choices(pool, k=150) for a in [r.randint(0, len(t) - 1)]] + [("k0", ""), ("k1", None), (None, "ab"), ("k2", "zzz")]
    want = sorted({(k, i, n) for k, i, t in texts for key, n in needles if k and k == key and t and n and n in t})
    # No task gets the strings themselves, so nothing is collected in blocks of them.
    monkeypatch.setattr(strings, "NEEDLES", 0)
    for most in (1 << 29, 1 << 16):
        monkeypatch.setattr(strings, "MOST_BITS", most)
        got = strings.own_occurrences(spark.createDataFrame(texts, "key string, id string, text string"), spark.createDataFrame(needles, "key string, needle string"))
        assert sorted(map(tuple, got.collect())) == want and len(want) > 100


@pytest.mark.parametrize("most", [1 << 29, 1 << 16])
def test_own_pairs_in_texts(spark, monkeypatch, most):
    r = random.Random(11)
    texts = [(f"k{i % 3}", f"t{i % 35}", "".join(r.choice("abé𝄞") for _ in range(r.randint(0, 60)))) for i in range(40)] + [(None, "t", "ab"), ("k0", "u", None), ("k0", None, "abab")]
    pool = [t for _, _, t in texts if t]
    piece = lambda t, most: t[(a := r.randint(0, len(t) - 1)) : a + r.randint(1, most)]
    pairs = [(f"k{r.randint(0, 3)}", piece(t, 40), piece(r.choice([t, r.choice(pool)]), 30) if r.random() < 0.8 else "") for t in r.choices(pool, k=200)]
    pairs += [("k0", "", "a"), ("k1", None, "a"), ("k1", "a", None), (None, "ab", ""), ("k2", "zzz", ""), ("k0", "a", ""), ("k0", "a", "b")]
    want = {}
    for k, n, also in pairs:
        ids = [i for key, i, t in texts if k and k == key and i and t and n and also is not None and n in t and also in t]
        if ids:
            want[k, n, also] = (len(ids), min(ids))
    monkeypatch.setattr(strings, "MOST_BITS", most)
    asked = spark.createDataFrame(pairs, "key string, needle string, also string")
    got = strings.own_pairs(spark.createDataFrame(texts, "key string, id string, text string"), asked).join(asked.distinct(), ["key", "needle", "also"]).collect()
    assert {(x.key, x.needle, x.also): (x.n, x.only) for x in got} == want and len(got) == len(want) > 50


def test_maps_reach_the_driver_as_blocks_of_bytes(spark, monkeypatch):
    """The same bits as made one by one, in few rows whatever the number of strings."""
    n, rows = 20_000, []
    for name in ("collect", "toLocalIterator"):
        real = getattr(type(spark.range(1)), name)
        monkeypatch.setattr(type(spark.range(1)), name, lambda df, *a, real=real, **k: [rows.append(r) or r for r in real(df, *a, **k)])
    monkeypatch.setattr(strings, "BLOCK_BITS", 1 << 18, raising=False)
    got = strings._bit_map(spark.range(n).selectExpr("cast(id as string) head"), lambda pdf: strings._mixed(strings._whole(pdf["head"]), pdf["head"].map(len).to_numpy(np.uint64)))
    x = strings._mixed(strings._whole(pd.Series(map(str, range(n)))), pd.Series(map(str, range(n))).map(len).to_numpy(np.uint64))
    want = np.zeros(8 * len(got), bool)
    for k in range(3):
        want[strings._place(x, k, len(want))] = True
    assert (np.packbits(want, bitorder="little") == got).all() and len(want) == 1 << 21
    assert 8 <= len(rows) <= 10


def test_facts_are_linked_without_sending_texts(spark):
    c, f, _, _ = facts_and_chunks(spark)
    out = facts.reconcile(f, c)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # No join or exchange sees a text.
    assert "ontains(text" not in plan and "hashpartitioning(source#" in plan
    assert not [line for line in plan.split("\n") if "Exchange" in line and "found#" in line]


@pytest.mark.parametrize("slab", [7, 1, 1000])
def test_numbers_go_on_without_gaps(spark, slab):
    r = random.Random(2)
    seqs = r.sample(range(10_000), 90)
    df = spark.createDataFrame([(s, f"r{s}") for s in seqs], "batch_seq long, id string").repartition(5)
    got = sorted((x["batch_seq"], x["rowid"]) for x in store.consecutive(df, "batch_seq", 500, slab).collect())
    assert got == [(s, 501 + k) for k, s in enumerate(sorted(seqs))]
    assert store.consecutive(df.limit(0), "batch_seq", 3, slab).count() == 0


def facts_and_chunks(spark):
    r = random.Random(3)
    chunks = [(i, f"c{i}", f"s{i % 3}", prose(r, r.choice([0, 1, 3, 20])), float(i)) for i in range(60)] + [(60, "c60", "s0", None, None), (61, "c61", None, "oak1 pine2", 1.0)]
    pool = [c[3] for c in chunks if c[3]]
    made = []
    for n in range(80):
        text = r.choice(pool)
        a = r.randint(0, len(text))
        obj = r.choice([text[a : a + r.randint(1, 25)], "zz 12,5 oak", "12", "", " ", None, "Oak1", "pine2 oak1 ash9"])
        made.append((f"f{n}", r.choice(["s0", "s1", "s2", "s9", None]), r.choice(["oak", "", None, "FIR"]), obj, "old"))
    return spark.createDataFrame(chunks, "rowid long, id string, source string, content string, mtime double"), spark.createDataFrame(made, "id string, source string, subject string, object string, chunk_id string"), chunks, made


def test_facts_meet_their_chunks(spark):
    c, f, chunks, made = facts_and_chunks(spark)
    want = {}
    for i, source, subject, obj, old in made:
        own = [x for x in chunks if source is not None and x[2] == source]
        hits = [x[1] for x in own if x[3] is not None and obj and obj.strip(" ") and obj.lower() in x[3].lower() and (subject or "").lower() in x[3].lower()]
        want[i] = (hits[0], "linked") if len(hits) == 1 else (old, "needs_review" if own else "source_missing")
    assert {r["id"]: (r["chunk_id"], r["status"]) for r in facts.reconcile(f, c).collect()} == want


@pytest.mark.parametrize("cell, slab", [(16_384, 65_536), (5, 4)])
def test_absence_looks_across_chunks(spark, monkeypatch, cell, slab):
    monkeypatch.setattr(facts, "CELL_CHARS", cell)
    monkeypatch.setattr(facts, "SLAB", slab)
    c, f, chunks, made = facts_and_chunks(spark)
    prov = spark.createDataFrame([("f1", 5.0), ("f2", 6.0)], "fact_id string, absent_since double")
    compact = lambda s: re.sub(r"[^a-z0-9]", "", (s or "").lower())
    got = {r["id"]: r["absent"] for r in facts.absence(f, c, prov, 100.0).collect()}
    for i, source, _, obj, _ in made:
        corpus = "".join(compact(x[3]) for x in sorted(chunks) if source is not None and x[2] == source)
        numbers, words = re.findall(r"[0-9]+(?:[.,][0-9]+)?", obj or ""), re.findall(r"[a-zA-Z]{4,}", obj or "")
        rest = numbers or words
        present = compact(obj) in corpus or bool(rest) and all(compact(x) in corpus for x in rest)
        assert got[i] == (not present), (i, source, obj)
