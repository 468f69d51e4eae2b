import math
import random
from collections import Counter
from itertools import product
from zlib import crc32

import numpy as np
import pytest

from tidewell.llm import hmm

from . import fixtures


def small(k=3, c=5, seed=0):
    r = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return {"start": norm(r.random(k)), "move": norm(r.random((k, k))), "emit": norm(r.random((k, c)))}


def all_paths(seq, m):
    k = len(m["start"])
    for path in product(range(k), repeat=len(seq)):
        p = m["start"][path[0]] * m["emit"][path[0], seq[0]]
        for t in range(1, len(seq)):
            p *= m["move"][path[t - 1], path[t]] * m["emit"][path[t], seq[t]]
        yield path, p


SEQS = [[1, 2, 0], [3], [4, 4, 4, 1, 0], [2, 0], [1, 1]]


def test_likelihood_against_all_paths():
    m = small()
    got = hmm.forward(np.array(sum(SEQS, [])), np.array([len(s) for s in SEQS]), m)
    assert np.allclose(got, [math.log(sum(p for _, p in all_paths(s, m))) for s in SEQS])


def test_expected_counts_against_all_paths():
    m = small()
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for s in SEQS:
        paths = list(all_paths(s, m))
        whole = sum(p for _, p in paths)
        for path, p in paths:
            start[path[0]] += p / whole
            for t, q in enumerate(path):
                emit[q, s[t]] += p / whole
                if t:
                    move[path[t - 1], q] += p / whole
    got = hmm.expected(np.array(sum(SEQS, [])), np.array([len(s) for s in SEQS]), m)
    log = sum(math.log(sum(p for _, p in all_paths(s, m))) for s in SEQS)
    assert np.allclose(got, np.concatenate([start, move.ravel(), emit.ravel(), [log]]))


@pytest.mark.parametrize("steps", [1, 2, 3, 5, 64])
def test_chunks_change_nothing(monkeypatch, steps):
    r = np.random.default_rng(4)
    m, sizes = small(), np.array([1, 9, 2, 10, 40, 3, 17, 1])
    seq = r.integers(0, 5, sizes.sum())
    whole, log = hmm.expected(seq, sizes, m), hmm.forward(seq, sizes, m)
    monkeypatch.setattr(hmm, "STEPS", steps)
    assert np.allclose(hmm.forward(seq, sizes, m), log)
    assert np.allclose(hmm.expected(seq, sizes, m), whole)
    assert abs(whole[:3].sum() - len(sizes)) < 1e-9 and abs(whole[12:-1].sum() - sizes.sum()) < 1e-9


def test_slices_hold_every_sequence_once(monkeypatch):
    monkeypatch.setattr(hmm, "SLICE_TOKENS", 4)
    m, seq, sizes = small(), np.array(sum(SEQS, [])), np.array([len(s) for s in SEQS])
    whole, parts = hmm.expected(seq, sizes, m), [hmm.expected(c, n, m) for _, c, n in hmm.slices(seq, sizes)]
    assert len(parts) > 1 and np.allclose(whole, sum(parts))
    out = np.zeros(len(SEQS))
    for some, c, n in hmm.slices(seq, sizes):
        out[some] = hmm.forward(c, n, m)
    assert np.allclose(out, hmm.forward(seq, sizes, m))
    assert list(hmm.slices(np.zeros(0, int), np.zeros(0, int))) == []


def test_long_sequences_do_not_underflow():
    assert np.isfinite(hmm.forward(np.ones(200_000, np.int64), np.array([200_000]), small())[0])


def plain(rows):
    held = [crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    toks = [(r[1] or "").encode().lower().split() + [None] for r in rows]
    c = Counter(w for h, t in zip(held, toks) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((r[0], h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r, h, t in zip(rows, held, toks)), key=str)


@pytest.mark.parametrize("tokens", [300, 1_000_000])
def test_base_against_brute_force(spark, monkeypatch, tokens):
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(hmm, "SLICE_TOKENS", tokens // 3)
    got = hmm.score(fixtures.docs(spark)).collect()
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str)
    assert found == plain(fixtures.rows())
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_blocks_do_not_change_scores(spark, monkeypatch):
    runs = []
    for tokens in (300, 1_000_000):
        monkeypatch.setattr(hmm, "BLOCK_TOKENS", tokens)
        runs.append(sorted(((r["doc_id"], r["n_tokens"], round(r["score"], 4)) for r in hmm.score(fixtures.docs(spark)).collect()), key=str))
    assert runs[0] == runs[1]


def test_empty_table_and_no_training_text(spark):
    assert hmm.score(fixtures.empty(spark)).count() == 0
    held = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    row = hmm.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).first()
    assert (row["held_out"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 0, 0, 0.0)
    assert math.isfinite(row["score"])


def test_word_probabilities_sum_to_one():
    """Each class gives its words, and one place for unknown words, a probability of one in all."""
    counts = {b"aa": 3, b"ab": 1, b"xx": 5}
    bucket = {}
    for w, c in counts.items():
        bucket.setdefault(hmm.bucket_of(w), []).append(c + 1)
    for cs in bucket.values():
        total = sum(c - 1 for c in cs) + len(cs) + 1
        assert abs(sum(c / total for c in cs) + 1 / total - 1) < 1e-12


def test_likelihood_gains_with_rounds_and_beats_the_base_on_held_out_texts(spark, monkeypatch):
    r = random.Random(2)
    topics = [[fixtures.word(r) + str(k) for _ in range(40)] for k in range(4)]
    rows = [(i, " ".join(r.choice(topics[i % 4]) for _ in range(r.randint(20, 120)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(hmm, "TOLERANCE", -1.0)
    sums = []
    for rounds in (1, 3):
        monkeypatch.setattr(hmm, "ROUNDS", rounds)
        held = hmm.score(docs).where("held_out").groupBy().sum("base_score", "score").first()
        sums.append(held)
    assert sums[0][1] > sums[0][0] and sums[1][1] >= sums[0][1] - 1e-6 * abs(sums[0][1])


def test_number_of_frequent_words_follows_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LEAST_TOP", 3)
    counts = spark.createDataFrame([(k, k, 1000 - 10 * k) for k in range(60)], "key1 long, key2 long, c long")
    few, many = hmm._frequent(counts, 100), hmm._frequent(counts, 1600)
    assert 0 < len(few) <= 10 < len(many) <= 40
    assert [x["key1"] for x in many] == list(range(len(many)))
