import hashlib
import random
import re

import numpy as np
import pytest

from tidewell.llm import pii

from . import fixtures


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def odd_texts():
    r = random.Random(5)
    bits = ["a.b@c.de", "@", "x@y", "x@y.z@w.v", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4465758382889437", "4465 7583 8288-9437", "12", " ", "+", "+1 (743) 555-3824", "+49.30", "é", "\n", ".", "-", "0000000000000000", "007.1.2.0255", "+1234567890123456789", "a_b%c@d-e.f-g"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(1500)]


def test_base_spans_against_the_patterns():
    for t in odd_texts():
        assert pii.base_spans(t) == plain_spans(t), t


def test_base_spans_of_long_runs_end():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+" * 100_000, "@" * 50_000, "1 " * 100_000, "a@" * 50_000):
        pii.base_spans(t)


@pytest.fixture(scope="module")
def weights():
    return pii.model()


def test_held_out_examples(weights):
    x, y = pii.labelled_examples(300, 4242)
    got = pii.best_paths(pii.emissions(x, weights), weights["trans"])
    assert (got == y).mean() > 0.95
    assert (got > 0)[y == 0].mean() < 0.03


@pytest.mark.parametrize(
    "text, spans",
    [
        ("esramente (663) 555-6869 areso esramente", [("phone", 10, 24)]),
        ("call 499-555-6503 now please", [("phone", 5, 17)]),
        ("Licensed under the Apache License, Version 2.0.", []),
        ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and more', []),
        ("on 2024-01-15 at 10:30 we paid 1,234.56", []),
        ("plain words only", []),
        ("write to mary at stanford dot edu about it", [("email", 9, 33)]),
        ("WRITE TO JOHN.BAKER AT HOME DOT ORG NOW", [("email", 9, 35)]),
        ("we met at the station and stayed at home dot", []),
        ("the number 123-45-6789 is no telephone", []),
        ("it is at at at at at at at at at at at at at at at at at at", []),
    ],
)
def test_added_spans(weights, text, spans):
    assert pii.added_spans([text], [pii.base_spans(text)], pii.Scanner(weights))[0] == spans


def spans_of(tags):
    out = []
    for b in np.flatnonzero(tags % 2 == 1).tolist():
        e = b + 1
        while e < len(tags) and tags[e] == tags[b] + 1:
            e += 1
        out.append((int(tags[b]), b, e))
    return out


def test_recall_and_precision_of_whole_spans(weights):
    """Held-out made texts, read as tables are; spans cut off by an example's edge are left out."""
    x, y = pii.labelled_examples(400, 777)
    wanted = found = right = 0
    for e, tags in zip(pii.emissions(x, weights), y):
        want = {s for s in spans_of(tags) if s[1] > 0 and s[2] < pii.EXAMPLE}
        got = {s for s in spans_of(pii.best_paths(e[None], weights["trans"])[0]) if s[1] > 0 and s[2] < pii.EXAMPLE}
        wanted, found, right = wanted + len(want), found + len(got), right + len(want & got)
    assert right / wanted > 0.85 and right / found > 0.85


def test_reading_at_once_is_reading_one_by_one(weights):
    """Windows of different lengths side by side against one at a time."""
    r = random.Random(2)
    texts = ["".join(r.choice("ab 1.@-()é") for _ in range(r.randint(1, 90))) for _ in range(40)]
    scanner = pii.Scanner(weights)
    for (left, right), codes in ((scanner._run(np.ascontiguousarray(np.stack([c, c[::-1]])[:, None].transpose(2, 0, 1)), np.ones(len(c), int)), c) for c in map(pii.symbols, texts)):
        assert np.allclose(left[:, 0] + right[:, 0][::-1], pii.emissions(codes[None].astype(np.int64), weights)[0], atol=1e-3)
    windows = [pii.symbols(t) for t in texts]
    whole = {(k, a): e for k, a, e in scanner.scores(windows)}
    for (k, a), e in whole.items():
        assert np.allclose(e, pii.emissions(windows[k][None].astype(np.int64), weights)[0][a : a + len(e)], atol=1e-3)


def test_only_parts_that_cannot_hold_a_span_are_skipped():
    r = np.random.default_rng(6)
    for _ in range(200):
        ahead = r.normal(-1.0, 2.5, r.integers(1, 400))
        parts = pii.stretches(ahead)
        upto = np.concatenate(([0.0], np.cumsum(ahead)))
        for a in range(len(ahead)):
            for b in (np.flatnonzero(upto[a + 1 :] - upto[a] >= pii.MIN_GAIN) + a + 1).tolist():
                assert any(x <= a and b <= y for x, y in parts)


def test_gradients_are_right(monkeypatch):
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii.train(batches=0).items()}
    p["trans"] += rng.normal(0, 0.3, p["trans"].shape)
    x, y = (a[:3, :10] for a in pii.labelled_examples(3, 1))
    g, _ = pii._gradients(x, y, p)
    for name in p:
        flat = p[name].reshape(-1)
        for at in rng.integers(0, flat.size, 4).tolist() + [int(np.abs(g[name]).argmax())]:
            before, values = flat[at], []
            for d in (1e-4, -1e-4):
                flat[at] = before + d
                values.append(pii._gradients(x, y, p)[1])
            flat[at] = before
            assert abs((values[0] - values[1]) / 2e-4 - g[name].reshape(-1)[at]) < 2e-3


def test_best_paths_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    e, trans = rng.normal(size=(2, 3, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS))
    for b, got in enumerate(pii.best_paths(e, trans)):
        legal = [p for p in product(range(pii.TAGS), repeat=3) if all(not (q and q % 2 == 0) or (k and p[k - 1] in (q, q - 1)) for k, q in enumerate(p))]
        best = max(legal, key=lambda p: sum(e[b, t, q] for t, q in enumerate(p)) + sum(trans[p[t - 1], p[t]] for t in (1, 2)))
        assert tuple(got) == best


@pytest.mark.parametrize("length", [0, 1, 100, 1535, 1536, 1537, 3000, 10_000])
def test_windows_cover_every_span(length):
    starts = pii.windows(length)
    covered = np.zeros(length, bool)
    for a in starts:
        covered[a : a + pii.WINDOW] = True
    assert covered.all()
    for a in range(0, max(0, length - pii.OVERLAP)):
        assert any(s <= a and a + pii.OVERLAP <= s + pii.WINDOW for s in starts)


LONG = ["jonathan.livingston [at] mathematics [dot] stanford [dot] edu", "maximilian.schwarzenberg-holm [at] uni [dot] de"]


def test_spans_at_an_edge_are_read_again(weights):
    # A stand-in for the network: every run of digits is one span, here one that no window holds whole.
    class Digits(pii.Scanner):
        def scores(self, windows):
            for k, x in enumerate(windows):
                e = np.zeros((len(x), pii.TAGS), np.float32)
                digit = x == 3
                first = digit & ~np.pad(digit, (1, 0))[:-1]
                e[:, 1], e[:, 2] = 9.0 * first, 9.0 * (digit & ~first)
                e[:, 0] = np.where(digit, 0, 9.0)
                yield k, 0, e

    scanner = Digits({**weights, "trans": np.zeros((pii.TAGS, pii.TAGS), np.float32)})
    for at in (1300, 1400, 1450):
        text = "x" * at + "7" * 200 + "y" * 3000
        assert pii.added_spans([text], [[]], scanner)[0] == [("email", at, at + 200)]


@pytest.mark.parametrize("address", LONG)
def test_long_written_out_addresses_are_found(weights, address):
    for before in ("", "and more words " * 95):
        t = before + "Call +1 (212) 555-0100 today or write to " + address + " for more"
        a = t.index(address)
        assert ("email", a, a + len(address)) in pii.added_spans([t], [pii.base_spans(t)], pii.Scanner(weights))[0]


def test_reconciled_spans_against_all_choices():
    from itertools import combinations

    r = random.Random(4)
    for _ in range(60):
        spans = [("ip", a, a + r.randint(1, 6), r.random() + 0.1) for a in r.sample(range(20), 6)]
        got = pii.reconcile(spans)
        score = {s[:3]: s[3] for s in spans}
        free = lambda c: all(x[2] <= y[1] or y[2] <= x[1] for x, y in combinations(c, 2))
        best = max(sum(s[3] for s in c) for n in range(7) for c in combinations(spans, n) if free(c))
        assert free(got) and abs(sum(score[g] for g in got) - best) < 1e-9


def test_table(spark, weights):
    texts = [None, "", "a.b@c.de (663) 555-6869 x", "1.2.3.4 " * 3, "é" * 50 + "+1 (743) 555-3824"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[2], "x")], "doc_id long, text string, spans string")
    got = pii.find(df, weights=weights).collect()
    for r in got:
        base = plain_spans(r["text"] or "")
        assert [r["__pii"][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["__pii"]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["__pii"]["spans"].split(",")) | {""}
    assert got[2]["__pii"]["spans"] == "email:0:8,phone:9:23"
    assert pii.find(fixtures.empty(spark), weights=weights).count() == 0
