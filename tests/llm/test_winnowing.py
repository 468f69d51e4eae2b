import random
import re

import numpy as np
import pytest

from tests.llm import fixtures
from tidewell.llm import winnowing

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(len(w), 10)
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (x := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= x
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def case(seed=1):
    r = random.Random(seed)
    vocabulary = [fixtures.word(r) for _ in range(400)] + ["Über", "x1", "漢字", "é"]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(r.randint(10, 50)))) for k in range(30)]
    items += [(100 + n, " ".join(prose(n))) for n in range(1, 10)] + [(200, None), (201, ""), (202, "- ..."), (203, items[3][1]), (203, items[3][1]), (None, items[4][1]), (204, "tick " * 30), (205, "a b a b a b a b a b a b"), (9, "own words of a second item with an id that came before already")]
    docs = []
    for _ in range(120):
        w = prose(r.randint(0, 300))
        for _ in range(r.randint(0, 3)):
            source = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(source) - 1))
            at = r.randint(0, len(w))
            w[at:at] = source[a : a + r.choice([5, 9, 10, 11, 14, 60])]
        docs.append(r.choice([" ", "\n", ", ", "--"]).join(x.upper() if r.random() < 0.2 else x for x in w))
    docs += [None, "", " .,; ", "tick " * 5000, "TICK-tock " * 40, "b a " * 200, items[0][1], items[0][1], "word " * 3]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(docs)], "`k.k` long, text string, items int, start string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = winnowing.contamination(d, b).collect()
    assert len(rows) == len(docs)
    return [tuple(x["__bd"]) for x in sorted(rows, key=lambda x: x["k.k"])]


@pytest.mark.parametrize("broadcast_rows, block", [(200_000, 1 << 20), (0, 200)])
def test_equals_brute_force(spark, monkeypatch, broadcast_rows, block):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(winnowing, "BLOCK", block)
    docs, items = case()
    got, want = run(spark, docs, items), brute(docs, items)
    assert got == want
    assert 20 < sum(n > 0 for _, n, _ in want)


def test_every_shared_span_is_found_and_no_shorter_one(spark):
    r = random.Random(5)
    vocabulary = [fixtures.word(r) + str(k) for k in range(5000)]
    item = r.sample(vocabulary, 40)
    filler = lambda n: [f"f{r.random()}"[2:] for _ in range(n)]
    docs = [" ".join(filler(r.randint(0, 5)) + item[a : a + n] + filler(r.randint(0, 5))) for n in (9, 10) for a in range(31)]
    got = run(spark, docs, [(1, " ".join(item))])
    assert [n for _, n, _ in got] == [0] * 31 + [10] * 31


def test_kept_grams_leave_no_window_empty():
    r = np.random.default_rng(1)
    for n in (1, 3, 4, 5, 50, 500):
        g = r.integers(0, 20 if n > 5 else 3, n).astype(np.uint64)
        kept = set(winnowing.kept_grams(g).tolist())
        for i in range(max(1, n - winnowing.W + 1)):
            assert kept & set(range(i, min(n, i + winnowing.W)))


def test_empty_tables(spark):
    docs, items = case()
    none = spark.createDataFrame([], "item_id long, text string")
    assert [x["__bd"].n_hit for x in winnowing.contamination(fixtures.docs(spark), none).collect()] == [0] * len(fixtures.rows())
    assert winnowing.contamination(fixtures.empty(spark), none).collect() == []
