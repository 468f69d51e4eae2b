"""What searches and masking hold and send at a time."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewell.functions import masking
from tidewell.operators import bm25, scan, vector


def test_distances_are_made_in_tiles(spark, monkeypatch):
    r = np.random.default_rng(1)
    x, q = r.integers(0, 3, (300, 4)).astype(float), r.integers(0, 3, (70, 4)).astype(float)
    made = []

    def measure(a, b):
        made.append(len(a) * len(b))
        return vector._l2(a, b)

    monkeypatch.setattr(vector, "VALUES", 100)
    monkeypatch.setattr(vector, "ROWS", 50)
    import pandas as pd

    (got,) = vector._scan(np.arange(70), q, 5, measure, 1)(iter([pd.DataFrame({"rowid": np.arange(300), "embedding": list(x)})]))
    assert max(made) <= 100 and len(got) == 350
    for n, of in got.groupby("qid"):
        d = np.round(np.linalg.norm(x - q[n], axis=1), 6)
        assert sorted(zip(of["value"], of["rowid"])) == [(d[i], i) for i in np.lexsort((np.arange(300), d))[:5]]


def test_a_search_sends_the_best_of_each_task_alone(spark):
    r = random.Random(2)
    texts = [(i, " ".join(r.choice("oak pine fir elm ash".split()) for _ in range(20))) for i in range(400)]
    c = spark.createDataFrame(texts, "rowid long, content string").repartition(3)
    q = spark.createDataFrame([(1, "oak pine"), (2, "fir oak_elm")], "qid long, text string")
    found = bm25.fts_scores(q, c, k=4)
    assert found.count() <= 3 * 2 * 4
    whole = bm25.fts_scores(q, c).withColumn("score", F.round("score", 6))
    assert whole.count() > 600
    best = sorted((x["qid"], x["score"], x["rowid"]) for x in whole.collect())
    want = {n: [(s, i) for k, s, i in best if k == n][:4] for n in (1, 2)}
    got = bm25.search_fts(q, c, 4).orderBy("qid", "rank").collect()
    assert {n: [(x["score"], x["rowid"]) for x in got if x["qid"] == n] for n in (1, 2)} == want
    assert scan.Phrases([["a"], ["a", "b", "c"], ["b", "c"]]).n == 3


def test_texts_without_marks_meet_no_pattern(spark, monkeypatch):
    texts = ["plain prose about pine", "the key is lost", 'PassWord: "x y"', "--token abcdef", "echo hunter2 | sudo -S ls", "curl -u me:pw1 x", "mysql -u a -psecret1", "sshpass -p zz1 ssh", "AKIA" + "A1B2" * 4, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, text string")
    got = dict(map(tuple, df.select("n", masking.mask(F.col("text"))).collect()))
    assert got == {i: masking.clean(t) for i, t in enumerate(texts)} and sum(got[i] != t for i, t in enumerate(texts)) == 7
    # A pattern that would mask everything is not even tried on the others.
    monkeypatch.setattr(masking, "FLAT", [("(?s).+", "X")])
    assert [n for n, t in map(tuple, df.select("n", masking.mask(F.col("text"))).collect()) if t == "X"] == [2, 3, 4, 5, 6, 7, 8]


def test_an_index_is_written_after_one_shuffle(spark):
    from tidewell.operators import index

    texts = [(i * 7, f"oak{i % 5} pine oak{i % 3}") for i in range(3000)]
    tokens = index.tokens_of(spark.createDataFrame(texts, "rowid long, content string"))
    made = index.blocks_by_slab(tokens, 3)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    key = lambda r: (r["term"], r["slab"], r["rows"], r["top_tf"], r["least_dl"], str(r["posts"]))
    assert sorted(map(key, made.collect())) == sorted(map(key, index.blocks_of(tokens).collect()))
