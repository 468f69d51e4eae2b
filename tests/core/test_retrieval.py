import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.functions.vectors import HashingEmbedder
from tidewell.operators import ambient, bm25, evaluate, facts, fusion, rerank, vector

NOW = 1_767_225_600.0
DOCS = [
    (1, "n/a.md", "note", "The harbour crane lifts INC-44710 containers before noon", NOW - 5 * 86400),
    (2, "n/b.md", "note", "Écluse fermée: the lock is closed, l'écluse rouvre demain", None),
    (3, "n/c.md", "topic", "Crane maintenance: the crane cable is checked, crane oil changed", NOW - 200 * 86400),
    (4, "2026-01-02.md", "topic", "Journal about the harbour lock and the crane", NOW),
    (5, "MEMORY.md", "topic", "harbour crane lock index", NOW),
    (6, "n/c.md", "topic", "cable stock and harbour fees", NOW),
    (7, "n/d.md", "note", None, NOW),
]


@pytest.fixture(scope="module")
def chunks(spark):
    df = spark.createDataFrame(DOCS, "rowid long, source string, type string, content string, mtime double")
    emb = {d[0]: HashingEmbedder(32).embed([d[3] or ""])[0] for d in DOCS if d[0] != 6}
    vec = spark.createDataFrame(list(emb.items()), "rowid long, embedding array<float>")
    return df.join(vec, "rowid", "left").withColumns({"id": F.concat(F.lit("d"), "rowid"), "metadata": F.lit(None).cast("string")})


def asked(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, text string")


def fold(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


def plain_bm25(query):
    docs = {d[0]: re.findall(r"[^\W_]+", fold(d[3] or "")) for d in DOCS}
    avg, n = sum(map(len, docs.values())) / len(docs), len(docs)
    score = {}
    for word in re.findall(r"\w{2,}", query):
        terms = re.findall(r"[^\W_]+", fold(word))
        hits = {i: sum(t[k : k + len(terms)] == terms for k in range(len(t))) for i, t in docs.items()}
        df = sum(f > 0 for f in hits.values())
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 0) or 1e-6
        for i, f in hits.items():
            if f:
                score[i] = score.get(i, 0) - idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[i]) / avg))
    return sorted((round(s, 6), i) for i, s in score.items())


@pytest.mark.parametrize("query", ["crane", "harbour crane crane", "ecluse FERMEE", "INC-44710", "the_lock closed", "a", "nothing here", "crane_cable"])
def test_bm25(spark, chunks, query):
    got = bm25.search_fts(asked(spark, query), chunks, 10).orderBy("rank").collect()
    want = plain_bm25(query)
    assert [(round(r["score"], 5), r["rowid"]) for r in got] == [(round(s, 5), i) for s, i in want]


def test_filter_leaves_statistics_alone(spark, chunks):
    full = {r["rowid"]: r["score"] for r in bm25.search_fts(asked(spark, "harbour crane"), chunks, 10).collect()}
    some = {r["rowid"]: r["score"] for r in bm25.search_fts(asked(spark, "harbour crane"), chunks, 10, allowed=F.col("type") == "note").collect()}
    assert some and all(full[i] == s for i, s in some.items())


def test_knn_filters_before_the_cut_and_skips_chunks_without_vectors(spark, chunks):
    q = spark.createDataFrame([(0, HashingEmbedder(32).embed(["harbour crane"])[0])], "qid long, embedding array<float>")
    got = vector.search_l2(q, chunks, 3, F.col("type") == "topic").collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3] and {r["rowid"] for r in got} == {3, 4, 5}
    assert vector.search_l2(q, chunks, 3, F.lit(False)).count() == 0
    assert 6 not in {r["rowid"] for r in vector.search_cosine(q, chunks, 10).collect()}


def test_rrf(spark):
    lists = spark.createDataFrame([(0, 0, 1, "a"), (0, 0, 2, "b"), (0, 1, 1, "b"), (0, 1, 2, "b")], "qid long, list_id int, rank int, key string")
    got = {r["key"]: (round(r["score"], 9), r["place"]) for r in fusion.rrf_scores(lists).collect()}
    assert got == {"a": (round(1 / 61, 9), 1), "b": (round(1 / 62 + 1 / 61 + 1 / 62, 9), 2)}


@pytest.mark.parametrize("mtime, meta, want", [(NOW - 90 * 86400, None, math.exp(-1)), (NOW + 1e6, None, 1.0), (None, None, math.exp(-3650 / 90)), (0.0, '{"timestamp": "2025-12-31T00:00:00"}', math.exp(-1 / 90)), (None, "[1]", math.exp(-3650 / 90)), (None, "{bad", math.exp(-3650 / 90))])
def test_recency(spark, mtime, meta, want):
    df = spark.createDataFrame([(mtime, meta)], "m double, d string")
    assert abs(df.select(fusion.recency(F.col("m"), F.col("d"), F.lit(NOW))).first()[0] - want) < 1e-9


def test_importance(spark):
    values = ['{"importance": 0.9}', '{"importance": 7}', '{"importance": "x"}', '{"importance": -1}', None, "[]", '{"importance": "NaN"}']
    df = spark.createDataFrame([(v,) for v in values], "d string")
    assert [r[0] for r in df.select(fusion.importance(F.col("d"))).collect()] == [0.9, 1.0, 0.5, 0.0, 0.5, 0.5, 0.5]


def test_hybrid_without_vectors_and_without_hits(spark, chunks):
    q = asked(spark, "crane", "zzzz").withColumn("embedding", F.lit(None).cast("array<float>"))
    got = fusion.search_hybrid(q, chunks, NOW, k=3).collect()
    assert {r["qid"] for r in got} == {0} and all(r["vec_rank"] is None for r in got)


def test_rerank(spark):
    rows = spark.createDataFrame([(0, 1, "a b", "x"), (0, 2, "a b", "a"), (0, 3, "a b", "a b")], "qid long, rank int, query string, content string")

    def overlap(pairs):
        return [len(set(q.split()) & set(t.split())) for q, t in pairs]

    def broken(pairs):
        raise OSError("no model")

    order = lambda df: [r["rank"] for r in df.orderBy("new_rank").collect()]
    assert order(rerank.rerank(rows, 2, overlap)) == order(rerank.rerank(rows, 2, rerank.overlap(F.col("query"), F.col("content")))) == [3, 2]
    assert order(rerank.rerank(rows, 2, broken)) == order(rerank.rerank(rows, 2)) == [1, 2]
    with pytest.raises(Exception):
        rerank.rerank(rows, 2, broken, strict=True).collect()
    with pytest.raises(rerank.Unavailable):
        rerank.rerank(rows, 2, strict=True)


def test_measures(spark):
    ranks = spark.createDataFrame([(0, 1, "k"), (1, 2, "k"), (2, None, "p"), (3, 5, "p")], "qid long, first_rank int, kind string")
    got = {r["kind"]: (r["recall_at_3"], r["mrr"], r["found"], r["n"]) for r in evaluate.score(ranks, "kind").collect()}
    assert got["all"] == (0.5, round((1 + 0.5 + 0 + 0.2) / 4, 6), 3, 4) and got["p"] == (0.0, 0.1, 1, 2)
    assert {r["qid"] for r in evaluate.misses(ranks).collect()} == {2, 3}


def test_context_needs_evidence(spark, chunks):
    prompts = spark.createDataFrame([(0, "s", "harbour crane"), (1, "s", "crane"), (2, "s", "crane cable INC-99999"), (3, "s", "crane and inc-44710 harbour")], "qid long, session_id string, text string")
    got = {}
    for r in ambient.select_context(prompts, chunks, NOW).collect():
        got.setdefault(r["qid"], []).append(r["rowid"])
    assert 1 not in got and 2 not in got
    assert got[0] == [1] and got[3] == [1, 6]


def test_given_once_per_session(spark, chunks):
    rows = [(i, s, "harbour crane", t) for i, (s, t) in enumerate([("a", 1), ("a", 2), ("b", 1), (None, 5), (None, 4)])]
    prompts = spark.createDataFrame(rows, "qid long, session_id string, text string, turn long")
    got = {}
    for r in ambient.select_in_order(prompts, chunks, NOW).collect():
        got.setdefault(r["qid"], []).append(r["rowid"])
    assert got == {0: [1], 2: [1], 4: [1]}
    # The batch against what was given before says the same, one turn after the other.
    given = spark.createDataFrame([("a", 1)], "session_id string, rowid long")
    assert ambient.select_context(prompts.where("qid = 1"), chunks, NOW, given=given).count() == 0


def test_types(spark, chunks):
    prompts = spark.createDataFrame([(0, "s", "harbour crane")], "qid long, session_id string, text string")
    kinds = [r[0] for r in chunks.select("type").distinct().collect()]
    kind = chunks.where("rowid = 1").first()["type"]
    pick = lambda types: [r["rowid"] for r in ambient.select_context(prompts, chunks, NOW, types=types).collect()]
    assert pick(kind) == pick([kind]) == [1] and pick([]) == pick("nothing of the kind") == []
    assert pick(None) == pick(kinds)
    assert vector.of_type(None) is None and vector.of_type([]) is None


def test_prompt_tokens(spark):
    df = spark.createDataFrame([("Merci de faire the Écluse inc-4471 API api ab œuvre",)], "t string")
    assert df.select(text.prompt_tokens(F.col("t"))).first()[0] == ["the", "écluse", "inc-4471", "api", "œuvre"]


def test_snippet():
    words = " ".join(f"w{i}" for i in range(60))
    assert ambient.snippet(words, ["w40"]).startswith("...w40") and ambient.snippet("short text", ["zz"]) == "short text"


@pytest.mark.parametrize("obj, corpus, present", [("98,4 %", "about 98.4% of it", True), ("98 of 99", "99 and then 98", True), ("98 of 97", "98", False), ("Crème brûlée", "the creme, or brulee", True), ("", "x", True), ("ab", "xyz", False)])
def test_object_present(spark, obj, corpus, present):
    df = spark.createDataFrame([(obj, corpus)], "o string, c string")
    assert df.select(facts.object_present(F.col("o"), facts.compact(F.col("c")))).first()[0] is present


def test_facts_link_only_to_one_chunk(spark):
    f = spark.createDataFrame([("f1", "s", "lock", "noon", None), ("f2", "s", "lock", "open", None), ("f3", "s", "x", " ", None), ("f4", "t", "x", "y", "old")], "id string, source string, subject string, object string, chunk_id string")
    c = spark.createDataFrame([("a", "s", "The Lock opens at NOON"), ("b", "s", "lock is open"), ("c", "s", "lock was open")], "id string, source string, content string")
    got = {r["id"]: (r["chunk_id"], r["status"]) for r in facts.reconcile(f, c).collect()}
    assert got == {"f1": ("a", "linked"), "f2": (None, "needs_review"), "f3": (None, "needs_review"), "f4": ("old", "source_missing")}
