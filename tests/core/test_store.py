import pytest
from pyspark.sql import functions as F

from tidewell.functions.vectors import HashingEmbedder, get_embedder
from tidewell.operators import store as ops
from tidewell.operators.index import tokens_of, write_index
from tidewell.sources import snapshots
from tidewell.sources.snapshots import Conflict, Store


class Counting(HashingEmbedder):
    """Counts texts on the driver; the executors' copies don't count here."""

    def __init__(self, dim):
        super().__init__(dim)
        self.texts = []

    def embed(self, texts):
        self.texts += texts
        return super().embed(texts)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), dim=16)


EMB = HashingEmbedder(16)


def chunk(i, text="text", source="s", **kw):
    return {"id": i, "source": source, "type": "topic", "content": text, **kw}


def test_upsert_keeps_rowid_and_created_at_and_drops_the_vector(store):
    assert store.upsert([chunk("a", embedding=EMB.embed(["text"])[0]), chunk("b"), chunk("b", "newer")]) == 3
    first = {r["id"]: r for r in store.chunks().collect()}
    assert first["b"]["content"] == "newer" and len(first) == 2 and first["a"]["embedding"] is not None
    store.upsert([chunk("a", "other"), chunk("c", type="note")])
    second = {r["id"]: r for r in store.chunks().collect()}
    assert second["a"]["rowid"] == first["a"]["rowid"] and second["a"]["created_at"] == first["a"]["created_at"]
    assert second["a"]["embedding"] is None and second["c"]["rowid"] > max(r["rowid"] for r in first.values())
    assert store.stats() == {"topic": 2, "note": 1} and store.count("note") == 1
    assert store.upsert([]) == 0 and store.health()["ok"]


@pytest.mark.parametrize("bad", [{"content": None}, {"embedding": [1.0]}, {"embedding": [float("nan")] * 16}])
def test_a_bad_chunk_leaves_the_store_as_it_was(store, bad):
    store.upsert([chunk("a")])
    with pytest.raises(Exception):
        store.upsert([chunk("b"), chunk("c") | bad])
    assert [r["id"] for r in store.chunks().collect()] == ["a"]


def test_replace_source_reuses_vectors(store):
    assert store.replace_source("s", "topic", "h1", [chunk("s:0", "first"), chunk("s:1", "second")], EMB) == 2
    store.upsert([chunk("o", source="other")])
    assert store.is_indexed("s", "h1") and not store.is_indexed("s", "h2") and store.source_hash("x") is None
    known = {r["content_hash"] for r in ops.vectors_by_hash(store.chunks()).collect()}
    assert len(known) == 2
    store.replace_source("s", "topic", "h2", [chunk("s:0", "first"), chunk("s:1", "third")], EMB)
    rows = {r["id"]: r for r in store.chunks().collect()}
    assert set(rows) == {"s:0", "s:1", "o"} and rows["s:1"]["content"] == "third" and rows["s:1"]["embedding"] is not None
    for wrong in ([], [chunk("x", source="other")], [chunk("x"), chunk("x")]):
        with pytest.raises(ValueError):
            store.replace_source("s", "topic", "h", wrong)
    assert store.delete_by_source("s") == 2 and store.count() == 1


def test_only_texts_without_a_vector_reach_the_embedder(spark):
    c = spark.createDataFrame([(1, "h1", "a", [1.0, 0.0]), (2, "h1", "a", [0.0, 1.0]), (3, None, "x", [1.0, 1.0])], "rowid long, content_hash string, content string, embedding array<float>")
    known = ops.vectors_by_hash(c)
    assert [(r["content_hash"], list(r["embedding"])) for r in known.collect()] == [("h1", [0.0, 1.0])]
    batch = spark.createDataFrame([("h1", "a"), ("h2", "b")], "content_hash string, content string")
    got = {r["content"]: (r["reused"], r["embedding"] is not None) for r in ops.embed_missing(batch, known, HashingEmbedder(2)).collect()}
    assert got == {"a": (True, True), "b": (False, True)}


def test_dimension_and_reading_only(spark, store, tmp_path):
    store.add_documents([{"id": "a", "content": "plain words", "metadata": [1]}], EMB)
    assert store.chunks().first()["source"] == "doc/a"
    again = Store(spark, store.path, read_only=True)
    assert again.dim == 16 and again.count() == 1
    with pytest.raises(PermissionError):
        again.upsert([chunk("b")])
    with pytest.raises(ValueError):
        Store(spark, store.path, dim=32)
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none"), read_only=True)


def test_embedder_sees_masked_text(store):
    token, emb = "ghp_" + "A1b2C3d4E5f6G7h8I9j0K1l2", Counting(16)
    store.add_documents([{"id": "d", "content": f"rotate {token} on monday"}], emb)
    assert emb.texts == ["rotate [MASKED] on monday"]
    assert store.chunks().where(F.contains("content", F.lit(token))).isEmpty()


def test_hashing_embedder():
    a, b, none = HashingEmbedder(64).embed(["Some words here", "some WORDS here", "!!"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9 and not any(none)
    assert get_embedder("hashing").dim == 256
    with pytest.raises(ValueError):
        get_embedder("other")


def test_the_index_is_stored_with_the_chunks(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as s:
        s.add_documents([{"id": "a", "content": "rain water for the orchids"}, {"id": "b", "content": "the boiler burns pellets"}])
        q = spark.createDataFrame([(1, "orchids rain"), (2, "boiler")], "qid long, text string")
        got = s.search_fts(q)
        assert s.index().sizes() == (2, 9)
        ids = {r["rowid"]: r["id"] for r in s.chunks().collect()}
        assert {(r["qid"], ids[r["rowid"]]) for r in got.collect()} == {(1, "a"), (2, "b")}


def test_facts_follow_a_replaced_source(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    old = [{"id": "n:0", "source": "n", "type": "topic", "content": "The boiler holds 300 kilograms of pellets."}, {"id": "n:1", "source": "n", "type": "topic", "content": "The shed key hangs behind the door."}]
    s.upsert(old)
    assert not s.has_facts() and s.facts() is None and s.provenance() is None
    s.replace_source("n", "topic", "h1", old)
    facts = [("f1", "n", "boiler", "300 kilograms of pellets", "n:0", None), ("f2", "n", "key", "hangs behind the door", "n:1", None), ("f3", "other", "x", "y", "o:0", None)]
    s.put_facts(spark.createDataFrame(facts, "id string, source string, subject string, object string, chunk_id string, superseded_by string"))
    assert s.has_facts() and s.facts().count() == 3
    s.replace_source("n", "topic", "h2", [{"id": "n:7", "source": "n", "type": "topic", "content": "Now the boiler holds 300 kilograms of pellets in all."}])
    assert {r["id"]: r["chunk_id"] for r in s.facts().collect()} == {"f1": "n:7", "f2": "n:1", "f3": "o:0"}
    prov = {r["fact_id"]: r for r in s.provenance().collect()}
    assert prov["f1"]["status"] == "linked" and prov["f1"]["evidence"].startswith("The boiler") and prov["f1"]["absent_since"] is None
    assert prov["f2"]["status"] == "needs_review" and prov["f2"]["evidence"].startswith("The shed key") and prov["f2"]["absent_since"] is not None
    assert "f3" not in prov


def files(path):
    return {str(f.relative_to(path)): f.stat().st_size for f in path.rglob("*.parquet")}


def same_as_rebuilt(spark, store, path):
    fresh = write_index(store.chunks(), str(path))
    assert store.index().sizes() == fresh.sizes()
    assert {tuple(r) for r in store.index().all_frequencies().collect()} == {tuple(r) for r in fresh.all_frequencies().collect()}
    assert {(r.rowid, tuple(r.terms)) for r in store.index().forward().collect()} == {(r.rowid, tuple(r.terms)) for r in tokens_of(store.chunks()).collect()}
    q = spark.createDataFrame([(1, "word1 word2"), (2, "word7 text")], "qid long, text string")
    assert sorted(store.search_fts(q).collect()) == sorted(store.search_fts(q).collect())


def test_a_write_adds_a_part_and_touches_no_other(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    rows = spark.range(4000).selectExpr("concat('c', id) id", "concat('src', id % 50) source", "if(id % 2 = 0, 'note', 'topic') type", "concat('word', id % 90, ' text number ', id, ' ', repeat(concat('w', id % 700, ' '), 20)) content")
    assert s.upsert(rows) == 4000 and s.count() == 4000 and s.stats() == {"note": 2000, "topic": 2000}
    before = files(tmp_path / "s")
    assert s.upsert(rows.where("substr(id, 2) % 100 = 0").withColumn("content", F.concat("content", F.lit(" changed")))) == 40
    after = files(tmp_path / "s")
    assert before.items() <= after.items()
    # 1 % of the rows: their part is a small share of the store, whose folders of terms it has at least one file in.
    assert sum(after.values()) - sum(before.values()) < 0.12 * sum(before.values())
    assert s.count() == 4000 and s.chunks().where("content like '%changed'").count() == 40
    same_as_rebuilt(spark, s, tmp_path / "i1")
    assert s.delete_by_source("src7") == 80 and s.count() == 3920
    # A ledger entry or facts write neither chunks nor index.
    parts = s._state()["parts"]
    s.mark_source_indexed("src1", "note", "h", 1)
    assert s._state()["parts"] == parts and s.is_indexed("src1", "h") and before.items() <= files(tmp_path / "s").items()
    same_as_rebuilt(spark, s, tmp_path / "i2")


def test_of_two_writers_one_fails_and_nothing_is_lost(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.upsert([chunk("a")])
    late = Store(spark, s.path)
    seen = late._state()
    s.upsert([chunk("b")])
    late._state = lambda: seen
    with pytest.raises(Conflict):
        late.upsert([chunk("c")])
    assert {r["id"] for r in s.chunks().collect()} == {"a", "b"}
    again = Store(spark, s.path)
    again.upsert([chunk("c")])
    assert {r["id"] for r in s.chunks().collect()} == {"a", "b", "c"}
    # What a reader opened stays readable, and the folder that failed goes with vacuum.
    named = {p[0] for p in s._state()["parts"]}
    gone = s.vacuum(older_than_s=-10)
    assert [x for x in gone if x.startswith("part-")] and not named & set(gone) and s.count() == 3


def test_parts_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_PARTS", 3)
    s = Store(spark, str(tmp_path / "s"))
    s.upsert([chunk(f"c{i}", f"word{i % 9} text") for i in range(40)])
    for k in range(4):
        s.upsert([chunk(f"c{k}", f"word{k} newer text"), chunk(f"n{k}", "one more", source="other")])
        if k == 2:
            assert s.delete_by_source("other") == 3
        assert len(s._state()["parts"]) <= 3
    assert s.count() == 41 and len({r["rowid"] for r in s.chunks().collect()}) == 41
    same_as_rebuilt(spark, s, tmp_path / "i1")
    s.compact()
    assert len(s._state()["parts"]) == 1
    same_as_rebuilt(spark, s, tmp_path / "i2")
    assert s.count() == 42


def test_relations_are_written_masked_and_embedded_by_executors(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), dim=16)
    token = "ghp_" + "A1b2C3d4E5f6G7h8I9j0K1l2"
    docs = spark.createDataFrame([(1, f"rotate {token} on monday", '{"password": "abc", "n": 1}'), (2, "plain text", None)], "id long, content string, metadata string")
    assert s.add_documents(docs, EMB) == 2
    rows = {r["id"]: r for r in s.chunks().collect()}
    assert token not in rows["1"]["content"] and "abc" not in rows["1"]["metadata"] and rows["1"]["source"] == "doc/1"
    assert [float(x) for x in rows["2"]["embedding"]] == pytest.approx(EMB.embed(["plain text"])[0], abs=1e-6)
