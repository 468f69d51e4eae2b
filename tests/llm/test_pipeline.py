"""Every stage of corpus_pipeline against a brute-force version, and the chain over the odd cases."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from tidewell.llm import bpe, packing, secrets

from . import fixtures
from .test_line_quality import plain_verdicts
from .test_secrets_packing import plain_scan
from .test_simhash import jaccard

STAGES = dict(corpus_pipeline.STAGES)
SECRET = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def rows():
    """The odd cases, copies and near copies, a boilerplate line, junk and a secret; ``f_len`` and ``rid`` are names that operators use."""
    r = random.Random(11)
    out = [x[:5] + (i, "x") for i, x in enumerate(fixtures.rows(50, seed=3))]
    long = [fixtures.prose(r, 120) for _ in range(12)]
    for k, text in enumerate(long):
        words = text.split()
        words[60] = "changed"
        body = text.replace(" ", "\n", 3)
        out += [(200 + k, body + "\nShared footer of the site", "en", "site", 1, None, None), (300 + k, " ".join(words), "en", "other", 2, None, None)]
    out += [(400, long[0], "en", "other", 3, None, None), (400, long[0], "en", "other", 3, None, None), (None, long[1], None, None, None, None, None)]
    out += [(500, fixtures.prose(r, 80) + f' token = "{SECRET}" ' + fixtures.prose(r, 20), "en", "code", 4, None, None), (501, " ".join("###" + w for w in long[2].split()), "en", "other", 5, None, None)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, f_len string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_quality_rules(spark, docs):
    got = STAGES["quality_rules"](spark, docs, "")
    assert got.columns == docs.columns
    verdicts = Counter(i for i, _, kept in plain_verdicts([r[:4] for r in rows()], 200) if kept)
    assert Counter(r["doc_id"] for r in got.collect()) == verdicts
    assert 501 not in verdicts and verdicts[200] == 1


def test_line_dedup(spark, docs):
    got = STAGES["line_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    pages, often = Counter(), Counter()
    for source, text in {(r[3], r[1]) for r in rows()}:
        pages[source] += 1
        often.update((source, x) for x in {x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")})
    gone = lambda source, x: often[source, x] >= 5 and often[source, x] > 0.02 * pages[source]
    want = sorted(((r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if not gone(r[3], x))) for r in rows()), key=str)
    assert texts(got) == want
    assert all("Shared footer" not in (t or "") for _, t in want)
    for r in got.where("doc_id in (200, 300)").collect():
        assert r["n_chars"] == (len(r["text"]) if r["doc_id"] == 200 else 2)


def test_near_dedup(spark, docs):
    got = STAGES["simhash_near_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    groups = []
    for r in rows():
        near = [g for g in groups if any(jaccard(r[1], o[1]) >= 0.8 for o in g)]
        groups = [g for g in groups if g not in near] + [[r, *(o for g in near for o in g)]]
    least = Counter(min((x[0] is None, x[0] or 0) for x in g) for g in groups)
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == least
    assert least[False, 200] == 1 and least[False, 300] == 0


def test_secret_scan(spark, docs):
    got = STAGES["secret_scan"](spark, docs, "")
    assert got.columns == docs.columns and got.count() == len(rows())

    def masked(text, source):
        hits, seen = {f[0] for f in plain_scan(text, source) if f[-1] >= secrets.THRESHOLD}, iter(range(10**6))
        return None if text is None else re.sub(secrets.CANDIDATE, lambda m: secrets.found(m[0])[0] + "[SECRET]" if next(seen) in hits else m[0], text)

    want = sorted(((r[0], masked(r[1], r[3])) for r in rows()), key=str)
    assert texts(got) == want
    assert not any(SECRET in (t or "") for _, t in want)


def test_packing(spark, docs):
    got = STAGES["best_fit_packing"](spark, docs, "").collect()
    coder, per = bpe.load(), {}
    for r in got:
        assert r["used"] == len(r["ids"]) <= r["capacity"] and r["capacity"] in packing.CAPACITIES
        for m in r["members"]:
            per.setdefault(m["doc_id"], []).append((m["piece"], r["ids"][m["offset"] : m["offset"] + m["length"]]))
    want = {}
    for r in rows():
        want.setdefault(r[0], []).append([*coder.encode(r[1] or ""), coder.end])
    for i, made in want.items():
        assert sorted(x for _, p in per[i] for x in p) == sorted(x for ids in made for x in ids)
        if len(made) == 1:
            assert [x for _, p in sorted(per[i]) for x in p] == made[0]


def test_the_chain(spark, tmp_path, docs):
    """Every document that the sequences hold is one that each stage kept, whole; an empty table goes through."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
    kept = Counter(r["doc_id"] for r in step.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(m["doc_id"] for r in out for m in r["members"] if m["piece"] == 0) == kept
    assert kept[501] == kept[300] == 0 and kept[200] == kept[500] == 1
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
