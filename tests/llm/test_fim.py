import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from tidewell.llm import fim


def brute(doc_id, text):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or h3 % 100 >= 90 or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(u), "plain", None, None, text
    p, m = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    a, b, c = "".join(u[:p]), "".join(u[p:m]), "".join(u[m:])
    return (len(u), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < 20 else (len(u), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")


def some_text(r):
    return "".join(r.choice(["word", "x", " ", "\n", "é", "漢", "🙂", "́", "<", "P>", "S", "<M", ">", "1", "\t", "\x00"]) for _ in range(r.randint(0, 400)))


def test_checkpoints_find_every_unit_at_any_step_and_block():
    r = random.Random(1)
    for step, block in ((1, 7), (3, 64), (5, 1), (256, 1 << 18)):
        for _ in range(20):
            text = some_text(r)
            raw = text.encode()
            index = fim.Checkpoints(raw, step, block)
            found = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
            assert index.n == len(found) - 1
            assert len(index.units) == -(-index.n // step)
            for unit, at in enumerate(found):
                assert index.find(unit) == (len(text[:at].encode()), at)


def test_equals_brute_force_and_restores(spark):
    r = random.Random(2)
    rows = [(k, some_text(r)) for k in range(300)] + [(i, t) for i, t, *_ in fixtures.rows()]
    rows += [(900, "word " * 60_000), (901, "a" * 200_000), (902, "é" * 100_000), (903, "has <S> inside"), (904, "<P"), (905, ">" * 9), (None, "no id"), (900, "word " * 60_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, form string, `a.b` int")
    out = fim.transform(docs)
    assert out.columns == ["doc_id", "text", "form", "a.b", "__fim"]
    got = out.withColumn("back", fim.restore(F.col("__fim.output"), F.col("__fim.form"))).collect()
    assert len(got) == len(rows)
    forms = set()
    for x in got:
        assert tuple(x["__fim"]) == brute(x.doc_id, x.text)
        assert x.back == (x.text or "")
        forms.add(x["__fim"].form)
    assert forms == {"plain", "psm", "spm"}


def test_rates_seed_and_marks_are_parameters(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three <P> four").alias("text"))
    marks = ("[PRE]", "[SUF]", "[MID]")
    rows = fim.transform(docs, marks=marks, cut_percent=50, spm_percent=100, seed=7)
    rows = rows.select("__fim.*", fim.restore(F.col("__fim.output"), F.col("__fim.form"), marks).alias("back")).collect()
    assert 140 < sum(x.form == "spm" for x in rows) < 260 and all(x.form != "psm" for x in rows)
    assert all(x.back == "one two three <P> four" for x in rows)
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "d"), ("<P>", "<P>x", "y"), ("a", "b", ""), ("aXa", "b", "c")):
        with pytest.raises(ValueError):
            fim.transform(docs, marks=bad)


def test_empty_table(spark):
    assert fim.transform(fixtures.empty(spark)).collect() == []
