import random
import re
from collections import Counter

import pytest

from tidewell.llm import line_dedup, quality

from . import fixtures


def plain_lines(rows, ratio, min_pages):
    blank = re.compile(r"[\x20\x09-\x0D]*\Z")
    pages, often = Counter(), Counter()
    for r in rows:
        pages[r[3]] += 1
        often.update({(r[3], x) for x in (r[1] or "").split("\n") if not blank.match(x)} if r[1] is not None else ())
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0))
            continue
        lines = r[1].split("\n")
        kept = [x for x in lines if not (often[r[3], x] >= min_pages and often[r[3], x] > ratio * pages[r[3]])]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [50_000, 0])
def test_lines_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_HOSTS", limit)
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", limit)
    df = fixtures.docs(spark)
    got = line_dedup.dedup_lines(df, ratio=0.1, min_pages=3)
    assert got.columns == [*df.columns, "__ld_n_lines", "__ld_n_dropped"]
    found = sorted(map(tuple, got.select("doc_id", "text", "__ld_n_lines", "__ld_n_dropped").collect()), key=str)
    want = plain_lines(fixtures.rows(), 0.1, 3)
    assert found == want
    assert any(w[3] for w in want)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(fixtures.empty(spark)).count() == 0


def test_copies_of_one_text_are_no_boilerplate_in_the_pipeline(spark):
    import corpus_pipeline

    clean = "a clean text that was stored often\nwith a second line"
    rows = [(i, clean, "s") for i in range(8)] + [(100 + i, f"page {i}\nsite footer", "s") for i in range(6)] + [(200, None, "s"), (201, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate(spark, df, "").collect()}
    assert all(got[i] == clean for i in range(8))
    assert all(got[100 + i] == f"page {i}" for i in range(6))
    assert got[200] is None and got[201] == ""


def plain_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside), len(lines), len(re.findall("[A-Z]", text)))


def test_measures_against_brute_force():
    texts = [r[1] for r in fixtures.rows(20)[:-4]] + [None, "", " ", "a", "a b c a b c", "a a a a", "x\n\nx\n \n \nx", "#|<> É e x A", "a b\x0bc\x1cd a b\x0bc\x1cd\x85e"]
    for t in texts:
        assert quality.measure(t) == plain_measure(t)


def clear(v):
    low = max(0, v.bit_length() - 7)
    return v >> low << low


def plain_verdicts(rows, min_rows):
    def quantiles(values):
        values = sorted(values)
        return len(values), lambda p: values[-(-len(values) * p // 100) - 1]

    measured = []
    for r in rows:
        m = dict(zip(quality.COUNTS, plain_measure(r[1])))
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        measured.append((r[0], r[2], r[3], {n: clear(m[a] * 256 // m[b]) if m[b] else None for n, a, b, _ in quality.RATIOS}, failed, m))
    out = []
    for i, lang, source, v, failed, m in measured:
        kept = not failed
        for name, a, b, p in quality.RATIOS:
            groups = [[x[3][name] for x in measured if not x[4] and x[3][name] is not None and same(x)] for same in (lambda x: x[1:3] == (lang, source), lambda x: x[1] == lang, lambda x: True)]
            if failed or not groups[0] or v[name] is None:
                continue
            q = next((q for n, q in map(quantiles, groups) if n >= min_rows), quantiles(groups[2])[1])
            kept &= m[a] - 2 * m[a] ** 0.5 <= (q(p) + 4 * (q(p) - q(50))) * m[b] / 256
            if name == "word_length":
                kept &= m[a] + 2 * m[a] ** 0.5 >= (q(15) + 4 * (q(15) - q(50))) * m[b] / 256
        out.append((i, failed, kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_rows", [50, 10])
def test_verdicts_against_brute_force(spark, monkeypatch, min_rows):
    monkeypatch.setattr(quality, "MIN_ROWS", min_rows)
    rows = fixtures.rows(150, seed=4)
    rows += [(900, " ".join(f"W{i}A!!" for i in range(80)).upper(), "en", "src1", 1, 1, None), (901, " ".join(f"###{i}$$$" for i in range(80)), "en", "src1", 1, 1, None)]
    df = spark.createDataFrame(rows, fixtures.SCHEMA)
    got = quality.judge(df)
    assert set(df.columns) < set(got.columns)
    found = sorted(map(tuple, got.select("doc_id", "__q_base_failed", "__q_kept").collect()), key=str)
    assert found == plain_verdicts(rows, min_rows)
    assert (900, False, False) in found and (901, False, False) in found
    assert quality.judge(fixtures.empty(spark)).count() == 0


def test_limits_follow_the_group(spark, monkeypatch):
    """The same text is junk among plain prose and ordinary where the group is like it; other groups don't matter."""
    monkeypatch.setattr(quality, "MIN_ROWS", 40)
    r = random.Random(6)
    plain = lambda: " ".join(fixtures.word(r) for _ in range(120))
    marked = lambda: " ".join(fixtures.word(r) + (" |" if r.random() < 0.3 else "") for _ in range(120))
    rows = [(i, plain(), "en", "prose") for i in range(60)] + [(100 + i, marked(), "en", "tables") for i in range(60)]
    rows += [(500, marked(), "en", "prose"), (501, marked(), "en", "tables"), (502, plain(), "en", "tables"), (503, plain(), "en", "prose")]
    rows += [(504, plain() + " &", "en", "prose")]
    kept = dict(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).select("doc_id", "__q_kept").collect())
    assert (kept[500], kept[501], kept[502], kept[503], kept[504]) == (False, True, True, True, True)
