import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm import fixtures
from tidewell.llm import alignment
from tidewell.llm import queries as llm_queries

ODD = [
    "", " ", "  ", "\n", "\n\n a", "a", " a", "a ", "a  b", "a\tb \t c", "one\r\ntwo\n\n  three", "x y  z", "　  wide   line", "a▁b", "tail▁ next", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00 \x01 nul",
    "漢字かな交じり文 テスト。 次", "emoji 👩‍👩‍👧 and 🇩🇪 flags", "é ä b", "1234567 3.14,15;(9)", "don't we'll I'M", "ﬁ ｗｉｄｅ", "z" * 3000, "spaces" + " " * 500 + "end", "- " * 300, "Zażółć gęślą jaźń Ёлка שלום عربى", "​ zero ﻿ bom", "a\u0000b\u0085c",
]


def brute(texts):
    both = alignment.load()
    out, held, links_of = [], Counter(), []
    for text in texts:
        row, links = (0, 0, 0, 0, ""), []
        if text:
            a = both.a.encode(" " + text, add_special_tokens=False).ids
            b = both.b.encode(text)
            ab, bb = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
            if b"".join(ab) == b"".join(bb) == (" " + text).encode():
                ends = []
                for side in (ab, bb):
                    at, mine = 0, []
                    for t in side:
                        mine.append((at, at + len(t)))
                        at += len(t)
                    ends.append(mine)
                cuts = {e for _, e in ends[0]} & {e for _, e in ends[1]}
                sides = []
                for ids, mine in zip((a, b), ends):
                    parts = [[]]
                    for i, (_, e) in zip(ids, mine):
                        parts[-1].append(str(i))
                        if e in cuts:
                            parts.append([])
                    sides.append([",".join(x) for x in parts[:-1]])
                groups = [f"{x}|{y}" for x, y in zip(*sides)]
                k = 0
                for i, (s, e) in zip(a, ends[0]):
                    while ends[1][k][1] <= s:
                        k += 1
                    j = k
                    while j < len(b) and ends[1][j][0] < e:
                        links.append((i, b[j]))
                        j += 1
                row = (len(a), len(b), len(groups), len(links), ";".join(groups))
        out.append(row)
        links_of.append(links)
        held.update(set(links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(*r, sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), sorted(links)) for r, links in zip(out, links_of)]


def check(rows, texts, at):
    want = brute(texts)
    got = {at(r): r["__al"] for r in rows}
    assert len(got) == len(rows) == len(texts)
    for k, (n_a, n_b, n_groups, n_links, groups, n_best, count_sum, links) in enumerate(want):
        r = got[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, n_best, count_sum), texts[k]
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert r.groups in (groups, None)
        assert sorted(divmod(x, alignment.PAIR) for x in r.links) == links


def test_equals_brute_force_on_odd_texts(spark):
    r = random.Random(3)
    parts = [x for x in ODD if x]
    mixed = ["".join(r.choice(parts)[: r.randint(1, 40)] for _ in range(r.randint(1, 6))) for _ in range(150)]
    texts = [None, *ODD, *mixed, *[t for _, t, *_ in fixtures.rows()]]
    docs = spark.createDataFrame([(k, t, k, "x") for k, t in enumerate(texts)], "`doc.id` long, text string, n long, links string")
    rows = alignment.align(docs).collect()
    assert rows[0].asDict().keys() == {"doc.id", "text", "n", "links", "__al"}
    check(rows, texts, lambda x: x["doc.id"])


@pytest.mark.parametrize("head", [0, 20])
def test_rare_segments_and_pairs_go_by_shuffles(spark, monkeypatch, head):
    monkeypatch.setattr(alignment._head, "__defaults__", (head,))
    texts = [t for _, t, *_ in fixtures.rows(n=20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    check(alignment.align(docs, keep_cols=["k"], with_groups=False).collect(), texts, lambda x: x.k)


def test_empty_table(spark):
    assert alignment.align(fixtures.empty(spark)).collect() == []


def test_query_equals_brute_force_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    want = dict(zip(ids, brute([docs[i] for i in ids])))
    rows = llm_queries.op11_cross_tokenizer_alignment(spark, sf).collect()
    assert len(rows) == len(ids)
    for r in rows:
        n_a, n_b, n_groups, n_links, groups, n_best, count_sum, _ = want[r.doc_id]
        assert tuple(r) == (r.doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_joining_tokens_takes_no_exchange_of_tokens(spark):
    tokens = alignment.tokenise(spark.createDataFrame([("a", 1), (" b", 1)], "seg string, n long")).selectExpr("monotonically_increasing_id() id", "a", "b")
    with alignment._partial_keys(spark):
        plan = alignment.align_tokens(tokens, alignment.lengths(spark))._jdf.queryExecution().executedPlan().toString()
    # Both sides as arrays, and once the rows that the full join makes.
    assert plan.count("Exchange hashpartitioning(id") == plan.replace("BroadcastExchange ", "").count("Exchange ") == 3


def test_a_share_reads_its_own_rows_only(spark, monkeypatch):
    plans, whole = [], alignment.materialise

    def spied(df, tag, *args, **options):
        if tag in ("align-rare", "align-texts"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, tag, *args, **options)

    monkeypatch.setattr(alignment, "materialise", spied)
    texts = [t for _, t, *_ in fixtures.rows(n=20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    check(alignment.align(docs, keep_cols=["k"], with_groups=False).collect(), texts, lambda x: x.k)
    assert len(plans) == 2 * alignment.SHARES
    scans = [x for p in plans for x in re.findall(r"PartitionFilters: \[[^\]]*", p) if "__share" in x]
    assert len(scans) >= len(plans), plans[0]


def test_runs_of_segments_give_the_tokens_of_each(monkeypatch):
    both = alignment.load()
    r = random.Random(5)
    seams = re.compile(r"(?<=[^\W_])(?=[ \n])")
    parts = [s for t in [*ODD, *[t for _, t, *_ in fixtures.rows(n=20)]] if t for s in seams.split(" " + t)]
    texts = parts + r.sample(parts, len(parts))
    runs = alignment._runs(texts)
    assert [t for run in runs for t in run] == texts and 1 < max(map(len, runs)) <= alignment.RUN
    calls, whole = [], both.a.encode_batch_fast
    both.a = type("Spied", (), {"encode_batch_fast": staticmethod(lambda x, **options: calls.append(len(x)) or whole(x, **options))})()
    try:
        made = list(both.segments(texts))
    finally:
        both.a = whole.__self__
    assert calls[0] == len(runs) < len(texts)
    assert [tuple(x) for x in made] == [tuple(x) for x in both._each(texts)]


def test_the_query_shuffles_no_links_with_its_rows(spark):
    plan = llm_queries.op11_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    whole_rows = [x for x in plan.splitlines() if "FileScan" in x and "groups_sha256" in x]
    assert whole_rows and not any("links" in x.replace("n_links", "") for x in whole_rows)


def test_the_groups_are_joined_where_they_are_made(spark, monkeypatch):
    plans, tags, whole = [], [], alignment.materialise

    def spied(df, tag, *args, **options):
        tags.append(tag)
        if tag == "align-table":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, tag, *args, **options)

    monkeypatch.setattr(alignment, "materialise", spied)
    docs = spark.createDataFrame(list(enumerate([t for _, t, *_ in fixtures.rows(n=20)])), "k long, text string")
    alignment.align(docs, keep_cols=["k"], with_groups=False).count()
    # Three of the tokens' alignment and one of the segments themselves; no table of groups in between.
    assert "align-groups" not in tags and plans[0].replace("BroadcastExchange ", "").count("Exchange ") == 4
    assert "SortAggregate" in plans[0] and "ObjectHashAggregate" not in plans[0]
    # Strings are made after the windows' shuffle.
    assert "concat(" in plans[0] and "concat(" not in plans[0].split("+- Window", 1)[1]
