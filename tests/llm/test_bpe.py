import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tidewell.llm import bpe

from . import fixtures


@pytest.fixture(scope="module")
def both():
    own = bpe.load()
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def odd_texts():
    r = random.Random(1)
    bits = ["a", "b", "ing", "  ", "\n", "é", "漢", "🙂", "the", " ", "0", "12", "\x00", "́", "zz", "aaaaaaaa", "'s", "\r\n", "\t", "<|endoftext|>"]
    return ["", " ", "\n\n\n", *("".join(r.choice(bits) for _ in range(r.randint(0, 300))) for _ in range(150)), "a" * 3000, " " * 3000, "ab" * 2000, "é" * 2000]


def test_ids_match_the_library_and_decode_back(both):
    own, library = both
    for text in odd_texts():
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("block", [7, 200_000])
def test_digests(both, monkeypatch, block):
    own, library = both
    monkeypatch.setattr(bpe, "BLOCK", block)
    for text in odd_texts():
        ids = library.encode_ordinary(text)
        assert own.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_time_is_linear_in_one_piece(both):
    import time

    took = []
    for n in (50_000, 200_000):
        began = time.process_time()
        both[0].piece("ab" * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_small_vocabulary_with_tokens_that_merging_cannot_reach():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xyz": 259}
    own = bpe.Bpe(ranks, r"\S+|\s+")
    library = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    for _ in range(500):
        s = "".join(r.choice("abcxyz ") for _ in range(r.randint(0, 12)))
        assert own.encode(s) == library.encode_ordinary(s)


def test_columns(spark, both):
    df = fixtures.docs(spark)
    rows = bpe.decode(bpe.encode(df, to="ids"), "ids", "back").select("text", "ids", "back", "word").collect()
    for r in rows:
        assert bytes(r["back"]).decode() == (r["text"] or "")
        assert list(r["ids"]) == both[1].encode_ordinary(r["text"] or "")
    got = bpe.digests(df)
    assert set(df.columns) < set(got.columns) and got.count() == len(fixtures.rows())
    assert bpe.digests(fixtures.empty(spark)).count() == 0
