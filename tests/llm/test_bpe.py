from __future__ import annotations

import base64
import random

import public_tokenizers
import pytest
import tiktoken

from blockframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def raw():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def both(raw):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.Bpe(raw, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(both):
    own, other = both
    random.seed(1)
    alphabet = "abcdefghijklmnopqrstuvwxyz" * 2 + "THE  \t\n.,!?'0123456789éèüßñ的一😀​ "
    for _ in range(3000):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 80)))
        ids = own.encode(text)
        assert list(ids) == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", "a" * 60_000, " " * 30_000, "ab" * 20_000, "<|endoftext|>", "\n" * 3000, "é" * 9000, "x1" * 5000])
def test_long_and_odd_texts(both, text):
    own, other = both
    assert list(own.encode(text)) == other.encode_ordinary(text)


def test_compatibility_is_what_merging_gives(both):
    own, _ = both
    random.seed(2)
    for _ in range(5000):
        a, b = random.randrange(50_256), random.randrange(50_256)
        x, y = own.tokens[a], own.tokens[b]
        assert own.compatible(a, b) == (own.merge(x + y) == [x, y])


def test_columns(spark, both):
    _, other = both
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "Hello  wörld", "k"), (3, "Hello  wörld", None)], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    rows = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [r.ids for r in rows[:2]] == [[], []]
    assert rows[2].ids == other.encode_ordinary("Hello  wörld") and bytes(rows[3].decoded) == "Hello  wörld".encode()
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
    assert [bytes(r.decoded) for r in bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH, public_tokenizers.PATTERN).collect()] == [b""]


def test_query_against_the_library(spark, sf, both):
    from hashlib import sha256

    from blockframe.llm.queries import op3_bpe

    _, other = both
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3_bpe(spark, sf).collect():
        ids = other.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(docs[r.doc_id].encode()).hexdigest()
