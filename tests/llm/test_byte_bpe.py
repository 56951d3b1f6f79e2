"""Byte-level BPE: ids as the tiktoken library's, decoding as an exact round trip."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bytebpe, queries
from tidemark.llm.common import table

SF = str(DATA / "sf0.001")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bytebpe.ByteEncoder(bytebpe.read_ranks(RANKS), public_tokenizers.PATTERN, bytebpe.newer_characters())


def ids(encoder, texts):
    return [memoryview(x).cast("i").tolist() for x in encoder.encode(texts)]


def test_query_as_the_library(spark):
    plain = library(RANKS)
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    rows = queries.op13_bytebpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_every_character_splits_as_in_the_library(encoder):
    plain = library(RANKS)
    texts = [f"a{chr(c)} b1{chr(c)} {chr(c)}\n c{chr(c)}{chr(c)} " for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 7 == 0 or 0x1E000 <= c < 0x20000)]
    assert [t for t, own in zip(texts, ids(encoder, texts), strict=True) if own != plain.encode_ordinary(t)] == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 'stéñ\n\t日🎉x1½ \r　\x1f\x1c\x00Ġ▁<|>"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text_as_the_library(encoder, text):
    assert ids(encoder, [text]) == [library_once(text)]


_kept: list[tiktoken.Encoding] = []


def library_once(text: str) -> list[int]:
    if not _kept:
        _kept.append(library(RANKS))
    return _kept[0].encode_ordinary(text)


def test_other_patterns_and_vocabularies(spark):
    pattern = r"(\p{Lu}?\p{Ll}+)|\d{1,3}| +|."
    plain = library(MULTI, pattern)
    texts = ["Ein Satz mit 12345 Zahlen und ÄÖÜ.", "  zwei", "日本語 テキスト", "x" * 5000 + "  " + "AbC" * 400]
    out = bytebpe.encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MULTI, pattern).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in out} == {n: plain.encode_ordinary(t) for n, t in enumerate(texts)}


def test_serialised_model_holds_each_token():
    ranks = bytebpe.read_ranks(RANKS)
    assert bytebpe.surfaces(ranks) == {v: k for k, v in ranks.items()}
    with pytest.raises(ValueError, match="byte 65"):
        bytebpe.serialised({k: v for k, v in ranks.items() if k != b"A"})


def test_gaps_between_ranks_and_tokens_no_merge_makes():
    ranks = {bytes([b]): 3 * b for b in range(256)} | {b"abcd": 1000, b"ab": 2000}
    own = bytebpe.ByteEncoder(ranks, r"\S+|\s+", bytebpe.newer_characters())
    plain = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    texts = ["abcd", "abcde", "ab abab", "xabcd abcd"]
    assert ids(own, texts) == [plain.encode_ordinary(t) for t in texts]


def test_edges(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefgé", k=rng.randrange(1, 200))) for _ in range(20_000))
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (None, "a b", None, None), (2, None, None, None), (3, "", "y", 2), (4, long, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `decoded` int").selectExpr("*", "doc_id AS `od d.name`", "named_struct('a', 1) AS s")
    encoded = bytebpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "decoded", "od d.name", "s", "ids"]
    back = bytebpe.decode_ids(encoded, RANKS)
    assert back.columns == ["doc_id", "od d.name", "s", "decoded"]
    assert sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in back.collect()), key=repr) == sorted(((a, b or "") for a, b, *_ in rows), key=repr)
    assert encoded.where("doc_id = 2 OR doc_id = 3").selectExpr("max(size(ids))").first()[0] == 0
    assert bytebpe.decode_ids(bytebpe.encode_texts(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).collect() == []
