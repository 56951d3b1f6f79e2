"""Alignment of two tokenizers against a plain version that compares byte offsets, with the libraries' own ids of whole texts."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from conftest import DATA
from tokenizers import Tokenizer

from tidemark.llm import alignment, queries
from tidemark.llm.bytebpe import byte_characters
from tidemark.llm.common import table

SF = str(DATA / "sf0.001")
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(A_FILE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
        self.back = {c: n for n, c in enumerate(byte_characters())}

    def tokens(self, text):
        a = self.a.encode(f" {text}", add_special_tokens=False).ids
        b = self.b.encode(text)
        pieces = [self.b.id_to_piece(n) for n in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in zip(b, pieces, strict=True)]
        return list(zip(a, (bytes(map(self.back.__getitem__, self.a.id_to_token(n))) for n in a), strict=True)), list(zip(b, b_bytes, strict=True))

    def __call__(self, texts):
        """For each text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
        per, counts = [], Counter()
        for text in texts:
            a, b = self.tokens(text) if text else ([], [])
            whole = f" {text}".encode()
            if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                per.append(None)
                continue
            ends = [list(accumulate(len(x) for _, x in side)) for side in (a, b)]
            both = sorted(set(ends[0]) & set(ends[1]))
            at = [{e: n for n, e in enumerate(own)} for own in ends]
            groups, start = [], (0, 0)
            for end in both:
                stop = (at[0][end] + 1, at[1][end] + 1)
                groups.append("|".join(",".join(str(n) for n, _ in side[i:j]) for side, i, j in zip((a, b), start, stop, strict=True)))
                start = stop
            links = [(a[at[0][e]][0], b[at[1][e]][0]) for e in both]
            counts.update(links)
            per.append((len(a), len(b), groups, links))
        most: dict = {}
        for (_, y), n in counts.items():
            most[y] = max(most.get(y, 0), n)
        return [(0, 0, 0, 0, 0, 0, "") if p is None else (p[0], p[1], len(p[2]), len(p[3]), sum(counts[x] == most[x[1]] for x in p[3]), sum(counts[x] for x in p[3]), ";".join(p[2])) for p in per]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def test_query_as_the_plain_version(spark, plain):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = dict(zip((i for i, _ in docs), plain([t for _, t in docs]), strict=True))
    out = queries.op11_alignment(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == (*want[r["doc_id"]][:6], digest(want[r["doc_id"]][6])), r["doc_id"]


ODD = [
    None, "", " ", "  two  blanks ", "tab\tnew\nline\r\n\n x", "é è ü ß ÑÖ", "日本語テキスト", "emoji 😀👩‍👧 x", "\x00\x01 control", "a b c　d", "<|endoftext|> a<|endoftext|>", "it's we'll don''t", "▁ mark▁inside", "word<s></s><unk>", "<0x41>", "x" * 500,
    "ﬁ ½ ² ﻿ x", "a \n b\n\nc \n", " leading", "trailing ", "\n", "\n\nx", "cut\x1fmark here", "\x1c odd \x1d blanks\x85x", "if (a);\r\n\t{\r\n}", "�", "naïve café", "ab" * 300,
    "word. Word, word; (word) x.y 3.5, 1,000: end!? ½. ß! ).", "don't, it's. we'll? x!! a.b.c", "word.\n\nword,\t.", "ʰ. ª, ٣.",
]


def odd(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice("abc the 'stéñ\n\t日🎉x1½ \r　\x1f▁;{}") for _ in range(rng.randrange(1, 60))) for _ in range(400)]


def test_odd_texts_cut_and_whole(plain, spark):
    texts = odd(1)
    want = plain(texts)
    aligner = alignment.Aligner(A_FILE, B_FILE)
    assert aligner.cuttable
    cut = aligner.align(texts)
    aligner.cuttable = False
    assert cut == aligner.align(texts)
    assert [(n >> 32, n & 0xFFFFFFFF, len(x) // 8, g) for g, n, x in cut] == [(*w[:3], w[6]) for w in want]
    aligned = alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A_FILE, B_FILE)
    counts = alignment.link_counts(aligned)
    own = {r["doc_id"]: (r["n_best"] or 0, r["count_sum"] or 0) for r in aligned.join(alignment.link_scores(aligned, counts), "row", "left").collect()}
    assert own == {n: w[4:6] for n, w in enumerate(want)}


@pytest.mark.parametrize("share", [0.0, 1e-3, 2.0])
def test_frequent_and_rare_pairs_score_alike(spark, plain, monkeypatch, share):
    monkeypatch.setattr(alignment, "FREQUENT", share)
    texts = ["the cat and the dog", "the dog", "a cat", "naïve the"] * 3
    aligned = alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A_FILE, B_FILE)
    scores = alignment.link_scores(aligned, alignment.link_counts(aligned)).collect()
    assert sorted((r["n_best"], r["count_sum"]) for r in scores) == sorted(w[4:6] for w in plain(texts))


def test_moves_are_kept_by_residual_and_token():
    own = alignment.Transducer([b"ab", b"c", b"abc", b"d"], [b"a", b"bc", b"d", b"abcd"])
    assert own.run([0, 1, 3], [0, 1, 2]) == [([0, 1], [0, 1]), ([3], [2])]
    assert own.run([2, 3], [3]) == [([2, 3], [3])]
    assert own.run([0], [0]) is None and own.run([0], [2]) is None and own.run([], []) == [] and own.run([], [0]) is None
    known = own.known
    own.run([0, 1, 3, 0, 1, 3], [0, 1, 2, 0, 1, 2])
    assert own.known == known and (alignment.A, b"bc") not in own.states and (alignment.A, b"b") in own.states


def test_changed_tokenizers_are_not_cut(tmp_path):
    parts = json.loads(open(A_FILE).read())
    parts["added_tokens"][0]["special"] = False
    (tmp_path / "a.json").write_text(json.dumps(parts))
    assert not alignment.Aligner(str(tmp_path / "a.json"), B_FILE).cuttable


def test_edges(spark):
    rows = [(1, "a b", 9), (1, "a b", 9), (None, "c d", 1), (None, None, 2), (3, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row` int").selectExpr("*", "1 AS n_a", "2 AS `groups`", "3 AS pairs")
    aligned = alignment.align(docs, A_FILE, B_FILE)
    assert aligned.count() == 5 and aligned.select("row").distinct().count() == 5
    assert aligned.where("n_a = 0 AND n_links = 0 AND `groups` = '' AND size(pairs) = 0").count() == 2
    none = alignment.align(docs.limit(0), A_FILE, B_FILE)
    assert alignment.link_scores(none, alignment.link_counts(none)).collect() == []
