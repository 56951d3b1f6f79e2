"""SentencePiece, language ID, embeddings, quality, records and the pipeline: against libraries, plain versions and held-out rows."""

from __future__ import annotations

import itertools
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from conftest import DATA

import corpus_pipeline
from tidemark.llm import crosspolytope, langid, nbsvm, queries, records, sentencepiece_fst
from tidemark.llm.common import table

SF, SF2 = str(DATA / "sf0.001"), str(DATA / "sf0.01")
ODD = [
    "", " ", "  two  blanks ", "tab\tnew\nline\r\n\n x", "é è ü ß ÑÖ", "é combining", "日本語テキスト", "emoji 😀👩‍👩‍👧 x", "\x00\x01 control", "a b c　d", "<|endoftext|> <|startoftext|>", "it's we'll 'tis don't''", "▁ mark▁inside ▁▁x", "word<s></s><unk>", "<0x41>",
    "x" * 3000, "http://a.b/c?d=e&f=1.5e-3", "ALL CAPS Mixed123numbers 4,567.89", "ﬁ ligature ½ ²", "İstanbul ı ſ ẞ", "-- - ... ?! (a) [b] {c}", "Ünïcödé-WÖRDS,and.marks;here", "퟿�", " leading", "trailing ", "\n", "aaaa" * 50 + " " + "ab" * 100,
]


def odd_docs(spark):
    rows = [(n, t, None, 1) for n, t in enumerate(ODD)] + [(0, ODD[3], "x", 2), (None, "no id", "en", 3), (None, None, None, None), (500, None, "en", 4), (501, "long " * 60_000, "en", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids int").selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS held_out", "4 AS start", "5 AS n_tokens", "6 AS before", "7 AS y", "8 AS x", "9 AS n_pieces")


# SentencePiece


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_as_the_library(spark, processor):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in queries.op1_sentencepiece(spark, SF).collect()}
    assert len(rows) == len(docs)
    for r in docs:
        want = processor.encode(r["text"] or "")
        own = rows[r["doc_id"]]
        assert list(own["ids"]) == want, r["doc_id"]
        assert own["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        assert own["decoded_crc32"] == zlib.crc32(processor.decode(want).encode()) and own["round_trip"]


def test_odd_pieces_as_the_library(spark, processor):
    out = sentencepiece_fst.encode_documents(odd_docs(spark), public_tokenizers.path("piece_bpe_32k.model"))
    rows = out.collect()
    assert len(rows) == len(ODD) + 5
    for r in rows:
        if r["doc_id"] is not None and 0 < r["doc_id"] < len(ODD):
            assert list(r["ids"]) == processor.encode(ODD[r["doc_id"]]), ODD[r["doc_id"]]
    assert [list(r["ids"]) for r in rows if r["doc_id"] == 500] == [[]]
    assert sentencepiece_fst.encode_documents(odd_docs(spark).limit(0), public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_random_pieces_as_the_library(processor):
    m = sentencepiece_fst.model(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice("abcdehilnorstuwyABÉéß .,'-\n01▁漢😀") for _ in range(rng.randrange(40)))
        assert m.encode(text).tolist() == processor.encode(text), text


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("dummy", [False, True])
@pytest.mark.parametrize("extra", [[], ["a▁b", "▁▁", "b\nc"]])
def test_cut_texts_have_the_paths_of_whole_ones(squeeze, dummy, extra):
    """Also for pieces over words and lines, which forbid cuts; the normaliser's states give what rewriting the text gives."""
    rng = random.Random(6)
    pieces = [("<unk>", 0.0, sentencepiece_fst.UNKNOWN)] + [(f"<0x{b:02X}>", 0.0, sentencepiece_fst.BYTE) for b in range(256)]
    texts = ["▁", "a", "b", "c", "▁a", "ab", "▁ab", "bc", "▁▁", "▁▁▁a", *extra]
    pieces += [(t, -float(k), 1) for k, t in enumerate(dict.fromkeys(texts))]
    for kind in (sentencepiece_fst.BPE, sentencepiece_fst.UNIGRAM):
        m = sentencepiece_fst.Model(pieces, kind, dummy, squeeze).compile()
        for _ in range(400):
            text = "".join(rng.choice("abc  \n▁é\x1f") for _ in range(rng.randrange(12)))
            norm = " ".join(text.split(" ")) if not squeeze else " ".join(x for x in text.split(" ") if x)
            norm = (("▁" if dummy else "") + norm.replace(" ", "▁")) if norm else ""
            assert m.normalise(text) == norm
            ids, merged = m.encode(text).tolist(), m._merged(norm)
            if kind == sentencepiece_fst.BPE:
                assert ids == [i for p in merged for i in ([m.ids[p]] if p in m.ids else [m.bytes_[b] for b in p.encode()])], repr(text)
            cost = lambda ids: sum(-m.pieces[i][1] if i > 256 else 0.0 for i in ids)
            assert kind == sentencepiece_fst.BPE or cost(ids) <= cost([m.ids[p] for p in merged if p in m.ids]) + 1e-9 + 100 * sum(p not in m.ids for p in merged)


def test_unigram_path_is_the_best_of_all():
    rng = random.Random(5)
    pieces = [("<unk>", 0.0, sentencepiece_fst.UNKNOWN), ("▁", -3.0, 1)]
    pieces += [("".join(p), -rng.uniform(1, 9), 1) for n in (1, 2, 3) for p in itertools.product("ab", repeat=n) if rng.random() < 0.8] + [("▁a", -2.5, 1), ("▁ab", -4.0, 1)]
    m = sentencepiece_fst.Model(pieces, sentencepiece_fst.UNIGRAM).compile()
    for _ in range(200):
        text = "▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        best = float("inf")
        for cuts in itertools.product([False, True], repeat=len(text) - 1):
            parts, at = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(text[at:k])
                    at = k
            parts.append(text[at:])
            if all(p in m.scores or len(p) == 1 for p in parts):
                best = min(best, sum(-m.scores[p] if p in m.scores else m.penalty for p in parts))
        path = m.path(text)
        assert "".join(path) == text
        assert sum(-m.scores[p] if p in m.scores else m.penalty for p in path) == pytest.approx(best)


# language ID


def test_language_held_out(spark):
    out = queries.op4_langid(spark, SF2)
    rows = out.join(table(spark, SF2, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == table(spark, SF2, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    test = [r for r in rows if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(test) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in test) / len(test) >= 0.97


def test_language_pieces_and_edges(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    filters = langid.train(docs, ~langid.held_out(docs["doc_id"]))
    texts = [r["text"] for r in docs.select("text").collect()] + [None, "", "123 !?", *ODD]
    whole = filters.counts(texts)
    monkeypatch.setattr(langid, "_PIECE", 97)
    for a, b in zip(whole, filters.counts(texts), strict=True):
        assert (a == b).all()
    plain = [sum(c.isalpha() for c in t or "") for t in texts]
    assert whole[0].tolist() == plain
    monkeypatch.undo()
    odd = langid.language_id(odd_docs(spark)).collect()  # it learns from what little is there
    assert len(odd) == len(ODD) + 5
    assert {r["lang_pred"] for r in odd if r["doc_id"] == 500} == {"und"}
    assert langid.language_id(odd_docs(spark).limit(0)).collect() == []
    none = langid.identify(odd_docs(spark), langid.Filters([], np.zeros((1, 2**10), np.uint64), 3)).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    kept = langid.keep_identified(odd_docs(spark), filters)
    assert kept.columns == odd_docs(spark).columns and all(any(c.isalpha() for c in r["text"]) for r in kept.collect())


def test_language_filters_and_counts_as_plain_sets_have_them(spark):
    """Grams, the languages that contain them, the filters' bits, their AND and the correction, by dictionaries and loops."""
    docs = table(spark, SF, "documents")
    log2 = 12  # so few slots that false positives are many
    filters = langid.train(docs, ~langid.held_out(docs["doc_id"]), slots_log2=log2)
    rows = docs.collect()

    def grams(text):
        low = [c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in f" {text} "]
        return [tuple(map(ord, low[k - 1 : k + 2])) for k in range(1, len(low) - 1) if low[k] != " "]

    uses: dict[str, dict[tuple, int]] = {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None:
            own = uses.setdefault(r["lang"], {})
            for g in grams(r["text"]):
                own[g] = own.get(g, 0) + 1
    assert filters.languages == sorted(uses)
    share = {k: {g: n / sum(own.values()) for g, n in own.items()} for k, own in uses.items()}
    places = lambda g: {((p := g[0] << 42 | g[1] << 21 | g[2]) ^ p >> 29) * int(langid._ODD[k]) % 2**64 >> 64 - log2 for k in range(langid.HASHES)}
    held = {k: set() for k in uses}
    for k, own in uses.items():
        for g, n in own.items():
            if n >= langid.LEAST_USES and share[k][g] >= langid.SHARE * max(s.get(g, 0) for s in share.values()):
                held[k] |= places(g)
    for n, k in enumerate(filters.languages):
        assert set(np.nonzero(filters.masks[0] >> np.uint64(n) & np.uint64(1))[0].tolist()) == held[k]
    rate = {k: (len(held[k]) / 2**log2) ** langid.HASHES for k in uses}
    assert max(rate.values()) > 0.001
    texts = [r["text"] for r in rows] + ODD
    for text, lang, score in zip(texts, *filters.decide(texts), strict=True):
        own = grams(text or "")
        real = {k: max(0.0, (sum(places(g) <= held[k] for g in own) - len(own) * rate[k]) / (1 - rate[k])) for k in filters.languages}
        best = max(filters.languages, key=lambda k: real[k]) if own else "und"
        assert lang == best and score == pytest.approx(min(1.0, real[best] / len(own)) if own else 0.0)


# embeddings


def near_pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.9, 1))
    return i, j


def check_vectors(rows: dict, ids: list[int], x: np.ndarray, least_recall: float):
    i, j = near_pairs(x)
    want = np.bincount(np.concatenate([i, j]), minlength=len(ids))
    got = np.array([rows[d]["n_links"] for d in ids])
    assert (got <= want).all(), "a link below 0.9"
    assert got.sum() >= least_recall * want.sum()
    comp = brute.components(ids, [(ids[a], ids[b]) for a, b in zip(i, j, strict=True)])
    for d in ids:
        r = rows[d]
        assert r["kept"] == (d == r["component_id"]) and r["component_id"] >= comp[d]
        assert comp[r["component_id"]] == comp[d], "no link leads there"
    return sum(rows[d]["component_id"] == comp[d] for d in ids) / len(ids), len(i)


def test_embeddings_query(spark):
    own = table(spark, SF2, "embeddings").collect()
    rows = {r["vec_id"]: r for r in queries.op5_embeddings(spark, SF2).collect()}
    assert len(rows) == len(own)
    check_vectors(rows, [r["vec_id"] for r in own], np.array([r["embedding"] for r in own], np.float32), 0.9)


@pytest.mark.parametrize("dim", [64, 50])
def test_planted_neighbours(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(60, dim))
    noisy = []
    for b in base:
        for cos in rng.uniform(0.86, 0.999, 12):
            n = rng.normal(size=dim)
            n -= b * (n @ b) / (b @ b)
            noisy.append(cos * b / np.linalg.norm(b) + np.sqrt(1 - cos * cos) * n / np.linalg.norm(n))
    cloud = base[0] + 0.05 * rng.normal(size=(1500, dim))  # more than a block in one bucket
    x = np.concatenate([base, np.array(noisy), cloud, base[:20], 3 * base[20:30]]).astype(np.float32)
    ids = list(range(10, 10 + len(x)))
    df = spark.createDataFrame([(d, v.tolist(), 1) for d, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int")
    rows = {r["vec_id"]: r for r in crosspolytope.near_vectors(df).collect()}
    share, n = check_vectors(rows, ids, x, 0.9)
    assert share >= 0.9 and n > 1_000_000


@pytest.mark.parametrize("dim", [64, 256, 768, 1024, 1536])
@pytest.mark.parametrize("rows", [2_000, 1_000_000])
def test_recall_just_above_the_bound(dim, rows):
    rng = np.random.default_rng(dim + 1)
    x, y = rng.normal(size=(2, 400, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= x * (x * y).sum(1, keepdims=True)
    cos = rng.uniform(0.9, 0.92, (400, 1))
    y = cos * x + np.sqrt(1 - cos * cos) * y / np.linalg.norm(y, axis=1, keepdims=True)
    tables, hashes = crosspolytope.plan(dim, rows)
    assert crosspolytope.meet(crosspolytope.codes(x, tables, hashes), crosspolytope.codes(y, tables, hashes)).any(1).mean() >= 0.9


def test_rows_count_whatever_their_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.99, 0.01, 0.0]
    rows = [(1, a), (1, b), (2, c), (None, [0.0, 0.01, 1.0]), (3, [0.0, 0.0, 1.0]), (4, [0.01, 0.0, 1.0]), (None, [-1.0, -1.0, 0.0]), (None, [-1.0, -1.01, 0.0])]
    out = crosspolytope.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in out), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (0, 2, 3, False), (3, 2, 3, True), (4, 2, 3, False), (0, 1, 0, True), (0, 1, 0, True)], key=str)


def test_blocks_of_a_bucket_give_what_the_bucket_gives(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=8) + s * rng.normal(size=(150, 8)) for s in (0.02, 0.2, 0.5)]).astype(np.float32)
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, crosspolytope.near_vectors(df).collect()))
    monkeypatch.setattr(crosspolytope, "BLOCK", 20)
    assert sorted(map(tuple, crosspolytope.near_vectors(df).collect())) == whole
    check_vectors({r[0]: dict(zip(("vec_id", "n_links", "component_id", "kept"), r, strict=True)) for r in whole}, list(range(len(x))), x, 0.9)


def test_embedding_edges(spark):
    inf, nan = float("inf"), float("nan")
    v = [0.5, -1.0, 2.0]
    rows = [(1, v), (1, v), (2, [1.0, -2.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 1.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [0.5, -1.0]), (None, v), (10, [1e300, -2e300, 4e300]), (11, [5e-300, -1e-299, 2e-299]), (12, [-0.0, 1.0, 0.0]), (13, [0.0, 1.0, -0.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "vec_id long, embedding array<double>, x int, rep int, component_id int, n_links int")
    out = crosspolytope.near_vectors(df).collect()
    assert len(out) == len(rows)
    by = {r["vec_id"]: r for r in out}
    assert all(by[d]["n_links"] == 0 and by[d]["component_id"] == d and by[d]["kept"] for d in (3, 4, 5, 6, 7, 8, 9))
    assert all(by[d]["n_links"] == 5 and by[d]["component_id"] == 1 for d in (1, 2, 10, 11, None))
    assert by[12]["component_id"] == by[13]["component_id"] == 12
    assert crosspolytope.near_vectors(df.limit(0)).collect() == []


# quality


def auc(score, y):
    score, y = np.array(score), np.array(y)
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_quality_held_out(spark):
    sf = str(DATA / "sf0.1")
    rows = queries.op6_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    test = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert len(test) > 300
    assert auc([r["score"] for r in test], [r["quality"] for r in test]) >= 0.9
    assert np.mean([r["predicted"] == r["quality"] for r in test]) >= 0.9


def test_quality_edges(spark):
    docs = odd_docs(spark)
    ids = [n for n in range(len(ODD)) if zlib.crc32(str(n).encode()) % 5]
    labels = spark.createDataFrame([(n, k % 2, None) for k, n in enumerate(ids)] + [(None, 1, 1), (9999, None, 0), (ids[0], 0, 0), (7, 5, 0)], "doc_id long, quality int, text int")
    out = nbsvm.quality(docs, labels).collect()
    assert len(out) == len(ODD) + 5 and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in nbsvm.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in nbsvm.quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert nbsvm.quality(docs.limit(0), labels).collect() == []


def test_hinge_loss_is_least_where_the_fit_ends(monkeypatch):
    """Against a plain solver of the same problem: projected gradient on the dual, with the whole matrix of products."""
    monkeypatch.setattr(nbsvm, "MIX", 1.0)
    monkeypatch.setattr(nbsvm, "ROUNDS", 200)
    rng = np.random.default_rng(2)
    y = np.array([0, 1, 1] * 30)
    xs = [np.unique(rng.choice(np.arange(40) + 12 * label, 9)).astype(np.int32) for label in y]  # not separable
    one = nbsvm.fit_svm(xs, y)
    share = [np.array([1.0 + sum(f in x for x, label in zip(xs, y, strict=True) if label == k) for f in range(60)]) for k in (0, 1)]
    ratio = np.log(share[1] / (share[1].sum() + 2**nbsvm.FEATURES_LOG2 - 60)) - np.log(share[0] / (share[0].sum() + 2**nbsvm.FEATURES_LOG2 - 60))
    assert np.allclose(one.ratio[:60], ratio)
    v = np.zeros((len(y), 61))
    for n, x in enumerate(xs):
        v[n, x] = ratio[x] / np.linalg.norm(ratio[x])
        v[n, 60] = 1  # the bias is a feature
    sign, cost = np.where(y == 1, 1.0, -1.0), len(y) / (2 * np.array([(y == 0).sum(), (y == 1).sum()]))[y]
    q = (sign[:, None] * v) @ (sign[:, None] * v).T
    alpha = np.zeros(len(y))
    for _ in range(20_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * (v @ w))).sum()
    assert loss(np.append(one.weight[:60], one.bias)) == pytest.approx(loss(v.T @ (alpha * sign)), rel=1e-3)
    assert not one.weight[60:].any()


# records


def test_records_as_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = sorted(table(spark, SF, "documents").select("doc_id", "text").collect())
    rows = {r["doc_id"]: r for r in queries.op10_records(spark, SF).collect()}
    assert len(rows) == len(docs)
    at = 0
    for d, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        r = rows[d]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), d
        at += len(ids)


def test_odd_records(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    enc = records.encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abcxyzABÉéß .,'-\n01_<|>#漢😀") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, t
    out = records.token_records(odd_docs(spark), public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/records").collect()
    assert len(out) == len(ODD) + 5
    order = sorted(out, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in order])[:-1]]).tolist()
    assert [r["doc_id"] is None for r in order[:2]] == [True, True] and [r["doc_id"] for r in order[2:]] == sorted(r["doc_id"] for r in order[2:])
    assert records.token_records(odd_docs(spark).limit(0), public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/none").collect() == []


def test_another_tokenizer_gets_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = records.WordEncoder(path, 2), Tokenizer.from_file(path)
    assert not enc.by_stretch and records.encoder(public_tokenizers.path("word_bpe_49k.json"), 2).by_stretch
    for t in ODD:
        assert np.frombuffer(enc.encode(t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_damage_is_found():
    record = records.frame(b"some payload")
    assert records.unframe(record) == b"some payload"
    for k in range(len(record)):
        with pytest.raises(ValueError):
            records.unframe(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :])
    with pytest.raises(ValueError):
        records.unframe(record[:-1])


# pipeline


def test_pipeline_against_plain_versions(spark, processor):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    filters = langid.train(docs, ~langid.held_out(docs["doc_id"]))
    ids = sorted(rows)
    lang, score = filters.decide([rows[d] for d in ids])
    kept = {d: rows[d] for d, x, s in zip(ids, lang, score, strict=True) if x != "und" and s >= langid.LEAST_SCORE}
    assert len(kept) > 0.9 * len(rows)
    cut = brute.line_dedup(list(kept.values()))
    kept = {d: cut[t][0] for d, t in kept.items()}
    comp = brute.simhash(list(kept.items()))
    kept = {d: t for d, t in kept.items() if comp[d][1] == d}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    dirty = {d for d, _, _ in brute.overlaps(list(kept.items()), items)}
    want = {d: processor.encode(t) for d, t in kept.items() if d not in dirty}
    found = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert found == want


def test_pipeline_edges(spark, tmp_path):
    bench = spark.createDataFrame([], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = "doc_id long, text string, lang string, source string, n_chars int, kept boolean, fp long, recurs int"
    rows = [(n, t, "en", None, None, None, None, None) for n, t in enumerate(ODD)] + [(None, None, None, None, None, None, None, None), (None, "words of no id at all", None, "s", 1, True, 1, 1), (3, "twice the id, other words", "en", "s", 1, True, 1, 1)]
    for docs in (spark.createDataFrame(rows, wide), spark.createDataFrame([], wide)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs.write.parquet(path := f"{tmp_path}/{docs.count()}-{k}")
            docs = stage(spark, spark.read.parquet(path), str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == [c.split()[0] for c in wide.split(", ")]
        docs.collect()
