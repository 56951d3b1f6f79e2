"""Vector codes against a plain version that measures every entry."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import DATA

from tidemark.llm import queries, vectorcodes
from tidemark.llm.common import table

SF = str(DATA / "sf0.001")


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """rows (vec_id, vector, label) -> [(vec_id, code, error, label_error)], digest of the codebooks."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    books = [[v[p * width : (p + 1) * width] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [v[p * width : (p + 1) * width] for _, v, _ in kept]
            sums, used = [[0] * width for _ in book], [0] * len(book)
            for x in own:
                n = nearest(book, x)[1]
                used[n] += 1
                sums[n] = [a + b for a, b in zip(sums[n], x, strict=True)]
            for n, k in enumerate(used):
                if k:
                    book[n] = [s // k for s in sums[n]]
    out = []
    for i, v, label in kept:
        found = [nearest(book, v[p * width : (p + 1) * width]) for p, book in enumerate(books)]
        out.append((i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), label))
    errors: dict = {}
    for _, _, e, label in out:
        errors[label] = errors.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, errors[label]) for i, c, e, label in out), key=repr), digest


def ours(spark, rows, **parameters):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = vectorcodes.compress(docs, **parameters)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vectorcodes.label_errors(coded).collect()), key=repr), books


def test_query_as_the_plain_version(spark):
    rows = [tuple(r) for r in table(spark, SF, "embeddings").select("vec_id", "embedding", "label").collect()]
    want, digest = plain(rows)
    out = queries.op12_vectorcodes(spark, SF).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out), key=repr) == want
    assert {r["codebooks_sha256"] for r in out} == {digest}


@pytest.mark.parametrize(("width", "spread"), [(1, 3.0), (3, 0.01), (7, 1.0), (16, 1e-3), (24, 9.0)])
def test_no_nearest_entry_is_lost(width, spread):
    rng = np.random.default_rng(width)
    book = np.floor(rng.normal(size=(200, width)) * spread * 1024).astype(np.int64)
    book[100:120] = book[:20]  # equal entries: the lower index wins
    x = np.concatenate([book + rng.integers(-2, 3, book.shape), np.floor(rng.normal(size=(300, width)) * spread * 1024).astype(np.int64)])
    x = np.concatenate([x, (book[:-1] + book[1:]) // 2, np.full((3, width), 1 << 23)])
    far = ((x[:, None, :] - book[None]) ** 2).sum(2)
    code, least = vectorcodes.Book(book).nearest(x)
    assert (code == far.argmin(1)).all() and (least == far.min(1)).all()


def test_bounds_do_filter():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(256, 16)) * 1024
    x = np.floor(centres[rng.integers(0, 256, 2000)] + rng.normal(size=(2000, 16)) * 100).astype(np.int64)
    row, _ = vectorcodes.Book(np.floor(centres).astype(np.int64))._survivors(x)
    assert len(row) < 0.02 * 2000 * 256


def test_ties_copies_nulls_and_labels(spark):
    rng = random.Random(4)
    vectors = [[rng.choice([-1.5, 0.0, 0.25, 1.0]) for _ in range(8)] for _ in range(40)]
    rows = [(n, v, n % 3 if n % 4 else None) for n, v in enumerate(vectors)] + [(7, vectors[7], 1)] * 3 + [(None, vectors[5], 2)]
    bad = [(900, None, 1), (901, [None] + [0.0] * 7, 1), (902, [float("nan")] + [0.0] * 7, 1), (903, [float("-inf")] + [0.0] * 7, 1)]
    for parameters in ({"entries": 9}, {"entries": 256, "rounds": 2}, {"parts": 2, "entries": 5, "scale": 3}):
        want, digest = plain(rows, **parameters)
        own, books = ours(spark, rows + bad, **parameters)
        assert own == want and books.sha256() == digest


def test_components_of_any_size(spark):
    rng = random.Random(5)
    rows = [(n, [rng.choice([1.0, 3e38, -2.5e30, 1e5]) * rng.random() for _ in range(4)], None) for n in range(30)]
    want, digest = plain(rows, entries=6)
    own, books = ours(spark, rows, entries=6)
    longest = vectorcodes.LONG_MAX
    assert own == sorted(((i, c, min(e, longest), min(s, longest)) for i, c, e, s in want), key=repr) and books.sha256() == digest


def test_other_lengths_empty_tables_and_decoding(spark):
    rows = [(n, [float(n), 1.0, 2.0, 3.0], 0) for n in range(6)] + [(50, [1.0, 2.0], 0), (51, [], 1)]
    own, books = ours(spark, rows)
    assert [r for r in own if r[0] >= 50] == [(50, None, None, 0), (51, None, None, None)]
    assert [r[2] for r in own if r[0] < 50] == [0] * 6
    docs = spark.createDataFrame(rows[:6], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS code", "2 AS error", "3 AS of_label")
    coded, books = vectorcodes.compress(docs)
    back = vectorcodes.decode(coded, books).collect()
    assert {r["vec_id"]: list(r["decoded"]) for r in back} == {i: v for i, v, _ in rows[:6]}
    coded, books = vectorcodes.compress(docs.limit(0))
    assert books is None and vectorcodes.label_errors(coded).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vectorcodes.compress(docs, parts=3)
