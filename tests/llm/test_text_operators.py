"""SimHash, line dedup, decontamination, preference formatting and sharding against plain versions."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from itertools import combinations

import brute
import numpy as np
import pytest
from conftest import DATA

from tidemark.llm import decontaminate, linededup, preference, queries, sharding, simhash

SF = str(DATA / "sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars int"
LONG = "word another " * 40_000


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def odd_docs(spark, extra: str = "fp long, rep long, node long, component_id long, shard int, line string, toks string, n_lines string, key long, seed long"):
    """Nulls anywhere, empty and very long texts, repeated rows, columns named as the operators' own."""
    n = extra.count(",") + 1
    rows = [(1, "a b c d", "en"), (1, "a b c d", "en"), (2, None, None), (3, "", "en"), (4, "   \n\t", None), (None, "a b c d", "en"), (None, None, None), (5, LONG, "en"), (6, LONG + "end", "en"), (7, "x", "en"), (None, "only here, nowhere else", None)]
    return spark.createDataFrame([(*r, None, None, *[None] * n) for r in rows], f"{DOCS}, {extra}")


# SimHash


def test_simhash_query(spark, documents):
    want = brute.simhash(documents)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, SF).collect()}
    assert found == want
    assert len({c for _, c in want.values()}) < len(want)


def test_simhash_links_reach_what_all_links_reach(spark):
    """Also where many fingerprints share blocks of bits, and nodes are full."""
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b for b in base}
    for b in base:
        f = b
        for _ in range(60):  # chains and clouds
            f = (f if rng.random() < 0.5 else b) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            fps.add(f)
    low = rng.getrandbits(48)
    fps |= {rng.getrandbits(16) << 48 | low for _ in range(2500)}  # one hot value of three blocks
    fps = sorted(fps)
    df = spark.createDataFrame([(brute.signed(f), n) for n, f in enumerate(fps)], "fp long, rep long")
    got = brute.components(range(len(fps)), [(r["u"], r["v"]) for r in simhash.links(df).collect()])
    x = np.array(fps, np.uint64)
    links = [(n, int(m)) for n in range(len(x)) for m in np.nonzero(np.bitwise_count(x[n] ^ x[n + 1 :]) <= 3)[0] + n + 1]
    assert got == brute.components(range(len(fps)), links)


def test_simhash_edges(spark):
    out = simhash.simhash_dedup(odd_docs(spark)).collect()
    assert len(out) == 11
    by = {(r["doc_id"], r["fingerprint"]): r for r in out}
    zero = "0" * 16
    assert by[2, zero]["component_id"] == by[3, zero]["component_id"] == by[4, zero]["component_id"] == 2
    assert by[2, zero]["kept"] and not by[3, zero]["kept"]
    assert len([r for r in out if r["doc_id"] == 1]) == 2
    assert simhash.simhash_dedup(odd_docs(spark).limit(0)).collect() == []


def test_patterns_hold_for_all_that_differ_in_few_bits():
    masks = simhash.patterns(3)
    rng = random.Random(2)
    for _ in range(5000):
        gone = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not int(m) & gone for m in masks)


def test_simhash_links_of_full_ranges(spark, monkeypatch):
    """Many nodes and ranges to a pattern: what is pruned has no link."""
    monkeypatch.setattr(simhash, "NODE", 16)
    monkeypatch.setattr(simhash, "RANGE", 4)
    rng = random.Random(3)
    low = rng.getrandbits(44)
    fps = sorted({(rng.getrandbits(12) & rng.getrandbits(12)) << 52 | low for _ in range(1500)} | {low ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(20) << 44) for _ in range(1500)})
    got = simhash.links(spark.createDataFrame([(brute.signed(f), n) for n, f in enumerate(fps)], "fp long, rep long")).collect()
    x = np.array(fps, np.uint64)
    links = [(n, int(m)) for n in range(len(x)) for m in np.nonzero(np.bitwise_count(x[n] ^ x[n + 1 :]) <= 3)[0] + n + 1]
    assert brute.components(range(len(fps)), [(r["u"], r["v"]) for r in got]) == brute.components(range(len(fps)), links)


def test_rows_without_an_id_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs.selectExpr("doc_id", "CAST(text AS LONG) AS fp", "xxhash64(text) AS text_hash"))
    rows = [(9, 0), (None, 7), (4, 63), (None, 1 << 40), (None, 3 << 40), (7, -1), (7, -2)]
    out = simhash.simhash_dedup(spark.createDataFrame([(d, str(f)) for d, f in rows], "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["fingerprint"]): (r["component_id"], r["kept"]) for r in out}
    want = [(4, False), (4, False), (4, True), (None, True), (None, True), (7, True), (7, True)]
    # 2**40 is one bit from 0
    want[3] = want[4] = (4, False)
    assert got == {(d, f"{f % 2**64:016x}"): w for (d, f), w in zip(rows, want, strict=True)}


def test_near_skips_only_what_is_far():
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.integers(0, 2**63, 200, dtype=np.uint64), np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 8, 200, dtype=np.uint64))])
    a = a[np.argsort(simhash.gray_rank(a))]
    i, j = simhash.near(a, a, 3, leaf=16)
    x, y = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(x.tolist(), y.tolist(), strict=True))


# line dedup


def test_line_dedup_query(spark, documents):
    want = brute.line_dedup([t for _, t in documents])
    found = queries.op8_linededup(spark, SF).collect()
    assert len(found) == len(documents)
    texts = dict(documents)
    assert {r["doc_id"]: (r["text"], r["n_dropped"]) for r in found} == {d: want[t] for d, t in texts.items()}
    assert sum(r["n_dropped"] for r in found) > 0


def test_line_dedup_templates(spark):
    own = "this line stands in text {} alone, and nowhere else in any other text\nwhile {} has more of its own to tell than others, word by word"
    rows = [(n, own.format(w, w) + f"\nprinted on page {n} of the book\nconnection from host {w} was closed by peer today\nok then", "en", "s", 1) for n, w in enumerate(["alpha", "beta", "gamma", "delta"])]
    docs = spark.createDataFrame(rows, DOCS)
    out = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    for n, w in enumerate(["alpha", "beta", "gamma", "delta"]):
        kept = out[n]["text"].split("\n")
        assert "ok then" in kept and not any(x.startswith("printed on page") for x in kept)  # numbers are variable fields, short lines stay
        assert not any("was closed by peer" in x for x in kept), w
        assert out[n]["n_lines"] == 5
    two = linededup.dedup_lines(docs.limit(2)).collect()
    assert all(r["n_dropped"] == 0 for r in two)


def test_line_dedup_edges(spark):
    docs = odd_docs(spark)
    out = linededup.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = out.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    assert {r["n_lines"] for r in rows if r["text"] is None} == {0}
    assert linededup.dedup_lines(docs.limit(0)).collect() == []


# decontamination


def test_masks_fit_wherever_two_of_a_window_are_substituted():
    for gone in combinations(range(decontaminate.WINDOW), 2):
        for mask in decontaminate.MASKS:
            ones = [k for k, b in enumerate(mask) if b == "1"]
            assert any(not {at + k for k in ones} & set(gone) for at in range(decontaminate.WINDOW - len(mask) + 1)), (mask, gone)


@pytest.mark.parametrize("size", range(1, 20))
def test_masks_of_items_fit_whichever_fifth_is_substituted(size):
    window = min(size, decontaminate.WINDOW)
    for gone in combinations(range(window), window - -(-8 * window // 10)):
        used = decontaminate.masks_of(size)
        assert any(not {at + k for k, b in enumerate(m) if b == "1"} & set(gone) for m in used for at in range(window - len(m) + 1)), (size, gone)


@pytest.mark.parametrize("broadcast", [True, False])
def test_short_and_long_items_with_substitutions(spark, monkeypatch, broadcast):
    """Also where the benchmark's seeds are too many to broadcast."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    items = [(n if n % 7 else None, [word() for _ in range(size)]) for n, size in enumerate([1, 2, 3, 4, *range(5, 16), *range(5, 14), 30])]
    docs = []
    for k in range(90):
        text = [word() for _ in range(rng.randrange(30))]
        own = list(rng.choice(items)[1])
        for at in rng.sample(range(len(own)), min(len(own) // 4 + (k % 2), len(own))):
            own[at] = word()
        docs.append((k, " ".join(text + own + [word() for _ in range(rng.randrange(5))])))
    docs += [(3, docs[4][1]), (None, docs[5][1]), (500, None)]
    if not broadcast:
        from tidemark.llm import common

        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["doc_start"]) for r in found.collect()} == brute.overlaps(docs, [(i, " ".join(t)) for i, t in items])


def test_decontamination_query(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute.overlaps(documents, items)
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    found = decontaminate.contamination(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["doc_start"]) for r in found} == want
    assert want
    by = {r["doc_id"]: list(r["items"]) for r in queries.op7_decontaminate(spark, SF).collect()}
    assert by == {d: sorted({i for e, i, _ in want if e == d}) for d in {d for d, _, _ in want}}


def test_decontamination_edges(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(1, item, 5), (1, item, 5), (2, None, None), (3, "", 1), (4, "tiny item", 1)], "item_id long, text string, pos long")
    words = item.upper().split()
    words[3], words[9] = "X", "Y"
    docs = spark.createDataFrame(
        [(1, "before, " + ", ".join(words) + " after"), (1, "nothing"), (2, " ".join(["X", *words[1:], "Y"])), (3, None), (4, ""), (5, "a Tiny-item here"), (None, item), (None, "clean"), (6, "z " * 100_000 + item), (7, item.replace("five", "5").replace("ten", "10").replace("two", "2"))],
        "doc_id long, text string",
    ).withColumnsRenamed({})
    found = decontaminate.contamination(docs, bench)
    hits = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert hits == {(1, 1), (5, 4), (None, 1), (6, 1), (2, 1)} | {x for x in hits if x == (7, 1)}
    assert {r["doc_start"] for r in found.collect() if r["doc_id"] == 6} == {100_000}
    clean = decontaminate.decontaminate(docs, bench).collect()
    assert {(r["doc_id"], r["text"]) for r in clean} >= {(3, None), (4, ""), (None, "clean")}
    assert {r["doc_id"] for r in clean} <= {3, 4, None, 7}
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    assert decontaminate.contamination(docs, bench.limit(0)).collect() == []
    clash = docs.selectExpr("*", "1 AS toks", "2 AS seed", "3 AS item_id", "4 AS pos", "5 AS item", "6 AS seeds", "7 AS item_at")
    assert decontaminate.decontaminate(clash, bench).count() == len(clean)


# preference formatting


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def plain_pair(chosen, rejected):
    norm = [[(r or "", t or "") for r, t in x or []] for x in (chosen, rejected)]
    n = 0
    while n < min(map(len, norm)) and norm[0][n] == norm[1][n]:
        n += 1
    out = [n, render(norm[0][:n])]
    for turns in norm:
        text, spans = "", []
        for r, t in turns[n:]:
            text += f"<|im_start|>{r}\n"
            if r == "assistant":
                spans.append((len(text), len(text) + len(t) + len("<|im_end|>\n")))
            text += f"{t}<|im_end|>\n"
        out += [text, spans]
    return out


def test_preference_pairs(spark):
    cases = {
        1: ([("user", "hi"), ("assistant", "yes")], [("user", "hi"), ("assistant", "no")]), 2: ([], []), 3: (None, [("user", "a")]), 4: ([("user", "a")], None), 5: (None, None), 6: ([("user", None), ("assistant", "x")], [("user", ""), ("assistant", "x")]),
        7: ([("user", "q"), ("assistant", "a"), ("user", "more"), ("assistant", "b" * 100_000)], [("user", "q"), ("assistant", "a")]), 8: ([("a", "b\nc")], [("a\nb", "c")]), 9: ([("assistant", "é😀")], [("assistant", "é😀!")]),
    }
    pair = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(k, *v, "x") for k, v in cases.items()] + [(1, *cases[1], "x"), (None, *cases[1], None)], f"pair_id long, chosen {pair}, rejected {pair}, prompt string")
    rows = preference.format_pairs(df).collect()
    assert len(rows) == len(cases) + 2
    for r in rows:
        want = plain_pair(*cases[r["pair_id"] or 1])
        got = [r["n_common"], r["prompt"], r["chosen"], [tuple(s) for s in r["chosen_mask"]], r["rejected"], [tuple(s) for s in r["rejected_mask"]]]
        assert got == want, r["pair_id"]
    assert preference.format_pairs(df.limit(0)).collect() == []


def test_preference_query_same_as_sql(spark):
    import duckdb
    from conftest import rows_of

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op3_preference"])
    names = [d[0] for d in want.description]
    found = queries.op3_preference(spark, SF)
    assert sorted(found.columns) == sorted(names)
    assert rows_of(found.columns, found.collect()) == rows_of(names, want.fetchall())


# sharding


def check_shards(rows, texts: dict, shards: int):
    """rows of shard(); texts: what each doc_id may hold."""
    by: dict[str | None, set] = {}
    for r in rows:
        for t in texts[r["doc_id"]]:
            if r["text_crc32"] == zlib.crc32((t or "").encode()) and r["size"] == len((t or "").encode()) + 1:
                by.setdefault(t, set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in by.items() if t), "equal texts share a shard"
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["law"] for r in rows} <= {"bytes"} and {r["shard"] for r in rows} <= set(range(shards))


def least_largest(sizes: list[int], shards: int) -> int:
    """Smallest possible largest sum of contiguous runs, by trying capacities against all cuts."""
    ends = np.cumsum(sizes).tolist()

    def fits(c):
        at = 0
        for _ in range(shards):
            n = bisect_right(ends, at + c)
            at = ends[n - 1] if n else 0
            if at == ends[-1]:
                return True
        return False

    low, high = max(sizes) - 1, sum(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def test_sharding_query(spark, documents):
    rows = queries.op9_sharding(spark, SF).collect()
    assert len(rows) == len(documents)
    check_shards(rows, {d: [t] for d, t in documents}, 8)
    sizes: dict[int, int] = {}
    for _, t in documents:
        sizes[brute.spark_hash(t)] = sizes.get(brute.spark_hash(t), 0) + len(t.encode()) + 1
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(loads) == least_largest([sizes[k] for k in sorted(sizes)], 8)
    texts = dict(documents)
    order = [s for _, s in sorted((brute.spark_hash(texts[r["doc_id"]]), r["shard"]) for r in rows)]
    assert order == sorted(order), "runs of the groups in their order"


def even_loads(sizes: list[int], shards: int) -> list[int]:
    """Loads under the smallest capacity, each cut the nearest to an even share of the rest from which the rest fits, by trying all places."""
    capacity, ends = least_largest(sizes, shards), [0, *np.cumsum(sizes).tolist()]
    fits = lambda at, left: left * capacity >= ends[-1] - at and (at == ends[-1] or left > 0 and fits(max(e for e in ends if e <= at + capacity), left - 1))
    at, loads = 0, []
    for left in range(shards, 0, -1):
        aim = at + (ends[-1] - at) // left
        good = [e for e in ends if at <= e <= at + capacity and fits(e, left - 1)]
        end = min(good, key=lambda e: (abs(e - aim), e))
        loads.append(end - at)
        at = end
    return loads


@pytest.mark.parametrize(("shards", "n"), [(1, 10), (3, 2), (8, 200), (5, 61), (8, 300), (4, 30), (3, 31)])
def test_least_capacity(shards, n):
    rng = random.Random(n)
    groups = sorted((rng.getrandbits(64) - (1 << 63) if n != 61 else rng.randrange(100), rng.randrange(1, 50) if n % 3 or rng.random() < 0.97 else 2000) for _ in range(n))

    def summary(width, prefixes, of=0):
        out: dict[int, list[int]] = {}
        for key, size in groups:
            if prefixes is None or key >> of in prefixes:
                x = out.setdefault(key >> width, [0, 0])
                x[0] += size
                x[1] += 1
        return [(p, *x) for p, x in out.items()]

    merged: dict[int, int] = {}
    for key, size in groups:
        merged[key] = merged.get(key, 0) + size
    sizes = [merged[k] for k in sorted(merged)]
    if len(merged) == len(groups):
        capacity, starts = sharding.least_capacity(summary, shards)
        assert capacity == least_largest(sizes, shards)
        starts = [x for x in starts if x is not None]
        loads = [sum(s for k, s in merged.items() if sum(k >= x for x in starts) == p) for p in range(shards)]
        assert sorted(loads) == sorted(even_loads(sizes, shards)) and max(loads) == capacity


def test_sharding_edges(spark):
    docs = odd_docs(spark)
    rows = sharding.shard(docs, 3).collect()
    assert len(rows) == 11
    texts: dict = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    check_shards(rows, texts, 3)
    assert sharding.shard(docs.limit(0)).collect() == []
    one = sharding.shard(spark.createDataFrame([(n, "same") for n in range(50)], "doc_id long, text string")).collect()
    assert len({r["shard"] for r in one}) == 1 and sorted(r["slot"] for r in one) == list(range(50))
