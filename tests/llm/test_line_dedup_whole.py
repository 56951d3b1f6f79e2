"""Line dedup leaves no recurring line in place because of the text that holds it or because it is short."""

from __future__ import annotations

import random

import brute
from conftest import DATA

from tidemark.llm import linededup
from tidemark.llm.common import table


def letters(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(n))


def test_a_text_of_mostly_recurring_lines_loses_them(spark):
    rng = random.Random(1)
    passage = letters(rng, 60)
    own = [letters(rng, 10) for _ in range(4)]
    docs = spark.createDataFrame([(n, f"{passage}\n{x}") for n, x in enumerate(own)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == dict(enumerate(own))


def test_short_lines_above_chance_go(spark):
    rng = random.Random(2)
    texts = []
    for n in range(60):  # "and" is every second word; as a line of its own it is no more frequent than other lines of one word
        body = " ".join(f"{w} and" for w in letters(rng, 20).split())
        texts.append("\n".join([body, *(["All rights reserved."] if n % 2 else []), *(["And."] if n % 3 == 0 else []), *(["---"] if n % 5 else []), letters(rng, 1)]))
    out = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {n: t.replace("\nAll rights reserved.", "") for n, t in enumerate(texts)}


def test_each_of_several_templates_of_a_leaf_is_found(spark):
    rng = random.Random(3)
    families = ["the file was read by {} from a disk in room nine", "the file was sent to {} over the wire at last night", "the file was {} because its owner had left us all"]
    texts = [f"{letters(rng, 12)}\n{f.format(letters(rng, 1))}" for f in families for _ in range(4)]
    texts += [f"{letters(rng, 12)}\nthe file was {letters(rng, 8)}" for _ in range(2)]  # the leaf's own lines, alike in nothing further
    out = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {n: t.split("\n")[0] if n < 12 else t for n, t in enumerate(texts)}


def planted(rng: random.Random) -> list[str]:
    """Texts with several families of lines in one leaf, exact lines and short ones, some above and some below the bounds."""
    body = lambda: letters(rng, 15)
    texts = [f"{body()}\nconnection from host {letters(rng, 1)} was closed by peer today\n{body()}" for _ in range(6)]
    texts += [f"connection from host refused {letters(rng, 1)} because table is full\n{body()}" for _ in range(5)]
    texts += [f"{body()}\nconnection from host lost {letters(rng, 1)} in the last night" for _ in range(2)]
    texts += [f"{body()}\nseen at place {letters(rng, 1)}" for _ in range(4)]
    texts += [f"{body()}\n{letters(rng, 2)} of page {n} and {letters(rng, 6)}" for n in range(9)]
    texts += ["the same two lines stand here\nand nothing else does at all" + "\n" * k for k in range(6)]
    return texts + [f"{body()}\nAll rights reserved." for _ in range(12)]


def test_planted_families_as_the_method_has_it(spark):
    texts = planted(random.Random(4))
    out = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute.line_dedup(texts)
    assert out == {n: want[t] for n, t in enumerate(texts)}
    assert all("connection from host" not in out[n][0] for n in range(11)) and all("connection from host lost" in out[n][0] for n in (11, 12))
    assert all(out[n][0].strip() == "" for n in range(26, 32)) and all("reserved" not in out[n][0] for n in range(32, 44))


def test_copies_count_once_or_each(spark):
    docs = spark.createDataFrame([(n, "four tokens of text\nand then four more") for n in range(3)] + [(3, "alone in all the rows")], "doc_id long, text string")
    assert {r["n_dropped"] for r in linededup.dedup_lines(docs).collect()} == {0}
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs, count_copies=True).collect()} == {0: "", 1: "", 2: "", 3: "alone in all the rows"}


def test_lines_of_any_length_can_be_judged_by_their_template(spark):
    docs = spark.createDataFrame([(n, f"home\n{w}") for n, w in enumerate(["one", "two", "three"])], "doc_id long, text string")
    assert {r["text"] for r in linededup.dedup_lines(docs, least_tokens=1).collect()} == {"one", "two", "three"}


def test_a_line_with_more_texts_does_not_hide_a_family(spark):
    rng = random.Random(6)
    own = [f"{letters(rng, 9)}\nalpha beta gamma common {letters(rng, 3)} xx yy zz" for _ in range(6)]
    for times in (2, 4):
        other = [f"{letters(rng, 9)}\nalpha beta gamma common pp qq rr ss tt uu" for _ in range(times)]
        out = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(own + other)), "doc_id long, text string")).collect()}
        assert [out[n] for n in range(6)] == [1] * 6 and [out[n] for n in range(6, 6 + times)] == [times // 3] * times


def test_large_groups_are_parted_until_none_is_lost(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SMALL", 3)
    rng = random.Random(7)
    texts = [f"{letters(rng, 6)}\nthe same start of {w} {letters(rng, 1)} line {w} {w}x end {letters(rng, 1)} here" for w in ("one", "two", "six", "ten", "few") for _ in range(4)]
    texts += [f"{letters(rng, 6)}\nthe same start of {letters(rng, 8)} here" for _ in range(9)]
    texts += [f"{letters(rng, 6)}\nthe same start {rng.choice('ab')} {rng.choice('cd')} {rng.choice('ef')} {rng.choice('gh')} {rng.choice('ij')} {rng.choice('kl')} {letters(rng, 1)} here" for _ in range(30)]
    out = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute.line_dedup(texts)
    assert out == {n: want[t] for n, t in enumerate(texts)} and all(out[n][1] == 1 for n in range(20))


def test_a_line_that_does_not_lead_its_group_still_leads_a_template(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SMALL", 3)
    texts = [[], [], []]
    for leaf in "abcdefghijkl":  # the first line alone belongs together with lines of all three texts
        start = f"leaf {leaf} of"
        texts[0] += [f"{start} {x} same end" for x in ("one", "two", "six", "ten")]
        texts[1] += [f"{start} few same end"]
        texts[2] += [f"{start} one same other"]
    docs = spark.createDataFrame([(n, "\n".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(docs).collect()} == {0: 48, 1: 12, 2: 12}


def chains(rng: random.Random) -> list[str]:
    """Texts with leaves of lines that drift apart, some of them held by few texts: many belong together with a line that is settled early, or that only others lead to."""
    texts: list[list[str]] = []
    for leaf in range(40):
        n = rng.choice((4, 6, 8, 10, 13, 20))
        own = [[letters(rng, 4)] for _ in range(rng.choice((2, 3, 9)))]
        line = [rng.choice("abcdef") for _ in range(n - 3)]
        for _ in range(rng.choice((6, 25, 40))):
            line = list(line)
            for _ in range(rng.randrange(1, 2 + n // 5)):
                line[rng.randrange(n - 3)] = rng.choice("abcdefghijkl")
            text = rng.choice(own)
            text.append(" ".join([f"leaf{'abcdefghij'[leaf % 10]}", "klmno"[leaf // 10], "of", *line]))
        texts += own
    return ["\n".join(x) for x in texts]


def test_no_line_is_lost_where_families_drift(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SMALL", 3)
    texts = chains(random.Random(8))
    out = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute.line_dedup(texts)
    assert [n for n, t in enumerate(texts) if out[n] != want[t]] == []
    assert 0 < sum(n for _, n in out.values()) < sum(t.count("\n") for t in texts)


def test_no_line_is_lost_where_large_leaves_are_parted_by_places(spark, monkeypatch):
    for name, least in (("SMALL", 3), ("KEYED", 6), ("BLOCKED", 0)):
        monkeypatch.setattr(linededup, name, least)
    rng = random.Random(9)
    texts = chains(rng) + [f"{letters(rng, 6)}\nthe same start of {w} {letters(rng, 1)} line {w} {w}x end {letters(rng, 1)} here" for w in ("one", "two", "six") for _ in range(8)]
    texts += ["\n".join([f"the same start of table {letters(rng, 2)} row here and on it goes" for _ in range(20)]) for _ in range(2)]  # a family that two texts hold
    out = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute.line_dedup(texts)
    assert [n for n, t in enumerate(texts) if out[n] != want[t]] == []
    assert out[len(texts) - 1][1] == 0 and 0 < sum(n for _, n in out.values()) < sum(t.count("\n") for t in texts)


def test_words_are_counted_before_they_are_joined_and_a_large_family_takes_few_jobs(spark, monkeypatch):
    plans, write = {}, linededup.cut
    monkeypatch.setattr(linededup, "cut", lambda df, tag: (plans.setdefault(tag, df._jdf.queryExecution().optimizedPlan().toString()), write(df, tag))[1])
    rng = random.Random(10)
    texts = [f"{letters(rng, 40)}\nsome words of a line that {letters(rng, 1)} is in each of these texts\nAll rights reserved" for _ in range(200)]
    spark.sparkContext.setJobGroup("a large family", "")
    out = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    spark.sparkContext.setJobGroup("after it", "")
    assert {r["n_dropped"] for r in out} == {2}
    assert "LeftSemi" not in plans["line-shares"]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("a large family")) <= 70


def test_blocks_of_a_large_family_give_a_row_for_each_line_and_none_for_a_pair(spark, monkeypatch):
    plans, write = {}, linededup.cut
    monkeypatch.setattr(linededup, "cut", lambda df, tag: (plans.setdefault(tag, df._jdf.queryExecution().optimizedPlan().toString()), write(df, tag))[1])
    held = lambda n: [(n, n, 1)]
    rows = [(1, 62, n, [1, 2, 3, 4, 5, n], held(n)) for n in range(60)]  # every line leads
    rows += [(1, 62, n, [1, 2, 3, n, 9, n], held(n)) for n in (60, 61)]  # agree with none
    rows += [(2, 4, 100 + n, [1, 2, 3, 4, *rest], held(n)) for n, rest in enumerate(([5, 5, 5, 5], [5, 5, 6, 6], [6, 6, 5, 5], [7, 7, 8, 8]))]  # the first leads three, two of which lead none
    words = spark.createDataFrame(rows, "leaf long, lines long, line_hash long, tokens array<long>, held array<struct<text_a: long, text_b: long, rows: long>>")
    assert sorted(r["line_hash"] for r in linededup._family_lines(words).collect()) == [*range(60), 100, 101, 102]
    assert plans["line-blocks"].count("Generate") == 1 and "Generate" not in plans["line-family"]
    out = linededup._in_blocks(words.withColumnRenamed("leaf", "group")).collect()
    assert len(out) == len(rows) and {r["line_hash"] for r in out if r["goes"]} == {*range(60), 100, 101, 102}


def test_columns_with_names_of_its_own(spark):
    docs = spark.createDataFrame([(n, f"{letters(random.Random(n), 5)}\nthe very same line") for n in range(3)], "doc_id long, text string").selectExpr("*", "1 AS __gone", "2 AS __a", "3 AS __b")
    assert {tuple(r[c] for c in ("__gone", "__a", "__b", "n_dropped")) for r in linededup.dedup_lines(docs).collect()} == {(1, 2, 3, 1)}


def test_documents_as_the_method_has_it(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, str(DATA / "sf0.1"), "documents").select("doc_id", "text").collect()]
    want = brute.line_dedup([t for _, t in docs])
    out = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in linededup.dedup_lines(table(spark, str(DATA / "sf0.1"), "documents")).select("doc_id", "text", "n_dropped").collect()}
    assert [d for d, t in docs if t is not None and out[d] != want[t]] == []
    assert sum(n for _, n in out.values()) > 8_000
