"""Alignment of two tokenizers' tokens by a transducer over dangling suffixes.

The transducer reads tokens of both sides of one text. Its state is which side leads and the bytes by which it leads, the residual; the next token is
read from the side that trails. A token shorter than the residual leaves a shorter one, a longer one makes its side the leader, and where the residual
is empty both sides end at one byte: a group of tokens closes. Moves are kept by state and next token. Where both tokenizers end a token before
a blank, the transducer is in its first state there, so texts are cut at such places and what stretches emit is kept, too.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytebpe import byte_characters, stretches
from tidemark.llm.common import cut, hint_small, small_batches
from tidemark.llm.sentencepiece_fst import MARK, Model

KEPT_STRETCHES, KEPT_MOVES, LONG = 250_000, 500_000, 64
#: Links of which a pair holds more than this share are frequent: there are fewer of such pairs than its inverse, whatever the corpus.
FREQUENT = 1e-5
#: Stretches encoded at a time: the library's results are large.
ENCODED = 2_000
#: Marks that are looked at by themselves where they end a stretch.
MARKS = ".,;:!?)"
NEITHER, A, B = 0, 1, 2
ALIGNED = "row long, doc_id long, n_a int, n_b int, n_groups int, n_links long, groups string, pairs array<long>, times array<int>"


class Transducer:
    """Groups of tokens that cover the same bytes."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.bytes = (b"", a_bytes, b_bytes)
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple[int, bytes]] = [(NEITHER, b"")]
        self.numbers = {(NEITHER, b""): 0}
        #: For each state whether B trails, and the state after each token read so far.
        self.reads_b, self.moves = [False], [{}]
        self.known = 0

    def _move(self, state: int, token: int) -> int:
        """The state after a token of the side that trails (of A where neither leads); -1 if its bytes differ from the residual."""
        leader, residual = self.states[state]
        side = B if leader == A else A
        data = self.bytes[side][token]
        if data.startswith(residual):
            after = (side, data[len(residual) :])
        elif residual.startswith(data):
            after = (leader, residual[len(data) :])
        else:
            after = None
        number = -1
        if after is not None:
            after = after if after[1] else (NEITHER, b"")
            number = self.numbers.setdefault(after, len(self.states))
            if number == len(self.states):
                self.states.append(after)
                self.reads_b.append(after[0] == A)
                self.moves.append({})
        self.moves[state][token] = number
        self.known += 1
        return number

    def run(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """The groups (ids of A, ids of B) of two token sequences; None if their bytes differ."""
        if self.known > KEPT_MOVES:
            self.clear()
        out, state, i, j, from_i, from_j, n_a, n_b = [], 0, 0, 0, 0, 0, len(a), len(b)
        moves, reads_b = self.moves, self.reads_b
        while True:
            if reads_b[state]:
                if j == n_b:
                    break
                token, j = b[j], j + 1
            else:
                if i == n_a:
                    break
                token, i = a[i], i + 1
            after = moves[state].get(token)
            state = self._move(state, token) if after is None else after
            if state <= 0:
                if state:
                    return None
                out.append((a[from_i:i], b[from_j:j]))
                from_i, from_j = i, j
        return out if state == 0 and i == n_a and j == n_b else None


#: What a text or stretch emits: its groups as text, numbers of tokens (of A << 32 | of B), and for each group its link (id of A << 32 | id of B) as 64-bit integers.
Emitted = tuple[str, int, bytes]
_NOTHING: Emitted = ("", 0, b"")


class Aligner:
    """Encodes texts with both tokenizers and aligns them. a: file of a byte-level tokenizer; b: file of a sentencepiece model."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        back = {c: n for n, c in enumerate(byte_characters())}
        a_bytes = []
        for n in range(self.a.get_vocab_size()):
            token = self.a.id_to_token(n) or ""
            a_bytes.append(bytes(map(back.__getitem__, token)) if all(c in back for c in token) else token.encode())
        with open(b, "rb") as f:
            model = f.read()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        # a later field overrides: the same model without the blank it puts first, for stretches inside a text
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x02\x18\x00")
        pieces = ((self.b.id_to_piece(n), self.b.is_byte(n)) for n in range(self.b.get_piece_size()))
        b_bytes = [bytes([int(p[3:5], 16)]) if is_byte else p.replace(MARK, " ").encode() for p, is_byte in pieces]
        self.transducer = Transducer(a_bytes, b_bytes)
        self.names = [[str(n) for n in range(len(side))] for side in (a_bytes, b_bytes)]
        self.cuttable = self._cuttable(json.loads(self.a.to_str()), b)
        # a word and the marks after it end tokens of A; of B too, where no piece has the mark after a letter or digit
        after = {y for n in range(self.b.get_piece_size()) for x, y in pairwise(self.b.id_to_piece(n)) if x.isalnum()}
        marks = "".join(c for c in MARKS if c not in after)
        self.marked = re.compile(rf"(.*[A-Za-z0-9À-ÖØ-öø-ÿ])([{re.escape(marks)}]+)").fullmatch if marks else None
        self.kept: dict[str, Emitted] = {}

    @staticmethod
    def _cuttable(parts: dict, b: str) -> bool:
        """Whether both tokenizers end a token before each blank or newline that follows no white space, and drop or change none."""
        pre = parts.get("pre_tokenizer") or {}
        if parts.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or not all(t["special"] for t in parts["added_tokens"]):
            return False
        try:
            model = Model.load(b)
        except ValueError:  # changes characters or has pieces of its user
            return False
        return model.cuts and model.dummy_prefix and not model.squeeze_blanks

    def _emit(self, parts: list[str], b_ids: list[list[int]]) -> list[Emitted | None]:
        out: list[Emitted | None] = []
        a_bytes, (name_a, name_b) = self.transducer.bytes[A].__getitem__, self.names
        for part, a, b in zip(parts, self.a.encode_batch_fast(parts, add_special_tokens=False), b_ids, strict=True):
            ids = a.ids
            groups = self.transducer.run(ids, b)
            if groups is None or not self.cuttable and b"".join(map(a_bytes, ids)) != part.encode("utf-8", "replace"):  # a cuttable A keeps all bytes
                out.append(None)
                continue
            text = ";".join([f"{name_a[x[0]]}|{name_b[y[0]]}" if len(x) == len(y) == 1 else f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups])
            out.append((text, len(ids) << 32 | len(b), array("q", [x[-1] << 32 | y[-1] for x, y in groups]).tobytes()))
        return out

    def align(self, texts: list[str | None]) -> list[Emitted]:
        """What each text emits; nothing where a tokenizer drops or changes a byte."""
        if not self.cuttable:
            there = [t for t in texts if t]
            found = (e for t in there for e in self._emit([f" {t}"], [self.b.encode(t)]))
            return [(next(found) or _NOTHING) if t else _NOTHING for t in texts]
        cuts = [stretches(f" {t}") if t else [] for t in texts]
        used = set().union(*cuts)
        if len(self.kept) > KEPT_STRETCHES:  # those in use again stay
            self.kept = {part: self.kept[part] for part in used if part in self.kept}
        new, bad = list(used.difference(self.kept)), set()
        parted = {part: m.groups() for part in new if (m := self.marked(part))} if self.marked else {}
        whole = list({x for p in new for x in parted.get(p, (p,))}.difference(self.kept))
        for k in range(0, len(whole), ENCODED):
            some = whole[k : k + ENCODED]
            for part, e in zip(some, self._emit(some, self.inner.encode(some, num_threads=1)), strict=True):
                if e is None:
                    bad.add(part)
                else:
                    self.kept[part] = e
        for part, (word, marks) in parted.items():
            if word in bad or marks in bad:
                bad.add(part)
            else:
                (g, n, x), (h, m, y) = self.kept[word], self.kept[marks]
                self.kept[part] = (f"{g};{h}", n + m, x + y)
        out = []
        for parts in cuts:
            if not parts or bad and not bad.isdisjoint(parts):
                out.append(_NOTHING)
            else:
                groups, sizes, links = zip(*map(self.kept.__getitem__, parts), strict=True)
                out.append((";".join(groups), sum(sizes), b"".join(links)))
        for part in (*new, *whole):
            if len(part) > LONG:
                self.kept.pop(part, None)
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) for each row of docs (doc_id, text, ...).

    groups is the alignment: ids of A and B by group in the order of the text, as `a1,a2|b1;a3|b2,b3`. pairs are the links, tokens that end at one byte, as
    id of A << 32 | id of B, and times says how often each occurs in the text. A reads the text after a blank, B puts that blank itself. Null and
    empty texts, and those of which a tokenizer drops or changes a byte, have no tokens: zeros, empty text, no pairs. Rows are numbered, so
    repeated and null ids keep apart; other columns are not read. The result is written, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark, 200)

    def run(batches):
        from pyspark import TaskContext

        if (a, b) not in _aligners:
            _aligners[a, b] = Aligner(a, b)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            groups, sizes, links = zip(*_aligners[a, b].align(batch.column(1).to_pylist()), strict=True) if n else ((), (), ())
            n_groups = [len(x) // 8 for x in links]
            counted = [np.unique(np.frombuffer(x, np.int64), return_counts=True) for x in links]
            ends = pa.array(np.cumsum([0, *(len(p) for p, _ in counted)]).astype(np.int32))
            pairs, times = (np.concatenate([c[k] for c in counted]) if n else np.zeros(0) for k in (0, 1))
            ints = [pa.array(x, pa.int32()) for x in ([s >> 32 for s in sizes], [s & 0xFFFFFFFF for s in sizes], n_groups)]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(kind))) for x, kind in ((pairs, np.int64), (times, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0), *ints, pa.array(n_groups, pa.int64()), pa.array(groups, pa.string()), *lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
            row += n

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED), "aligned")


def _links(aligned: DataFrame) -> DataFrame:
    """(row, pair, times): each different link of each text."""
    return aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, count long, best boolean): how many links of the corpus hold a pair, and whether no pair of its id of B has more."""
    counts = cut(_links(aligned).groupBy("pair").agg(F.sum("times").alias("count")), "link-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = cut(counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("most")), "link-most")
    return cut(counts.withColumn("b_id", b_id).join(hint_small(most), "b_id").select("pair", F.shiftright("pair", 32).alias("a_id"), "b_id", "count", (F.col("count") == F.col("most")).alias("best")), "link-pairs")


def link_scores(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of the rows with links: those whose pair is the best of its id of B, and the sum of all links' counts.

    Pairs that hold more than a share FREQUENT of all links are broadcast, at most 1 / FREQUENT of them; links of all others meet their pair in a
    shuffle in which no pair holds more than that share.
    """
    total = counts.agg(F.sum("count")).first()[0] or 0
    frequent = counts.where(F.col("count") > total * FREQUENT).select("pair", "count", "best")
    rare = counts.where(F.col("count") <= total * FREQUENT).select("pair", "count", "best")
    links = _links(aligned)
    often = links.join(F.broadcast(frequent), "pair")
    seldom = links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(rare, "pair")
    scored = [x.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum")) for x in (often, seldom)]
    return scored[0].unionByName(scored[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
