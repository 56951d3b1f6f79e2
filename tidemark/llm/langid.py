"""Language identification with language-bitmask n-gram filters.

A filter is an array of slots, each holding one bit per language: a bit-sliced Bloom filter. An n-gram's hash functions name a few
slots, and the AND of these gives all languages that may contain it in one look. Per document, popcounts by language are corrected for
each language's false-positive rate (its share of set bits to the power of the number of hash functions) and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fold, small_batches

SLOTS_LOG2 = 19
HASHES = 3
#: Documents of each language that the filters are learned from, about; all labelled ones up to that number.
TRAIN_PER_LANGUAGE = 4000
#: A language contains an n-gram if it makes this share of the frequency of the language that uses it most, and at least so many uses.
SHARE, LEAST_USES = 0.25, 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_PIECE = 500_000  # characters worked on at a time
BLANK = 0x20
_lower: np.ndarray | None = None


def lower_letters() -> np.ndarray:
    """For each code point the lower-case letter (itself where that is more than one character), a blank for what is no letter."""
    global _lower
    if _lower is None:
        _lower = np.full(0x110000, BLANK, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                _lower[c] = ord(x.lower()) if len(x.lower()) == 1 else c
    return _lower


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
    """(document numbers at each piece's start, joined text) in runs of about _PIECE characters; long texts are cut with two characters kept."""
    numbers, starts, parts, size = [], [], [], 0
    for n, text in enumerate(texts):
        if not text:
            continue
        for at in range(0, len(text), _PIECE):
            part = text[max(0, at - 2) : at + _PIECE]
            # a cut goes on as if nothing were between: the two kept characters open the windows that end in this piece
            part = part if at else " " + part
            part = part if at + _PIECE < len(text) else part + "  "
            numbers.append(n)
            starts.append(size)
            parts.append(part)
            size += len(part)
            if size >= _PIECE:
                yield np.array([numbers, starts], np.int64), "".join(parts)
                numbers, starts, parts, size = [], [], [], 0
    if parts:
        yield np.array([numbers, starts], np.int64), "".join(parts)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed code points of each window of three lower-case characters whose middle is a letter, and the windows' places. Other characters count as blanks."""
    code = lower_letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    is_letter = code != BLANK
    code = code.astype(np.uint64)
    at = np.nonzero(is_letter[1:-1])[0]
    return (code[at] << np.uint64(42)) | (code[at + 1] << np.uint64(21)) | code[at + 2], at


def slots(gram: np.ndarray, k: int, slots_log2: int) -> np.ndarray:
    return ((gram ^ (gram >> np.uint64(29))) * _ODD[k] >> np.uint64(64 - slots_log2)).astype(np.int64)


@dataclass(frozen=True)
class Filters:
    """languages in the order of their bits; masks: (words of 64 languages, slots)."""

    languages: list[str]
    masks: np.ndarray
    hashes: int

    @property
    def slots_log2(self) -> int:
        return int(self.masks.shape[1]).bit_length() - 1

    def false_positive(self) -> np.ndarray:
        fill = [((self.masks[n // 64] >> np.uint64(n % 64)) & np.uint64(1)).mean() for n in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and by language how many of them its filter contains."""
        total, by = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)), np.int64)
        # few languages fit a narrow word, which keeps the filter in the CPU's cache
        masks = self.masks.astype(np.uint8) if len(self.languages) <= 8 else self.masks
        for (numbers, starts), text in _pieces(texts):
            gram, at = grams(text)
            if not len(gram):
                continue
            places = [slots(gram, k, self.slots_log2) for k in range(self.hashes)]
            edge = np.searchsorted(at, np.append(starts, len(text)))
            np.add.at(total, numbers, np.diff(edge))
            for word in range(masks.shape[0]):
                hit = masks[word][places[0]]
                for p in places[1:]:
                    hit &= masks[word][p]
                for n in range(64 * word, min(len(self.languages), 64 * word + 64)):
                    run = np.concatenate([[0], np.cumsum((hit >> hit.dtype.type(n % 64)) & hit.dtype.type(1), dtype=np.int64)])
                    np.add.at(by[:, n], numbers, np.diff(run[edge]))
        return total, by

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language (`und` for a text without letters) and the corrected share of its n-grams that the language contains."""
        total, by = self.counts(texts)
        fp = self.false_positive()
        real = np.clip((by - total[:, None] * fp) / np.maximum(1e-9, 1 - fp), 0, None)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = real.argmax(1)
        score = np.clip(real[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        return [self.languages[b] if t else "und" for b, t in zip(best, total, strict=True)], np.where(total > 0, score, 0.0)


def train(docs: DataFrame, usable: Column, slots_log2: int = SLOTS_LOG2, hashes: int = HASHES, per_language: int = TRAIN_PER_LANGUAGE) -> Filters:
    """Learn filters from the usable rows of docs (doc_id, text, lang) that have a lang.

    Of each language the rows with the least hash of doc_id serve, about per_language of them. Their n-grams are
    counted in tasks and by Spark; only the filter itself, 2**slots_log2 slots, comes to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], np.zeros((1, 2**slots_log2), np.uint64), hashes)
    limit = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(per_language / sizes[k]))))
    place = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = labelled.where(place < limit[F.col("lang")]).select("lang", "text")

    def count(batches):
        for b in batches:
            by: dict[str, list] = {}
            for lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for _, text in _pieces(texts):
                    gram, n = np.unique(grams(text)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    uses = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    uses = cut(uses, "langid-grams")
    totals = {r["lang"]: r["n"] for r in uses.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(float(totals.get(k, 1))))))
    bit = F.create_map(*(x for n, k in enumerate(languages) for x in (F.lit(k), F.lit(n))))
    rated = uses.select("gram", "lang", "n", (F.col("n") / total[F.col("lang")]).alias("f"))
    most = rated.groupBy("gram").agg(F.max("f").alias("most"))
    chosen = rated.join(most, "gram").where((F.col("n") >= LEAST_USES) & (F.col("f") >= SHARE * F.col("most"))).select("gram", bit[F.col("lang")].alias("bit"))

    def placed(batches):
        for b in batches:
            gram = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(hashes):
                yield pa.RecordBatch.from_arrays([pa.array(slots(gram, k, slots_log2)), b.column(1)], ["slot", "bit"])

    word, mask = F.floor(F.col("bit") / 64).cast("int"), F.expr("shiftleft(1L, bit % 64)")
    rows = chosen.mapInArrow(placed, "slot long, bit int").groupBy(word.alias("word"), "slot").agg(F.bit_or(mask).alias("mask")).toArrow()
    masks = np.zeros((-(-len(languages) // 64), 2**slots_log2), np.uint64)
    masks[rows["word"].to_numpy(), rows["slot"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return Filters(languages, masks, hashes)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id long, lang_pred string, score double) for each row of docs (doc_id, text, ...); reads text alone.

    Null texts and texts without letters get `und` and score 0, as do all where no language was learned. Ties go to the language first in
    the alphabet. Repeated rows and null ids come back as given.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2**slots_log2 words: a fixed size

    def run(batches):
        for b in batches:
            lang, score = shared.value.decide(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from the rows that are not held out, predict for every row."""
    filters = train(docs, ~held_out(F.col("doc_id")))
    return identify(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Share of a document's n-grams that its language explains, below which a corpus does without the document.
LEAST_SCORE = 0.3


def keep_identified(docs: DataFrame, filters: Filters, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs (text, ...) with all their columns whose language is known with at least least_score; `und` goes."""
    small_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for b in batches:
            lang, score = shared.value.decide(b.column("text").to_pylist())
            keep = [x != "und" and s >= least_score for x, s in zip(lang, score, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
