"""Byte-level BPE encoding and decoding through a sentencepiece BPE model that is written directly from a vocabulary of ranks.

Each byte has a printable character of its own, so each token is a piece of such characters. Pieces are scored by their negative ranks and
the normaliser is the identity: the model merges the neighbours of the lowest rank first, the leftmost of equals, as byte-level BPE does. Nothing
is trained. Texts are cut into pre-tokens by a pattern; each is encoded by itself, or is one id if it is a token as a whole. Decoding maps ids back
to pieces and their characters to bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructField, StructType

from tidemark.llm.common import small_batches

KEPT_WORDS, LONG = 1_000_000, 64
#: Scores are 32-bit floats, which hold integers up to here.
MOST_RANKS = 1 << 24
#: Never assigned to a character.
UNASSIGNED = "\U0001fffe"
UNKNOWN_PIECE = "<unk>"
#: The pattern whose pre-tokens end where white space begins (a fixed value of its vocabularies).
CUTTABLE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stands where a text is cut.
CUT = "\x1f"
_ODD_BLANK, _BLANK_CUT = re.compile(r"[^\S \n]"), re.compile(rf"(\s){CUT}")
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def byte_characters() -> list[str]:
    """The character of each byte: itself where it is printable and no blank, else one from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a line each, the token in base 64."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes((*out, n))


def _field(number: int, value: int | float | bytes) -> bytes:
    """A field of a protocol-buffer message: an integer, a 32-bit float, or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model with a piece for each token, in the order of ranks, and an unknown piece after them."""
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary has no token for byte {missing[0]}")
    if max(ranks.values()) >= MOST_RANKS or min(ranks.values()) < 0:
        raise ValueError(f"ranks run from 0 to {MOST_RANKS - 1}")
    chars = byte_characters()
    pieces = [(("".join(map(chars.__getitem__, token))).encode(), -float(rank), _NORMAL) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append((UNKNOWN_PIECE.encode(), 0.0, _UNKNOWN))
    model = b"".join(_field(1, _field(1, text) + _field(2, score) + _field(3, kind)) for text, score, kind in pieces)
    trainer = _field(3, _BPE) + _field(4, len(pieces)) + _field(40, len(pieces) - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return model + _field(2, trainer) + _field(3, normaliser)


@cache
def newer_characters() -> str:
    """Characters, as ranges of a class, that this machine's patterns know and the tiktoken library's Unicode tables do not yet, or the reverse."""
    import tiktoken

    texts = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    known = tiktoken.Encoding("assigned", pat_str=r"\P{Cn}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    theirs = set(bytes(known.encode_ordinary(texts)).decode())
    differ = sorted(map(ord, theirs ^ set(regex.findall(r"\P{Cn}", texts))))
    out, first = [], 0
    for n, c in enumerate(differ):
        if n + 1 == len(differ) or differ[n + 1] != c + 1:
            out.append(f"\\U{differ[first]:08x}-\\U{c:08x}")
            first = n + 1
    return "".join(out)


def stretches(text: str) -> list[str]:
    """The text in pieces, cut before each blank or newline that follows no other white space. Texts that hold CUT are not cut.

    No match of the common patterns of pre-tokens goes on from a character into white space.
    """
    if CUT in text:
        return [text]
    cut = text.replace(" ", CUT + " ").replace("\n", CUT + "\n")
    if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or _ODD_BLANK.search(text):
        cut = _BLANK_CUT.sub(r"\1", cut)
    return cut.removeprefix(CUT).split(CUT)


class ByteEncoder:
    """Encodes texts with a vocabulary and the pattern of its pre-tokens.

    With CUTTABLE, texts are cut to stretches first; the ids of short stretches (pre-tokens, with any other pattern) are kept, KEPT_WORDS at most.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, newer: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(ranks))
        self.ranks = ranks
        self.ids = array("i", sorted(ranks.values()))
        self.pattern = regex.compile(pattern)
        self.cut = stretches if pattern == CUTTABLE else self.words
        self.newer = regex.compile(f"[{newer or UNASSIGNED}]")
        self.first_newer = min(re.findall(r"[^-]", newer.encode().decode("unicode_escape")), default=UNASSIGNED)
        self.letters = dict(enumerate(byte_characters()))
        self.kept: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The pre-tokens: matches of the pattern, with characters of newer Unicode tables as if unassigned."""
        shown = text if text.isascii() or max(text) < self.first_newer else self.newer.sub(UNASSIGNED, text)
        if shown == text and not self.pattern.groups:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(shown)]

    def _encoded(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of each part as little-endian 32-bit integers."""
        words = list(map(self.words, parts))
        known = {w: array("i", [rank]).tobytes() for w in set().union(*words) if (rank := self.ranks.get(w.encode("utf-8", "replace"))) is not None}
        rest = list(set().union(*words).difference(known))
        pieces = self.model.encode([w.encode("utf-8", "replace").decode("latin-1").translate(self.letters) for w in rest], num_threads=1)
        known.update(zip(rest, (array("i", map(self.ids.__getitem__, p)).tobytes() for p in pieces), strict=True))
        return {part: b"".join(map(known.__getitem__, own)) for part, own in zip(parts, words, strict=True)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.cut(t) if t else [] for t in texts]
        used = set().union(*cut)
        if len(self.kept) > KEPT_WORDS:  # those in use again stay
            self.kept = {part: self.kept[part] for part in used if part in self.kept}
        new = self._encoded(list(used.difference(self.kept)))
        self.kept.update(new)
        out = [b"".join(map(self.kept.__getitem__, parts)) for parts in cut]
        for part in new:
            if len(part) > LONG:
                del self.kept[part]
        return out


def surfaces(ranks: dict[bytes, int]) -> dict[int, bytes]:
    """Id -> bytes, by the inverse mapping of the model's pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=serialised(ranks))
    back = {ord(c): b for b, c in enumerate(byte_characters())}
    return {rank: model.id_to_piece(n).translate(back).encode("latin-1") for n, rank in enumerate(sorted(ranks.values()))}


_encoders: dict[tuple[str, str], ByteEncoder] = {}
_surfaces: dict[str, dict[int, bytes]] = {}


def _replaced(docs: DataFrame, old: str, new: str, kind: DataType, convert) -> DataFrame:
    """docs with a column new of convert(column old) in place of both, last."""
    kept = [c for c in docs.columns if c not in (old, new)]
    schema = StructType([*(StructField(c, docs.schema[c].dataType) for c in kept), StructField(new, kind)])
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            columns = [b.column(n) for n in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, convert(b.column(len(kept)))], [*kept, new])

    # mapInArrow looks its input's columns up by name, where a dot would part a name
    return docs.select(*(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(kept)), old).mapInArrow(run, schema)


def encode_texts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """docs (text, ...) with ids array<int> in place of text, by the tokens and ranks of a file and the pattern of its pre-tokens.

    Whole texts are encoded, one by one and without special tokens; null and empty ones have no ids. Repeated rows and all other columns stay
    as they are, but a column called ids is replaced. An empty table gives an empty table.
    """
    newer = newer_characters()

    def convert(texts: pa.Array) -> pa.Array:
        if (ranks, pattern) not in _encoders:
            _encoders[ranks, pattern] = ByteEncoder(read_ranks(ranks), pattern, newer)
        own = _encoders[ranks, pattern].encode(texts.to_pylist())
        ends = np.cumsum([0, *(len(x) // 4 for x in own)], dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(own), "<i4")))

    return _replaced(docs, "text", "ids", ArrayType(IntegerType()), convert)


def decode_ids(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded (ids, ...) with decoded binary in place of ids: the tokens' bytes, joined. Null ids give null, an id without a token fails the job."""

    def convert(rows: pa.Array) -> pa.Array:
        if ranks not in _surfaces:
            _surfaces[ranks] = surfaces(read_ranks(ranks))
        surface = _surfaces[ranks].__getitem__
        own = (None if not ids.is_valid else b"".join(map(surface, ids.values.to_numpy().tolist())) for ids in rows)
        return pa.array(list(own), pa.binary())

    return _replaced(encoded, "ids", "decoded", BinaryType(), convert)
