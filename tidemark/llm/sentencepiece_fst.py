"""SentencePiece encoding and decoding as weighted finite-state transduction.

Compiled once for a model are three transducers: the normaliser, whose two states tell whether a blank is pending and which writes word marks for
blanks; the pieces, an automaton whose final states emit them; and the byte fallback, an arc from each UTF-8 byte to its piece. An input is composed
with these to a lattice of arcs between places, and the shortest path through it in the tropical semiring is its encoding. A unigram model weighs an
arc by its piece's negative score, the fallback by a penalty. In a BPE model a sequence of pieces is the encoding just if merging any two
neighbours' characters gives these two again, so an arc that follows a piece weighs 0 or infinity by that test.

Where no piece holds a blank's mark after another character, nor a newline, all paths pass through the place before a blank or newline in one
state. Texts are cut there, and the paths of cut stretches are kept.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
KEPT_STRETCHES, KEPT_PAIRS, LONG = 400_000, 400_000, 64
_UNKNOWN_PENALTY = 10.0
#: States of the normaliser: inside a text, after a blank whose mark is pending, at the start where none is.
INSIDE, PENDING, START = range(3)
#: Stands before each blank and newline at which a text is cut; texts that hold it are not cut.
CUT = "\x1f"
_RUN_START = re.compile(f"(?<![ {MARK}])[ {MARK}]")


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    """pieces: (text, score, type) by id."""

    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    dummy_prefix: bool = True
    squeeze_blanks: bool = True
    arcs: ahocorasick.Automaton = field(default_factory=ahocorasick.Automaton)
    scores: dict[str, float] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)
    bytes_: dict[int, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        pieces, kind, dummy, squeeze = [], UNIGRAM, True, True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("a model with a table of character normalisations is not supported")
                dummy, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return cls(pieces, kind, dummy, squeeze).compile()

    def compile(self) -> Model:
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.unknown = next((n for n, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.surface, self.cuts = [], True
        # (state, blank?) -> (what goes before the character or for it, whether the character is written, next state)
        pending = PENDING if self.squeeze_blanks else INSIDE
        self.normaliser = {
            (INSIDE, True): ("" if self.squeeze_blanks else MARK, False, pending), (PENDING, True): ("" if self.squeeze_blanks else MARK * 2, False, pending), (START, True): ("" if self.squeeze_blanks else MARK, False, START if self.squeeze_blanks else INSIDE),
            (INSIDE, False): ("", True, INSIDE), (PENDING, False): (MARK, True, INSIDE), (START, False): ("", True, INSIDE),
        }
        for n, (text, score, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.bytes_[int(text[3:5], 16)] = n
                self.surface.append(bytes([int(text[3:5], 16)]))
            elif kind == NORMAL:
                if "\n" in text or MARK in text.lstrip(MARK):
                    self.cuts = False
                if len(text) > 1:
                    self.arcs.add_word(text, text)
                self.scores[text], self.ids[text] = score, n
                self.surface.append(text.replace(MARK, " ").encode())
            elif kind == USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
            else:
                self.surface.append(" ⁇ ".encode() if kind == UNKNOWN else b"")
        if not len(self.arcs):
            self.arcs.add_word(CUT * 9, CUT * 9)  # an automaton needs a word; this one's arc weighs no less than others over it
        self.arcs.make_automaton()
        self.penalty = -min(self.scores.values(), default=0.0) + _UNKNOWN_PENALTY
        self.pairs: dict[tuple[str, str], float] = {}
        self.paths: dict[str, bytes] = {}
        return self

    # the normaliser

    def start(self) -> int:
        return PENDING if self.dummy_prefix else START

    def normalise(self, text: str, state: int | None = None) -> str:
        """What the normaliser writes for text, read from a state; a mark still pending at the end is not written."""
        if state is None:
            if not text:
                return ""
            state = self.start()
        if state == INSIDE and not self.squeeze_blanks:  # this state is not left, so each character has one image
            return text.replace(" ", MARK)
        out, move = [], self.normaliser
        for run in _RUNS.findall(text):  # an arc is taken by a run of blanks, one by one, or by a run of others, where only the first can change state
            blank = run[0] == " "
            if not blank:
                before, _, state = move[state, False]
                out.append(before + run)
                continue
            for _ in run:
                written, _, state = move[state, True]
                out.append(written)
        return "".join(out)

    # weights

    def _merged(self, text: str) -> list[str]:
        """What merging the best-scored neighbours, leftmost first, leaves of the characters."""
        parts = list(text)
        while len(parts) > 1:
            scored = [(-self.scores[x], n) for n in range(len(parts) - 1) if (x := parts[n] + parts[n + 1]) in self.scores]
            if not scored:
                break
            n = min(scored)[1]
            parts[n : n + 2] = [parts[n] + parts[n + 1]]
        return parts

    def _weight(self, before: str, piece: str) -> float:
        """The weight of an arc over piece after before, which is empty at the start."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        fits = self._merged(before + piece) == ([before, piece] if before else [piece])
        weight = self.pairs[before, piece] = 0.0 if fits else float("inf")
        return weight

    # composition and shortest path

    def path(self, text: str) -> list[str]:
        """Pieces of the shortest path through the composition with normalised text. A place has one best state, so each keeps the piece that ends there."""
        ends = self._bpe_ends(text) if self.kind == BPE else self._unigram_ends(text)
        out: list[str] = []
        at = len(text)
        while at:
            piece = ends[at - 1]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def _unigram_ends(self, text: str) -> list[str]:
        arcs: list[list[str]] = [[] for _ in text]
        for end, piece in self.arcs.iter(text):
            arcs[end].append(piece)
        costs, ends = [0.0], []
        for at, char in enumerate(text):
            total, piece = min(((costs[at + 1 - len(p)] - self.scores.get(p, -self.penalty), p) for p in (*arcs[at], char)), key=lambda x: x[0])
            costs.append(total)
            ends.append(piece)
        return ends

    def _bpe_ends(self, text: str) -> list[str]:
        """Each prefix has one encoding and finite weights are 0, so the distance of every place is 0 and the arc of weight 0 into it is the one on the
        shortest path: where no longer one has it, that over one character, a piece's or the fallback's."""
        ends, done, weights = list(text), -1, self.pairs.get
        for end, piece in self.arcs.iter(text):
            if end != done:
                start = end - len(piece)
                before = ends[start] if start >= 0 else ""
                if (weight := weights((before, piece))) is None:
                    weight = self._weight(before, piece)
                if not weight:
                    ends[end], done = piece, end
        return ends

    def emit(self, pieces: list[str]) -> bytes:
        """Ids of a path as little-endian 32-bit integers; the fallback's arcs read a character's bytes."""
        try:
            return array("i", map(self.ids.__getitem__, pieces)).tobytes()
        except KeyError:  # a character is no piece
            pass
        out: list[int] = []
        for piece in pieces:
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes_:
                out.extend(self.bytes_[b] for b in piece.encode("utf-8", "replace"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def _ids(self, stretch: str) -> bytes:
        """The ids of a stretch, which is read from inside a text."""
        ids = self.emit(self.path(self.normalise(stretch, INSIDE)))
        if len(stretch) <= LONG:
            if len(self.paths) > KEPT_STRETCHES:
                self.paths.clear()
            self.paths[stretch] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        if self.dummy_prefix:
            text = f" {text}"  # after a blank and at the start, the normaliser is in the same state
        # a pending blank before a newline makes two states there
        if not self.cuts or not self.dummy_prefix or CUT in text or self.squeeze_blanks and " \n" in text:
            norm = self.normalise(text, INSIDE if self.dummy_prefix else START)
            return np.frombuffer(self.emit(self.path(norm)), "<i4")
        paths, own = self.paths.get, self._ids
        cut = _RUN_START.sub(rf"{CUT}\g<0>", text) if "  " in text or MARK in text else text.replace(" ", f"{CUT} ")
        return np.frombuffer(b"".join([p if (p := paths(s)) is not None else own(s) for s in cut.replace("\n", f"{CUT}\n").split(CUT)]), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The inverse: pieces' surfaces and raw bytes joined, without the dummy prefix."""
        text = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_RUNS = re.compile(" +|[^ ]+")

_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model.load(path)
    return _models[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id long, ids array<int>, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean) for each row of docs.

    path names a model file that every executor has. ids_crc32 is over the ids as little-endian unsigned 32-bit integers, decoded_crc32
    over the decoded text's UTF-8. round_trip tells whether decoding gives the normalised text back (blanks for word marks). Null texts
    count as empty and give no ids; repeated rows and null ids come back as given; other columns are ignored.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches):
        m = model(path)
        for b in batches:
            ids = [m.encode(t or "") for t in b.column(1).to_pylist()]
            texts = [m.decode(x) for x in ids]
            sizes = np.array([len(x) for x in ids], np.int64)
            start = np.concatenate([[0], np.cumsum(sizes)])
            values = np.concatenate(ids) if ids else np.zeros(0, "<i4")
            back = [t == _plain(m, o or "") for t, o in zip(texts, b.column(1).to_pylist(), strict=True)]
            crcs = [[zlib.crc32(x.tobytes()) for x in ids], [zlib.crc32(t.encode()) for t in texts]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(values)), pa.array(sizes), *(pa.array(c, pa.int64()) for c in crcs), pa.array(back, pa.bool_())],
                ["doc_id", "ids", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"],
            )

    schema = "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _plain(m: Model, text: str) -> str:
    norm = m.normalise(text).replace(MARK, " ")
    return norm[1:] if m.dummy_prefix else norm

