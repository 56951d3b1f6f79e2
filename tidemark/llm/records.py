"""Token ids in length-delimited binary records, with an offset index beside them.

A record is: length of the payload (8 bytes, little-endian), masked checksum of these 8 bytes (4), payload, masked checksum of the
payload (4). The payload is a document's ids as little-endian unsigned integers, 2 bytes each where the vocabulary allows it (the array module's byte order is the machine's; records are written on little-endian machines). The mask
rotates the CRC-32 right by 15 bits and adds a constant, so that checksums of data that hold checksums stay distinct. The index is a
Parquet table with a row for each record: file, offset, length, and the ids that come before it in its file; only files it names count,
so what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path, shuffle_partitions, small_batches

MASK_DELTA = 0xA282EAD8
KEPT_WORDS, LONG = 1_000_000, 40
#: Stretches in which a change between letter and mark ends a pre-token. Apostrophes and angle brackets are left to the tokenizer.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?%&$#*|()+=/-"
PLAIN = re.compile("[a-z]+")
#: The pre-tokens of a tokenizer whose stretches between blanks can be encoded one by one (a fixed value of its file).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE, RUNS = re.compile(f"[{_LETTER}{_MARK}]+"), re.compile(f"[{_LETTER}]+|[{_MARK}]+")
INDEX = "doc_id long, file string, file_no int, offset long, length long, id_bytes int, before long, n_tokens long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(record: bytes) -> bytes:
    """The payload; ValueError if a checksum or length is wrong."""
    if len(record) < 16:
        raise ValueError("record is cut short")
    (size,), (head_crc,) = struct.unpack_from("<Q", record), struct.unpack_from("<I", record, 8)
    if masked_crc(record[:8]) != head_crc or len(record) != size + 16:
        raise ValueError("record's length is damaged")
    payload = record[12:-4]
    if masked_crc(payload) != struct.unpack_from("<I", record, 12 + size)[0]:
        raise ValueError("record's data are damaged")
    return payload


class WordEncoder(dict):
    """Stretch of a text between blanks -> its ids' bytes, for a tokenizer whose pre-tokenizer drops blanks and never joins what they part.

    The tokenizer's file tells whether it is such a one; texts go whole to any other.
    Stretches of Latin letters and marks are looked up by their runs of either, in lower case, which are pre-tokens of this tokenizer; a
    run of plain letters goes to its model at once. Any other stretch passes through the whole tokenizer. KEPT_WORDS of them are kept.
    """

    def __init__(self, path: str, id_bytes: int):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = {2: "H", 4: "I"}[id_bytes]
        parts = json.loads(self.tokenizer.to_str())
        norm, pre = ((parts.get(k) or {}).get(m) or [] for k, m in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        self.by_stretch = [x["type"] for x in norm] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and parts["model"]["type"] == "BPE"
        self.by_stretch = self.by_stretch and pre[0]["pattern"] == {"Regex": PRE_TOKENS} and pre[0]["invert"] and pre[0]["behavior"] == "Removed" and not pre[1]["add_prefix_space"]

    def __missing__(self, word: str) -> bytes:
        if len(self) > KEPT_WORDS:
            self.clear()
        if SIMPLE.fullmatch(word) and (runs := RUNS.findall(word.lower())) != [word]:
            ids = b"".join([self[r] for r in runs])
        elif PLAIN.fullmatch(word):
            ids = array(self.kind, [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()
        else:
            ids = array(self.kind, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONG:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_stretch:
            return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, id_bytes: int) -> WordEncoder:
    if (path, id_bytes) not in _encoders:
        _encoders[path, id_bytes] = WordEncoder(path, id_bytes)
    return _encoders[path, id_bytes]


def write_records(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, id_bytes: int = 2) -> DataFrame:
    """Encode docs (doc_id, text, ...) and write them under path in ascending doc_id order; the offset index is returned as a table.

    Null texts count as empty; each document ends with end_id. Null ids come first, repeated ids in the order of their texts. Rows are
    dealt over files by ranges of doc_id; file numbers follow the order. An empty table writes no file and an empty index.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    end = end_id.to_bytes(id_bytes, "little")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, out, offset, before = f"ids-{part:05d}-{uuid.uuid4().hex}.rec", None, 0, 0
        fs, base = pa.fs.FileSystem.from_uri(path)
        enc = encoder(tokenizer, id_bytes)
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}")
            rows = []
            for text in b.column(1).to_pylist():
                payload = enc.encode(text or "") + end
                record = frame(payload)
                out.write(record)
                n_ids = len(payload) // id_bytes
                rows.append((offset, len(record), before, n_ids))
                offset, before = offset + len(record), before + n_ids
            offsets, lengths, befores, sizes = map(pa.array, np.array(rows, np.int64).T)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * n), pa.array(np.full(n, part, np.int32)), offsets, lengths, pa.array(np.full(n, id_bytes, np.int32)), befores, sizes], ["doc_id", "file", "file_no", "offset", "length", "id_bytes", "before", "n_tokens"])
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shuffle_partitions(spark), "doc_id", F.xxhash64("text"))
    index = rows.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(run, INDEX)
    index.write.parquet(f"{path}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_records(index: DataFrame, path: str) -> DataFrame:
    """(doc_id, file_no, before, n_tokens, ids_crc32) read back from the records that index names; damaged ones fail the job."""

    def run(batches):
        fs, base = pa.fs.FileSystem.from_uri(path)
        file, name = None, None
        for b in batches:
            rows = b.to_pydict()
            sizes, crcs = [], []
            for n, offset, length, id_bytes in zip(rows["file"], rows["offset"], rows["length"], rows["id_bytes"], strict=True):
                if n != name:
                    if file is not None:
                        file.close()
                    file, name = fs.open_input_file(f"{base}/{n}"), n
                file.seek(offset)
                ids = np.frombuffer(unframe(file.read(length)), np.dtype(f"<u{id_bytes}"))
                sizes.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("file_no"), b.column("before"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "file_no", "before", "n_tokens", "ids_crc32"])
        if file is not None:
            file.close()

    return index.mapInArrow(run, "doc_id long, file_no int, before long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write docs as records and read them back: (doc_id, start, n_tokens, ids_crc32).

    start counts the ids of all documents before, over all files: their sums, one for each file, come to the driver, the rest stays in the
    index. Nulls, repeated ids and empty tables: see write_records.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "records")
    index = write_records(docs, tokenizer, path)
    sizes = sorted(tuple(r) for r in index.groupBy("file_no").agg(F.sum("n_tokens")).collect())  # a row for each file
    starts, total = {}, 0
    for file_no, n in sizes:
        starts[file_no], total = total, total + n
    first = spark.createDataFrame(list(starts.items()) or [(0, 0)], "file_no int, first long")
    back = read_records(index, path).join(F.broadcast(first), "file_no")
    return back.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
