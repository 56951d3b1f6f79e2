"""The operators' queries over whole tables, with production parameters; ORACLE_SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.alignment import align, link_counts, link_scores
from tidemark.llm.bytebpe import decode_ids, encode_texts
from tidemark.llm.common import table
from tidemark.llm.crosspolytope import near_vectors
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.langid import language_id
from tidemark.llm.linededup import dedup_lines
from tidemark.llm.nbsvm import quality
from tidemark.llm.preference import format_pairs, swapped_pairs
from tidemark.llm.records import token_records
from tidemark.llm.sentencepiece_fst import encode_documents
from tidemark.llm.sharding import shard
from tidemark.llm.simhash import simhash_dedup
from tidemark.llm.vectorcodes import compress, label_errors


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_pairs(swapped_pairs(table(spark, sf_dir, "conversations")))
    spans = [F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c) for c in ("chosen_mask", "rejected_mask")]
    return out.select("pair_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen", "rejected", *spans)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    scores = link_scores(aligned, link_counts(aligned))
    numbers = [F.col(c).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")]
    own = aligned.select("row", "doc_id", *numbers, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))
    linked = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return own.join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *linked, "groups_sha256")


def op12_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def op13_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    out = decode_ids(encoded.withColumn("again", F.col("ids")), ranks)
    ids = F.array_join(F.col("again").cast("array<string>"), " ")
    return out.select("doc_id", F.size("again").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_simhash, op3_preference, op4_langid, op5_embeddings, op6_quality, op7_decontaminate, op8_linededup, op9_sharding, op10_records, op11_alignment, op12_vectorcodes, op13_bytebpe)
}

_TURN = "'<|im_start|>' || {} || chr(10) || {} || '<|im_end|>' || chr(10)"

ORACLE_SQL: dict[str, str] = {
    "op3_preference": f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
    l AS (SELECT conv_id, max(k) AS n FROM t WHERE role = 'assistant' GROUP BY conv_id),
    a AS (SELECT l.conv_id, l.n, t.text FROM l JOIN t ON t.conv_id = l.conv_id AND t.k = l.n),
    p AS (SELECT a.conv_id AS pair_id, a.n, a.text AS own, b.text AS other, b.conv_id IS NOT NULL AS there FROM a LEFT JOIN a b ON b.conv_id = xor(a.conv_id, 1)),
    c AS (SELECT *, CASE WHEN there AND other = own THEN n ELSE n - 1 END AS n_common FROM p),
    s AS (SELECT c.pair_id, string_agg({_TURN.format("t.role", "t.text")}, '' ORDER BY t.k) AS prompt FROM c JOIN t ON t.conv_id = c.pair_id AND t.k <= c.n_common GROUP BY c.pair_id)
    SELECT c.pair_id, n_common, coalesce(prompt, '') AS prompt, CASE WHEN n_common = n THEN '' ELSE {_TURN.format("'assistant'", "own")} END AS chosen, CASE WHEN n_common = n OR NOT there THEN '' ELSE {_TURN.format("'assistant'", "other")} END AS rejected,
    CASE WHEN n_common = n THEN '' ELSE '22-' || (33 + length(own)) END AS chosen_mask, CASE WHEN n_common = n OR NOT there THEN '' ELSE '22-' || (33 + length(other)) END AS rejected_mask
    FROM c LEFT JOIN s ON s.pair_id = c.pair_id"""
}
