"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .align import align_tokenizers
from .bpe import bpe_decode, bpe_encode, ids_digest
from .common import held_out, read_table, spread
from .ego import OP10_SQL, epsilon_join
from .langid import fit_languages, identify_language, learnable
from .lines import OP1_SQL, dedup_lines
from .mix import mix_sources, taken_words
from .pii import find_personal_data, fit_tagger
from .quality import apply_rules, fit_quality
from .shard import shard_documents
from .simhash import simhash_components
from .suffix import remove_repeats
from .toxicity import fit_toxicity, score_toxicity
from .trie import OP11_SQL, conversation_trie

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BPE_JSON, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 24


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without boilerplate lines. Nulls, empty texts and repeated rows as in ``dedup_lines``; one row a row. An empty table gives an empty one."""
    return dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and bytes of every whole text as digests. A null or an empty text has 0 ids; no row is dropped, repeats stay. An empty table gives an empty one."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe_encode(docs, BPE_RANKS, public_tokenizers.PATTERN).drop("text")
    both = bpe_decode(encoded, BPE_RANKS)
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("token_ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document. A null doc_id is scored, never learned from, and its held_out is null. An empty table gives an empty one."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    found = score_toxicity(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every document, ``und`` without a letter. A null doc_id is scored; nothing is learned from null labels. An empty table gives an empty one."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(learnable(docs))
    found = identify_language(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null and empty texts have fingerprint zero; equal texts one component. An empty table gives an empty one."""
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document. Null and empty texts have size 0 and none taken; equal rows are documents of their own. An empty table gives an empty one."""
    return taken_words(mix_sources(read_table(spark, sf_dir, "documents")))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document, those of the fixed patterns counted. Null and empty texts have none; no row is dropped. An empty table gives an empty one."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(spread(docs), fit_tagger(docs), ["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_secret", "n_added")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document. Null and empty texts have no words and fail; equal texts have equal rows. An empty table gives an empty one."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")), ["doc_id"])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document. Null and empty texts have 0 bytes; rows with a null doc_id or one doc_id as in ``remove_repeats``. An empty table gives an empty one."""
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector. Null, zero and non-finite vectors link with nothing; equal vectors are copies. An empty table gives an empty one."""
    return epsilon_join(read_table(spark, sf_dir, "embeddings"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each prefix of the rebuilt conversations. Null turns come first, ties go by role and text, rows without conv_id belong to none. An empty table gives an empty one."""
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers in every whole text. Null and empty texts have zeros and ''; repeats count as often as they are. An empty table gives an empty one."""
    return align_tokenizers(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), BPE_JSON, PIECES)


def op13_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by the law ``rows``. Nulls, empty texts and equal rows are rows like others. An empty table gives an empty one."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs, SHARDS).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_mix_sources": op6_mix_sources,
    "op7_personal_data": op7_personal_data,
    "op8_quality_rules": op8_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_embedding_join": op10_embedding_join,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_align_tokenizers": op12_align_tokenizers,
    "op13_shard_ring": op13_shard_ring,
}

SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op10_embedding_join": OP10_SQL, "op11_conversation_trie": OP11_SQL}
