"""From raw documents to token ids: five stages, each over all that its predecessor kept.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``, whatever else they hold
besides doc_id, text, source, lang and n_chars, and under any name. Every stage takes nulls in any column, texts of any
length and repeated rows, and makes an empty table of an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricspark.llm.bpe import bpe_decode, bpe_encode
from rubricspark.llm.common import materialize, read_table, tune_for_texts
from rubricspark.llm.langid import language_filter
from rubricspark.llm.lines import dedup_lines
from rubricspark.llm.mix import mix_sources, mixed_documents
from rubricspark.llm.queries import BPE_RANKS
from rubricspark.llm.simhash import keep_one


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language that was learned go: null and empty texts, texts without letters, and what no model predicts.

    Where nothing can be learned (no row with text and lang) every document stays. Repeated rows fare alike.
    """
    tune_for_texts(spark)
    return language_filter(spark, docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share go, but for their first occurrence; every document stays, a null text as it is."""
    return dedup_lines(docs).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest doc_id stays, once; rows with a null doc_id all stay."""
    return keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document has a row for each of its passes, with the words that the mix takes.

    Documents without words go; equal rows are documents of their own, a null source is a source.
    """
    return mixed_documents(docs, mix_sources(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (none of a null or an empty one), and whether they decode to it; no row is dropped."""
    both = bpe_decode(bpe_encode(docs, BPE_RANKS, public_tokenizers.PATTERN), BPE_RANKS)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return both.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("simhash", one_of_each_group),
    ("mix_sources", mixed),
    ("byte_bpe", tokens),
]

#: Fingerprint links and language models are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
