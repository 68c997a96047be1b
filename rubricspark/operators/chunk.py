"""Chunking (K1-K9): one row a document to many rows a document, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.splitting import chunk_text
from ..params import CHUNK_OVERLAP, CHUNK_SIZE

#: Chunks handed back to Spark at once, but for one document's last ones.
BATCH_ROWS = 4096
CHUNKS = "doc_id long, chunk_seq int, chunk_id string, text string, columns array<string>, metadata struct<table:boolean,pdf:string,header:string>"


NAMES = ["doc_id", "chunk_seq", "chunk_id", "text", "columns", "metadata"]


def chunk_rows(doc_id: int, filename: str | None, markdown: str) -> list[tuple]:
    """A text's chunks as rows; without a file's name the id stands for it in the chunks' ids."""
    stem = f"{doc_id}" if filename is None else filename.rsplit("/", 1)[-1].removesuffix(".pdf")
    return [(doc_id, i, f"{stem}_{i:04d}", c, cols, {"table": t, "pdf": filename, "header": h}) for i, (c, t, cols, h) in enumerate(chunk_text(markdown))]


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Chunks of ``docs`` (doc_id, filename, markdown); a null text has none. Texts are cut in Arrow batches."""

    names = NAMES

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, filename, markdown in batch.itertuples(index=False):
                if not markdown:
                    continue
                rows += chunk_rows(doc_id, filename, markdown)
                if len(rows) >= BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", "filename", "markdown").mapInPandas(cut, CHUNKS)


class ChunkPolicy:
    """The chunks of one document, as a table function of a row."""

    def eval(self, doc_id: int, filename: str | None, markdown: str | None) -> Iterator[tuple]:
        if markdown:
            yield from chunk_rows(doc_id, filename, markdown)


class ChunkPolicies:
    """The chunks of a table's documents, batch by batch, as a table function of a table."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        texts = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "filename", "markdown")), strict=True)
        rows = [r for d, name, text in texts if text for r in chunk_rows(d, name, text)]
        yield pa.Table.from_pylist([dict(zip(NAMES, r, strict=True)) for r in rows], schema=_ARROW_CHUNKS)


_ARROW_CHUNKS = pa.schema(
    [("doc_id", pa.int64()), ("chunk_seq", pa.int32()), ("chunk_id", pa.string()), ("text", pa.string()), ("columns", pa.list_(pa.string()))]
    + [("metadata", pa.struct([("table", pa.bool_()), ("pdf", pa.string()), ("header", pa.string())]))]
)


def register_chunker(spark: SparkSession, name: str = "chunk_policy") -> None:
    """Makes the chunker a function of SQL: ``FROM docs AS d, LATERAL chunk_policy(d.doc_id, d.filename, d.markdown)``.

    Rows travel as Arrow batches. A lateral join takes no function that is Arrow's own; see ``register_table_chunker``.
    """
    spark.udtf.register(name, F.udtf(ChunkPolicy, returnType=CHUNKS, useArrow=True))


def register_table_chunker(spark: SparkSession, name: str = "chunk_policies") -> None:
    """The chunker over Arrow batches of a whole table: ``FROM chunk_policies(TABLE(SELECT doc_id, filename, markdown FROM docs))``.

    Rows stay in their partitions.
    """
    spark.udtf.register(name, F.arrow_udtf(ChunkPolicies, returnType=CHUNKS))


def char_windows(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """doc_id, start, piece: windows of characters; blank ones are dropped."""
    step = max(1, size - overlap)
    starts = F.explode(F.sequence(F.lit(0), F.length("markdown") - 1, F.lit(step))).alias("start")
    out = docs.filter(F.length("markdown") > 0).select("doc_id", "markdown", starts)
    return out.select("doc_id", "start", F.substring("markdown", F.col("start") + 1, F.lit(size)).alias("piece")).filter(F.trim("piece", F.lit(" \t\n\r\x0b\x0c")) != "")


def table_columns(c: Column) -> Column:
    """The cells of a table's first line, trimmed, without empty ones."""
    first = F.get(F.split(F.trim(c, F.lit(" \t\n\r")), "\n"), F.lit(0))
    return F.filter(F.transform(F.split(first, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def assign_chunk_ids(df: DataFrame, order_col: str) -> DataFrame:
    """Adds chunk_seq, from 0 in each document, and chunk_id; needs doc_id and filename."""
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy(order_col)) - 1
    out = df.withColumn("chunk_seq", seq)
    return out.withColumn("chunk_id", F.format_string("%s_%04d", F.regexp_replace("filename", r"\.pdf$", ""), "chunk_seq"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))
