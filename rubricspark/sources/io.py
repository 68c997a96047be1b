"""Sources and sinks (S1, S2, S6-S10)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import with_doc_name
from ..params import CSV_COLUMNS
from .shared import path_exists, stored

BUCKETS = 64


def write_texts(texts: DataFrame, folder: str, name_col: str = "filename", text_col: str = "markdown") -> DataFrame:
    """Each row as a file of that name; returns path and length of what was written, once it is.

    Files go to the folder's own store from the tasks (any URI that pyarrow opens). A file is written under a hidden name and
    then moved, so a task that runs again replaces it and a reader never sees half of one. Names are to be distinct; a null text is
    an empty file.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for name, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                raw, hidden = (text or "").encode(), f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as f:
                    f.write(raw)
                store.move(hidden, f"{root}/{name}")
                paths.append(f"{folder}/{name}")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])

    return stored(texts.select(name_col, text_col).mapInArrow(put, "path string, length long"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, length of the .pdf files (any case) of a folder; an error if there is none.

    Other files are left out while the folder is listed, and no file is opened: the content is not selected.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "length")
    if files.isEmpty():
        raise ValueError(f"no PDF file in {path}")
    return with_doc_name(files).select("path", "filename", "length")


def read_markdown(spark: SparkSession, path: str, stems: list[str] | None = None) -> DataFrame:
    """stem, filename, markdown, size: one row for each .md file of a folder; only those of ``stems`` if given.

    The condition is on the file's metadata, so other files are not read. An empty file has no row.
    """
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    if stems is not None:
        texts = texts.filter(F.col("_metadata.file_name").isin([f"{s}.md" for s in stems]))
    texts = texts.select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("size"))
    return with_doc_name(texts, "name").select("stem", "filename", F.col("value").alias("markdown"), "size")


def bucket_of(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(BUCKETS)).cast("int")


def read_store(spark: SparkSession, path: str, buckets: list[int] | None = None, schema: T.StructType | None = None) -> DataFrame | None:
    """What a store holds, only some of its buckets if they are named; None if there is none yet."""
    if not path_exists(spark, path):
        return None
    out = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    return out if buckets is None else out.filter(F.col("bucket").isin(buckets))


def append_new(rows: DataFrame, path: str, batch: str, keys: list[str], id_col: str = "doc_id") -> DataFrame:
    """Adds rows whose keys the store does not hold yet, under the name of this batch; returns them as stored.

    The store is Parquet in folders by bucket (a hash of the id) and batch. Only buckets that these rows touch are
    read: their numbers, ``BUCKETS`` at most, are known before the store is planned. A batch overwrites its own folders in those
    buckets and looks past them, so running it again changes nothing, nor does adding known rows under another name.
    Within ``rows`` one of equal keys stays.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("bucket", bucket_of(id_col))
    touched = sorted(r.bucket for r in keyed.select("bucket").distinct().collect())
    schema = T.StructType([*keyed.schema.fields, T.StructField("batch", T.StringType())])
    held = read_store(spark, path, touched, schema)
    keyed = keyed.withColumn("_held", F.lit(False))
    if held is not None:
        held = held.filter(F.col("batch") != batch).select("bucket", *keys, F.lit(True).alias("_held"))
        keyed = keyed.unionByName(held, allowMissingColumns=True)
    # rows are dealt by bucket once: equal keys, those that are held, and the files of a bucket meet there
    first = F.row_number().over(Window.partitionBy("bucket", *keys).orderBy(F.desc("_held")))
    fresh = keyed.repartition("bucket").withColumn("_n", first).filter("_n = 1 AND NOT _held").drop("_n", "_held").withColumn("batch", F.lit(batch))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
    out = read_store(spark, path, touched, schema)
    return out.filter(F.col("batch") == batch)


def append_documents(docs: DataFrame, path: str, batch: str) -> DataFrame:
    """Documents that are not stored yet, by doc_id."""
    return append_new(docs, path, batch, ["doc_id"])


def flat_chunks(chunks: DataFrame) -> DataFrame:
    """The stored form of chunks: columns joined by a bar, booleans as True and False."""
    return chunks.select(
        "doc_id",
        "chunk_id",
        "text",
        F.concat_ws("|", "columns").alias("columns"),
        F.initcap(F.col("metadata.table").cast("string")).alias("table"),
        F.col("metadata.pdf").alias("pdf"),
        F.col("metadata.header").alias("header"),
    )


def append_chunks(chunks: DataFrame, path: str, batch: str) -> DataFrame:
    """Chunks that are not stored yet, in their stored form, by document and chunk."""
    return append_new(flat_chunks(chunks), path, batch, ["doc_id", "chunk_id"])


def report_columns(df: DataFrame) -> DataFrame:
    """The columns of a report in their order, all text."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in CSV_COLUMNS])


def write_scores_csv(df: DataFrame, path: str) -> None:
    report_columns(df).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def write_scores_json(df: DataFrame, path: str) -> None:
    report_columns(df).write.mode("overwrite").json(path)


def split_failures(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) by the column error: a file with any error gives no rows, and one error row."""
    errors = df.filter("error IS NOT NULL").groupBy("filename").agg(F.min("error").alias("error"))
    return df.join(errors.select("filename"), "filename", "left_anti").drop("error"), errors


def run_summary(manifest: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """For each run_id: total files, processed ones (with rows or an error), rows, and the errors by file."""
    files = manifest.groupBy("run_id").agg(F.countDistinct("filename").alias("total"))
    rows = results.groupBy("run_id").agg(F.count("*").alias("result_count"))
    bad = errors.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("filename", "error"))).alias("errors"))
    seen = results.select("run_id", "filename").unionByName(errors.select("run_id", "filename")).groupBy("run_id").agg(F.countDistinct("filename").alias("processed"))
    out = files.join(seen, "run_id", "left").join(rows, "run_id", "left").join(bad, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    none = F.array().cast("array<struct<filename:string,error:string>>")
    return out.select("run_id", "total", zero("processed"), zero("result_count"), F.coalesce("errors", none).alias("errors"))
