"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, as a byte or character class.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune_for_texts(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune_for_texts(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of long texts is small, unless the session has a size of its own.

    Only the registered queries and the pipeline call this, for their own session; operators leave settings alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, "512")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with underscores until no column of ``df`` (letter case aside) has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none (tests on one machine) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The table stays until ``discard`` or ``drop_tables``: what was made from it may be read later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[path] = True
    out._table_path = path
    return out


#: Paths of the tables that this driver has written and not discarded.
_TABLES: dict[str, bool] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _TABLES.pop(path, None)


def discard(table: DataFrame) -> None:
    """Delete a materialized table that nothing will read again."""
    if path := getattr(table, "_table_path", None):
        _delete(table.sparkSession, path)


def drop_tables(spark: SparkSession) -> int:
    """Delete all tables that operators have written. For the end of a job, when its results are stored."""
    paths = list(_TABLES)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def spread(table: DataFrame) -> DataFrame:
    """A scanned table's rows dealt evenly, where it comes in fewer partitions than there are cores.

    For work on single rows that costs far more than moving them; a table of many files stays as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the rows that no model learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def running_offset(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, per_group: int = 256) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same keys that come before this one.

    Rows are dealt by hash into groups of about ``per_group`` and summed within each; the totals of groups are summed in
    the same way, ``per_group`` at a time, until few are left. No task gets more of a hot key than one level's groups.
    """
    group, within, base = free_names(df, "_group", "_within", "_base")
    # the hash is salted so that groups do not line up with the shuffle's own hash of the same columns
    groups = max(16, -(-df.count() // per_group))
    df = df.withColumn(group, F.pmod(F.xxhash64(F.lit("offset"), *order), F.lit(groups)))
    totals = df.groupBy(*keys, group).agg(F.sum(value).alias(base))
    totals = _bases(totals, keys, group, base, groups, per_group)
    inner = Window.partitionBy(*keys, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = df.withColumn(within, F.coalesce(F.sum(value).over(inner), F.lit(0))).alias("l")
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, group]]
    joined = left.join(totals.alias("r"), cond)
    return joined.select("l.*", (F.col(f"l.{within}") + F.col(f"r.{base}")).alias(out)).drop(group, within)


def _bases(totals: DataFrame, keys: list[str], group: str, base: str, groups: int, fan: int) -> DataFrame:
    """Totals of groups 0..groups-1 of each key to the sum over the groups before."""
    if groups <= 16 * fan:
        before = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
        return totals.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    up, own = free_names(totals, "_up", "_own")
    totals = totals.withColumn(up, F.expr(f"{group} div {fan}"))
    above = _bases(totals.groupBy(*keys, up).agg(F.sum(base).alias(base)), keys, up, base, -(-groups // fan), fan)
    before = Window.partitionBy(*keys, up).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    left = totals.withColumn(own, F.coalesce(F.sum(base).over(before), F.lit(0))).alias("l")
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, up]]
    names = [*keys, group]
    return left.join(above.alias("r"), cond).select(*[F.col(f"l.{c}") for c in names], (F.col(f"l.{own}") + F.col(f"r.{base}")).alias(base))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
