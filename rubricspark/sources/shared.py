"""Tables and folders in the place that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables that this driver has written and not deleted.
_STORED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, or below a temporary one where that is unset (tests on one machine)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/jobs/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read back: its lineage ends there, and every reader sees the same rows in the same files."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    _STORED.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def drop_stored(spark: SparkSession) -> int:
    """Deletes all tables that ``stored`` has written. For the end of a job, when its results are kept elsewhere."""
    gone = list(_STORED)
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _STORED.discard(path)
    return len(gone)
