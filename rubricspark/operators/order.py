"""Ranks within keys of any size: a sample sort in place of one window a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def rank_by_ranges(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: the row's number from 1 within its keys, in that order.

    Rows are dealt by sampled ranges of (keys, order), numbered within their range, and a range's numbers begin where
    the earlier ranges of the same keys end. So one key with all rows is spread over all tasks. The dealt rows are stored, because ranges
    that are sampled anew may differ. ``order`` should tell rows apart; rows that it does not share a task, in open order.
    """
    part, local, base = (f"_{n}_of_{out}" for n in ("part", "local", "base"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order).withColumn(part, F.spark_partition_id())
    within = Window.partitionBy(*keys, part)
    dealt = stored(dealt.withColumn(local, F.row_number().over(within.orderBy(*order))))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(*keys, part).agg(F.max(local).alias(base)).withColumn(base, F.coalesce(F.sum(base).over(earlier), F.lit(0)))
    same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in [*keys, part]]
    joined = dealt.alias("l").join(bases.alias("r"), same)
    return joined.select("l.*", (F.col(f"l.{local}") + F.col(f"r.{base}")).cast("int").alias(out)).drop(part, local)
