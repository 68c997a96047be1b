"""Reports over score rows (U2-U6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import PARAMS
from .order import rank_by_ranges

DASH = "—"


def brands_per_file(df: DataFrame) -> DataFrame:
    return df.groupBy("filename").agg(F.count("*").alias("brands"))


def rank_in_file(df: DataFrame, order_col: str = "pos") -> DataFrame:
    """Adds rank: by score within a file, the best first; ties by detection place, then brand. One file may hold all rows."""
    score = F.col("access_score").cast("int").desc_nulls_last()
    return rank_by_ranges(df, ["filename"], [score, F.col(order_col), F.col("brand")], "rank")


def report_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("brand_rows"), F.countDistinct("filename").alias("files"))


def parameters_long(df: DataFrame) -> DataFrame:
    """One row for each parameter, in report order; null and empty become NA."""
    cells = [F.struct(F.lit(i).alias("position"), F.lit(p).alias("parameter"), F.col(f"`{p}`").alias("v")) for i, p in enumerate(PARAMS)]
    out = df.select("filename", "brand", F.inline(F.array(*cells)))
    return out.select("filename", "brand", "position", "parameter", F.when(F.coalesce("v", F.lit("")) == "", "NA").otherwise(F.col("v")).alias("value"))


def headline_fields(df: DataFrame) -> DataFrame:
    """The four fields of a report card; months carry their unit."""
    show = lambda p: F.coalesce(F.col(f"`{p}`"), F.lit(DASH))
    months = show("Initial Authorization Duration(in-months)")
    return df.select(
        "filename",
        "brand",
        show("Number of Steps through Brands").alias("brand_steps"),
        F.when(months.isin(DASH, "NA"), months).otherwise(F.concat(months, F.lit(" mo"))).alias("initial_auth"),
        show("TB Test required").alias("tb_test"),
        show("Reauthorization Required").alias("reauth"),
    )
