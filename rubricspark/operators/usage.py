"""Accounting of model calls (L1-L3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import LIMITS
from .brands import prompt_key


def estimate_tokens(prompts: DataFrame) -> DataFrame:
    """Adds estimate and, with a response, actual: a quarter of the characters of the call's JSON, and the answer's part."""
    c = F.col("content")
    escaped = F.regexp_count(c, F.lit(r'["\\\n\r\t\x08\x0c]'))
    control = F.regexp_count(c, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]")) * 5
    # beyond ASCII a UTF-16 unit is written with six characters
    wide = F.regexp_count(c, F.lit(r"[\x{80}-\x{ffff}]")) * 5 + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10ffff}]")) * 11
    length = F.length(c) + escaped + control + wide + F.lit(len('[{"role": "user", "content": ""}]'))
    out = prompts.withColumn("estimate", (F.floor(length / 4) + F.col("max_tokens")).cast("long"))
    if "response" in prompts.columns:
        out = out.withColumn("actual", (F.floor(length / 4) + F.floor(F.length("response") / 4)).cast("long"))
    return out


#: Microseconds of a cell of time; stretches of the trailing seconds are cut into cells.
CELL = 10_000


def rolling_usage(log: DataFrame, seconds: int = 60, size: str = "70b") -> DataFrame:
    """Requests and tokens of each model over the trailing seconds, both ends included, and whether limits are met.

    Rows are added up by moment, moments by cell, cells by stretch (as long as the window). What lies in a window is then
    what its own stretch holds up to the row, and what the stretch before holds from the window's start on: sums within
    a cell, and of whole cells within a stretch. So no group is larger than a cell's moments or a stretch's cells, even if all
    of a model's rows fall into one minute or one moment. A null time is a moment of its own.
    """
    span = seconds * 1_000_000
    rows = log.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    moments = rows.groupBy("model", "_at").agg(F.count("*").alias("_n"), F.sum("tokens").alias("_t"))
    ends = moments.select("model", "_at", F.col("_at").alias("_p"), F.lit(1).alias("_own"), "_n", "_t")
    starts = moments.filter("_at IS NOT NULL").select("model", "_at", (F.col("_at") - span).alias("_p"), F.lit(0).alias("_own"), F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_t"))
    points = ends.unionByName(starts).withColumn("_cell", F.floor(F.col("_p") / CELL))
    # a start comes before the rows of its moment, which lie inside the window
    upto = Window.partitionBy("model", "_cell").orderBy("_p", "_own").rowsBetween(Window.unboundedPreceding, 0)
    cells = points.groupBy("model", "_cell").agg(F.sum("_n").alias("_cn"), F.sum("_t").alias("_ct")).withColumn("_stretch", F.floor(F.col("_cell") * CELL / span))
    whole = Window.partitionBy("model", "_stretch")
    before = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    cells = cells.select("model", "_cell", *[x for c in ("_cn", "_ct") for x in (zero(F.sum(c).over(before)).alias(f"{c}_before"), F.sum(c).over(whole).alias(f"{c}_whole"))])
    points = points.withColumns({"_in": F.sum("_n").over(upto), "_it": F.sum("_t").over(upto)})
    placed = points.alias("p").join(cells.alias("c"), F.col("p.model").eqNullSafe(F.col("c.model")) & F.col("p._cell").eqNullSafe(F.col("c._cell")))
    part = lambda c, i: F.when(F.col("_own") == 1, F.col(f"{c}_before") + F.col(i)).otherwise(F.col(f"{c}_whole") - F.col(f"{c}_before") - F.col(i))
    used = placed.groupBy(F.col("p.model").alias("model"), F.col("p._at").alias("_at")).agg(F.sum(part("_cn", "_in")).alias("requests"), F.sum(part("_ct", "_it")).alias("used"))
    out = rows.alias("l").join(used.alias("r"), F.col("l.model").eqNullSafe(F.col("r.model")) & F.col("l._at").eqNullSafe(F.col("r._at")))
    rpm, tpm = LIMITS[size]
    return out.select("l.*", "r.requests", "r.used").drop("_at").withColumn("over_limit", (F.col("requests") > rpm - 1) | (F.col("used") > int(0.95 * tpm)))


def prompt_reuse(prompts: DataFrame) -> DataFrame:
    key = prompt_key(F.col("content"), F.col("model"))
    out = prompts.groupBy("model").agg(F.count("*").alias("calls"), F.countDistinct(key).alias("distinct_calls"))
    return out.withColumn("saved", F.col("calls") - F.col("distinct_calls"))
