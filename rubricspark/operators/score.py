"""From parameter rows to access scores (P5, P11, P12)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import score_of
from ..params import PARAMS, WEIGHTS


def flatten_params(df: DataFrame) -> DataFrame:
    """(filename, params map<string,string>) to one column a parameter; an absent key is NA, an absent brand empty."""
    out = [F.coalesce(F.col("params")[p], F.lit("NA")).alias(p) for p in PARAMS]
    return df.select("filename", F.coalesce(F.col("params")["brand"], F.lit("")).alias("brand"), *out)


def access_score(df: DataFrame) -> DataFrame:
    """Adds access_score: the weighted sum of exact tenths, rounded half to even."""
    total = reduce(add, [F.lit(w) * score_of(p) for p, w in WEIGHTS.items()])
    return df.withColumn("access_score", F.bround(total.cast("decimal(6,1)"), 0).cast("int"))


def score_breakdown(df: DataFrame) -> DataFrame:
    """One row for each term of the sum: filename, brand, parameter, weight, sub_score, points."""
    terms = [F.struct(F.lit(p).alias("parameter"), F.lit(w).alias("weight"), score_of(p).alias("sub_score")) for p, w in WEIGHTS.items()]
    out = df.select("filename", "brand", F.inline(F.array(*terms)))
    return out.withColumn("points", (F.col("weight") * F.col("sub_score")).cast("decimal(6,1)"))
