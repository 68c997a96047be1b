"""Column functions: the scorers of the twelve parameters, and what reports show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import KINDS

TENTHS = "decimal(3,1)"


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends, lower case; null counts as NA."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("NA")), r"(?U)^\s+|\s+$", ""))


def _number(v: Column) -> Column:
    return F.regexp_extract(v, r"(\d+)", 1).try_cast("double")


def _tenths(c) -> Column:
    return (F.lit(c) if not isinstance(c, Column) else c).cast(TENTHS)


def score_age(c: Column) -> Column:
    v = stripped(c)
    n = _number(v)
    out = F.when(v.isin("na", "", "fda labelled age", "fda labeled age"), 1.0).when(n.isNull(), 0.7)
    return _tenths(out.when(n <= 6, 1.0).when(n <= 12, 0.9).when(n <= 18, 0.7).otherwise(0.4))


def score_steps(c: Column) -> Column:
    v = stripped(c)
    n = F.least(_number(v), F.lit(4.0)).cast("decimal(2,0)")  # four steps are worth 0 as well as any more
    out = F.when(v.isin("na", "", "0") | _number(v).isNull(), F.lit(1).cast("decimal(4,1)"))
    return _tenths(out.otherwise(F.greatest(F.lit(0).cast("decimal(4,1)"), F.lit(1) - n * F.lit("0.3").cast("decimal(2,1)"))))


def score_duration(c: Column) -> Column:
    v = stripped(c)
    n = _number(v)
    out = F.when(v.isin("na", "", "unspecified") | n.isNull(), 0.5)
    return _tenths(out.when(n >= 12, 1.0).when(n >= 6, 0.7).when(n >= 3, 0.4).otherwise(0.2))


def score_yesno(c: Column, yes: float = 0.3, no: float = 1.0) -> Column:
    v = stripped(c)
    return _tenths(F.when(v.isin("yes", "y"), yes).when(v.isin("no", "n"), no).otherwise(0.7))


def score_text_present(c: Column) -> Column:
    return _tenths(F.when(stripped(c).isin("na", ""), 1.0).otherwise(0.3))


SCORERS = {"age": score_age, "steps": score_steps, "duration": score_duration, "yesno": score_yesno, "text": score_text_present}


def score_of(parameter: str) -> Column:
    return SCORERS[KINDS[parameter]](F.col(f"`{parameter}`"))


def access_band(c: Column) -> Column:
    v = F.coalesce(c, F.lit(0))
    return F.when(v >= 70, "Good Access").when(v >= 40, "Moderate Access").otherwise("Limited Access")
