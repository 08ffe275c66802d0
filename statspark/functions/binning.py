"""Rules for the number of histogram bins, as one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import By, groups, join_groups, number
from ..plans.prefix import quantiles

#: Quantile levels that the Freedman-Diaconis rule widens to while the range is zero.
FD_LEVELS = (1 / 4, *(1 / 2**k for k in range(3, 11)))
RULES = ("fd", "doane", "rice", "sturges", "scott", "sqrt")


def _count(width: Column, low: str = "lo", high: str = "hi") -> Column:
    return F.ceil(F.try_divide(F.col(high) - F.col(low), width)).cast("long")


def bin_count(df: DataFrame, column: str, rule: str = "fd", by: By = None) -> DataFrame:
    """(by, bins): bins by a rule of RULES over values that are not null or NaN.

    fd takes exact quantiles; if the middle half has no width, wider ones down to
    1/1024, and at last 3.5 standard deviations. doane is NULL for two values or
    fewer. A rule whose width is zero gives NULL.
    """
    if rule not in RULES:
        raise ValueError(f"`rule` must be one of {RULES}")
    x = number(column)
    aggs = [F.count(x).cast("double").alias("n")]
    if rule in ("fd", "scott"):
        aggs += [F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd")]
    if rule == "doane":
        aggs.append(F.skewness(x).alias("g"))
    out = df.groupBy(*groups(by)).agg(*aggs)
    if rule == "fd":
        values = df.select(*groups(by), x.alias("__v")).filter("__v IS NOT NULL")
        out = join_groups(out, quantiles(values, "__v", [p for a in FD_LEVELS for p in (a, 1 - a)], "q", by), by, "left")
    n = F.col("n")
    if rule == "fd":
        h = None
        for i, a in enumerate(FD_LEVELS):
            span = F.get("q", F.lit(2 * i + 1)) - F.get("q", F.lit(2 * i))
            span = span * 2.0 if i == 0 else span / (1 - 2 * a)
            h = F.when(span > 0, span) if h is None else h.when(span > 0, span)
        bins = _count(h.otherwise(3.5 * F.col("sd")) * F.pow(n, F.lit(-1.0 / 3.0)))
    elif rule == "scott":
        bins = _count(F.try_divide(3.49 * F.col("sd"), F.pow(n, F.lit(1.0 / 3.0))))
    elif rule == "doane":
        sg = F.sqrt(F.try_divide(6.0 * (n - 2), (n + 1) * (n + 3)))
        bins = F.when(n > 2, F.floor(1 + F.log2(n) + F.log2(1 + F.try_divide(F.abs("g"), sg))).cast("long"))
    elif rule == "rice":
        bins = F.ceil(2 * F.pow(n, F.lit(1.0 / 3.0))).cast("long")
    elif rule == "sturges":
        bins = F.when(n > 0, (F.ceil(F.log2(n)) + 1).cast("long"))
    else:
        bins = F.ceil(F.sqrt(n)).cast("long")
    return out.select(*groups(by), bins.alias("bins"))
