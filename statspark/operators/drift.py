"""Population stability index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import number
from ..functions.binning import RULES, bin_count


def _index(counts: DataFrame, epsilon: float | None, totals: DataFrame) -> DataFrame:
    """psi from (r, c) for each bin and totals (r_all, c_all); a share of zero becomes epsilon, or drops the bin."""
    t = counts.crossJoin(F.broadcast(totals))
    share = lambda n, a: F.try_divide(F.col(n), F.col(a))
    fill = lambda e: F.when(e == 0, F.lit(epsilon).cast("double")).otherwise(e)
    r, c = fill(share("r", "r_all")), fill(share("c", "c_all"))
    return t.select(((c - r) * F.ln(F.try_divide(c, r))).alias("v")).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("psi"))


def psi(reference: DataFrame, current: DataFrame, column: str, current_column: str | None = None, *, bins: Sequence[float] | None = None, bin_count_rule: int | str = "fd", include_nulls: bool = True, epsilon: float | None = 1e-4) -> DataFrame:
    """One row, psi = sum of (c - r) * ln(c / r) over bins.

    If both columns are numeric, bins are right-closed between ``bins``, or of equal width over
    the reference (an int, or a rule of bin_count). The lowest edge belongs to the first
    bin. Values outside fall in no bin but stay in the total. With ``include_nulls``
    nulls are a bin of their own, else they are left out; NaN counts as null. Other columns take
    each value as a bin. Both sides are counted in one aggregation.
    """
    kinds = [df.schema[c].dataType for df, c in ((reference, column), (current, current_column or column))]
    numeric = all(isinstance(k, T.NumericType) for k in kinds)
    tagged = reference.select(F.col(column).alias("x"), F.lit(1).alias("r"), F.lit(0).alias("c"))
    other = current.select(F.col(current_column or column).alias("x"), F.lit(0).alias("r"), F.lit(1).alias("c"))
    if not numeric:
        tagged, other = (d.withColumn("x", F.col("x").cast("string")) for d in (tagged, other))
    else:
        tagged, other = (d.withColumn("x", number("x")) for d in (tagged, other))
    both = tagged.unionByName(other)
    if not include_nulls:
        both = both.filter("x IS NOT NULL")
    totals = both.agg(F.sum("r").alias("r_all"), F.sum("c").alias("c_all"))
    if not numeric:
        return _index(both.groupBy("x").agg(F.sum("r").alias("r"), F.sum("c").alias("c")), epsilon, totals)
    x = F.col("x")
    if bins is not None:
        edges = sorted(float(b) for b in bins)
        e = F.array(*(F.lit(b) for b in edges))
        place: Column = F.when((x >= edges[0]) & (x <= edges[-1]), F.greatest(F.lit(1), F.size(F.filter(e, lambda b: b < x))))
        every = F.sequence(F.lit(1), F.lit(len(edges) - 1))
        placed = both.withColumn("b", place)
        possible = both.sparkSession.range(1).select(F.explode(every).alias("b"))
    else:
        base = reference.agg(F.min(number(column)).alias("lo"), F.max(number(column)).alias("hi"))
        if isinstance(bin_count_rule, int):
            base = base.withColumn("k", F.lit(bin_count_rule).cast("long"))
        elif bin_count_rule in RULES:
            base = base.crossJoin(bin_count(reference, column, bin_count_rule).withColumnRenamed("bins", "k"))
        else:
            raise ValueError(f"`bin_count_rule` must be an int or one of {RULES}")
        base = base.withColumn("k", F.greatest(F.coalesce("k", F.lit(1).cast("long")), F.lit(1).cast("long")))
        # Edge i is lo + i * (hi - lo) / k. The first guess of a bin is corrected by comparing with the edges themselves.
        edge = lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / F.col("k")
        guess = F.least(F.greatest(F.ceil(F.coalesce(F.try_divide((x - F.col("lo")) * F.col("k"), F.col("hi") - F.col("lo")), F.lit(1.0))), F.lit(1)), F.col("k"))
        placed = both.crossJoin(F.broadcast(base)).withColumn("g", guess)
        fixed = F.when((F.col("g") > 1) & (x <= edge(F.col("g") - 1)), F.col("g") - 1).when((F.col("g") < F.col("k")) & (x > edge(F.col("g"))), F.col("g") + 1).otherwise(F.col("g"))
        placed = placed.withColumn("b", F.when((x >= F.col("lo")) & (x <= F.col("hi")), fixed)).drop("lo", "hi", "k", "g")
        possible = base.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("b"))
    inside = placed.filter("x IS NULL OR b IS NOT NULL").withColumn("b", F.when(F.col("x").isNull(), F.lit(0)).otherwise(F.col("b")).cast("long"))
    empty = possible.select(F.col("b").cast("long").alias("b"), F.lit(0).alias("r"), F.lit(0).alias("c"))
    if include_nulls:
        empty = empty.unionByName(both.sparkSession.range(1).select(F.lit(0).cast("long").alias("b"), F.lit(0).alias("r"), F.lit(0).alias("c")))
    counts = inside.select("b", "r", "c").unionByName(empty).groupBy("b").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    return _index(counts, epsilon, totals)
