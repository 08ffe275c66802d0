"""Correlation matrices over pairs of columns, with nulls left out for each pair."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import from_arrays
from ..plans.prefix import running

METHODS = ("pearson", "spearman")
#: Slices of each pair's ranks.
PAIR_SLICES = 32
#: Pairs up to which edges and totals of slices are broadcast (about 500 bytes for each pair).
FEW_PAIRS = 20_000


def _pairs(df: DataFrame, l1, l2) -> list[tuple[str, str]]:  # noqa: ANN001
    if l1 is None and l2 is None:
        return list(combinations(df.columns, 2))
    if l2 is None:
        return [tuple(p) for p in l1]
    if l1 is None:
        raise AssertionError("`l2` needs `l1`")
    return [(a, b) for b in l2 if b in df.columns for a in l1 if a in df.columns]


def correlations(df: DataFrame, l1: Sequence | None = None, l2: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """(c1, c2, value) for all pairs of columns, given pairs (l1), or the rectangle l1 x l2.

    Pearson takes all pairs in one aggregation. Spearman ranks each pair's complete
    rows: values are counted first, so average ranks come from prefix sums over slices of
    distinct values, and no task holds a whole column. That reads the counts several times, so they are kept in memory and on disk meanwhile, and
    Spearman's values are computed when this is called.
    """
    if method not in METHODS:
        raise ValueError(f"`method` must be one of {METHODS}")
    pairs = _pairs(df, l1, l2)
    x = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    if method == "pearson":
        one = df.agg(*(F.corr(x(a), x(b)).alias(f"v{i}") for i, (a, b) in enumerate(pairs)))
        each = F.explode(F.array(*(F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"v{i}").alias("value")) for i, (a, b) in enumerate(pairs))))
        return one.select(each.alias("r")).select("r.*")
    both = F.explode(F.array(*(F.struct(F.lit(i).alias("pair"), x(a).alias("a"), x(b).alias("b")) for i, (a, b) in enumerate(pairs)))).alias("r")
    cells = df.select(both).select("r.*").dropna().groupBy("pair", "a", "b").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    sides = F.explode(F.array(*(F.struct((2 * F.col("pair") + i).alias("axis"), F.col(c).alias("v"), "n") for i, c in enumerate(("a", "b"))))).alias("r")
    marginals = cells.select(sides).select("r.*").groupBy("axis", "v").agg(F.sum("n").alias("m")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = {r["pair"]: r["value"] for r in _spearman(cells, marginals, len(pairs)).collect()}  # one row for each pair
    finally:
        marginals.unpersist()
        cells.unpersist()
    values = pa.array([found.get(i) for i in range(len(pairs))], pa.float64())
    return from_arrays(df.sparkSession, c1=pa.array([a for a, _ in pairs], pa.string()), c2=pa.array([b for _, b in pairs], pa.string()), value=values)


def _spearman(cells: DataFrame, marginals: DataFrame, n_pairs: int) -> DataFrame:
    """(pair, value) from counts ``n`` of the values (pair, a, b) and counts ``m`` of the values (axis, v), where 2 * pair is the axis of a and the next one that of b."""
    ranked = running(marginals, "v", ["m"], "axis", slices=PAIR_SLICES, few=n_pairs <= FEW_PAIRS)
    ranks = ranked.select("axis", "v", "m", (F.col("cum_m") - (F.col("m") - 1) / 2.0).alias("rank"))
    of = lambda i: ranks.filter(F.pmod("axis", F.lit(2)) == i).select(F.shiftright("axis", 1).alias("q"), F.col("v").alias("at"), "rank")
    # Ranks of b are summed for each a before a's rank is looked up, so that only one join meets all cells.
    by_a = cells.join(of(1), (F.col("pair") == F.col("q")) & (F.col("b") == F.col("at"))).groupBy("pair", "a").agg(F.sum(F.col("n") * F.col("rank")).alias("s"))
    both = by_a.join(of(0), (F.col("pair") == F.col("q")) & (F.col("a") == F.col("at"))).groupBy("pair").agg(F.sum(F.col("rank") * F.col("s")).alias("sab"))
    m, r = F.col("m"), F.col("rank")
    side = lambda i, e: F.sum(F.when(F.pmod("axis", F.lit(2)) == i, e))
    sums = ranks.groupBy(F.shiftright("axis", 1).alias("of")).agg(side(0, m).alias("t"), *(side(i, m * e).alias(k) for k, i, e in (("sa", 0, r), ("sb", 1, r), ("saa", 0, r * r), ("sbb", 1, r * r))))
    t = F.col("t")
    value = F.try_divide(t * F.col("sab") - F.col("sa") * F.col("sb"), F.sqrt(t * F.col("saa") - F.col("sa") * F.col("sa")) * F.sqrt(t * F.col("sbb") - F.col("sb") * F.col("sb")))
    return sums.join(both, F.col("of") == F.col("pair")).select("pair", value.alias("value"))


def correlation_matrix(df: DataFrame, l1: Sequence | None = None, l2: Sequence[str] | None = None, method: str = "pearson", index_name: str = "") -> DataFrame:
    """The matrix form: a row for each second column and a column for each first one. Without lists, the strict lower triangle."""
    pairs = _pairs(df, l1, l2)
    columns = list(dict.fromkeys(a for a, _ in pairs))
    return correlations(df, l1, l2, method).groupBy(F.col("c2").alias(index_name or "index")).pivot("c1", columns).agg(F.first("value"))
