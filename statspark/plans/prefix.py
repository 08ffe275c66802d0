"""Prefix sums and threshold bins that do not gather all rows in one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import By, groups, join_groups

#: Slices of a score axis, each ordered in a task of its own. A slice's totals are the only thing that is summed in one place.
SLICES = 1024


def _join_slices(placed: DataFrame, starts: DataFrame, keys: list[str], slice_: str, few: bool = False) -> DataFrame:
    """Joins totals of slices (at most SLICES rows for each group) to the rows of the slices.

    Keys that cannot be null are compared plainly, so that rows dealt by group and slice stay where they are.
    """
    on = []
    for i, k in enumerate(keys):
        starts = starts.withColumnRenamed(k, f"__h{i}")
        on.append(F.col(k).eqNullSafe(F.col(f"__h{i}")) if placed.schema[k].nullable else F.col(k) == F.col(f"__h{i}"))
    return placed.join(F.broadcast(starts) if few or not keys else starts, [*on, F.col(slice_) == F.col("__at")])


def slice_edges(cells: DataFrame, order: str, by: By = None, slices: int = SLICES) -> DataFrame:
    """(by, __edges): approximate percentiles that cut the axis into ``slices``."""
    cuts = doubles([(i + 1) / slices for i in range(slices - 1)])
    return cells.groupBy(*groups(by)).agg(F.percentile_approx(order, cuts, F.lit(min(10 * slices, 10_000))).alias("__edges"))


def with_slices(rows: DataFrame, order: str, by: By = None, slices: int = SLICES, out: str = "__slice", few: bool = False) -> DataFrame:
    """Adds ``out``, the number of the axis slice that holds ``order``; equal values share one."""
    edges = slice_edges(rows.select(*groups(by), order), order, by, slices)
    placed = join_groups(rows, F.broadcast(edges) if few else edges, by)
    return search(placed, F.col("__edges"), slices - 1, order, out, below=True).drop("__edges")


def running(cells: DataFrame, order: str, sums: Sequence[str], by: By = None, descending: bool = False, slices: int | str | None = SLICES, largest: bool = False, few: bool = False) -> DataFrame:
    """Adds ``cum_<c>`` for each column of ``sums``: the inclusive prefix sum along ``order``, or the prefix maximum if ``largest``.

    ``cells`` has one row for each value of ``order`` in a group. The axis is cut at
    approximate percentiles; rows are summed within a slice, and each slice starts
    from the totals of those before. ``slices`` may name a column of ``cells`` that rises with ``order`` and is taken instead. With
    ``slices=None`` each group is one partition, which suits many small groups. ``few``: the caller knows that there are few groups, so that edges and totals
    of slices are small enough to be broadcast.
    """
    keys = groups(by)
    arrow = (lambda c: F.col(c).desc()) if descending else F.col
    agg = F.max if largest else F.sum
    if slices is None:
        w = Window.partitionBy(*keys).orderBy(arrow(order)).rowsBetween(Window.unboundedPreceding, 0)
        return cells.withColumns({f"cum_{c}": agg(c).over(w) for c in sums})
    at = slices if isinstance(slices, str) else "__axis"
    placed = cells if isinstance(slices, str) else with_slices(cells, order, by, slices, at, few)
    totals = placed.groupBy(*keys, at).agg(*(agg(c).alias(f"__t_{c}") for c in sums))
    before = Window.partitionBy(*keys).orderBy(arrow(at)).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, F.col(at).alias("__at"), *(agg(f"__t_{c}").over(before).alias(f"__s_{c}") for c in sums))
    inner = Window.partitionBy(*keys, at).orderBy(arrow(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = _join_slices(placed.withColumns({f"__c_{c}": agg(c).over(inner) for c in sums}), starts, keys, at, few)
    joined = (lambda c: F.greatest(f"__c_{c}", f"__s_{c}")) if largest else (lambda c: F.col(f"__c_{c}") + F.coalesce(f"__s_{c}", F.lit(0.0)))
    return out.withColumns({f"cum_{c}": joined(c) for c in sums}).select(*cells.columns, *(f"cum_{c}" for c in sums))


def search(df: DataFrame, edges: Column, n: int, value: str, out: str, below: bool = False) -> DataFrame:
    """Adds the number of the ``n`` sorted ``edges`` that are at most ``value`` (``below``: less), by a binary search in JVM code.

    One select with a step for each power of two; later steps refer to earlier ones.
    """
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)] if n else []
    names = [f"__p{i}" for i in range(len(steps) + 1)]
    columns = [F.lit(0).alias(names[0])]
    for i, step in enumerate(steps):
        probe = F.get(edges, F.col(names[i]) + (step - 1))
        up = probe < F.col(value) if below else probe <= F.col(value)
        columns.append(F.when(up, F.col(names[i]) + step).otherwise(F.col(names[i])).alias(names[i + 1]))
    return df.select("*", *columns).withColumnRenamed(names[-1], out).drop(*names[:-1])


def doubles(values: Sequence[float]) -> Column:
    """An array of doubles as one literal, which Catalyst folds; a literal for each value would be built one by one."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>") if values else F.array().cast("array<double>")


def bin_index(df: DataFrame, value: str, cuts: Sequence[float], out: str) -> DataFrame:
    """Adds the number of sorted ``cuts`` that are at most ``value``."""
    return search(df, doubles(cuts), len(cuts), value, out)


def quantiles(df: DataFrame, value: str, levels: Sequence[float], out: str, by: By = None) -> DataFrame:
    """(by, out): array of exact linear quantiles of a double column without nulls.

    Equal values are counted first and prefix sums give their ranks, so no task holds all values.
    """
    keys = groups(by)
    cells = df.groupBy(*keys, F.col(value).alias("__x")).agg(F.count("*").cast("double").alias("__n"))
    totals = cells.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    ranked = join_groups(running(cells, "__x", ["__n"], by), totals, by)
    place = [F.lit(float(p)) * (F.col("__all") - 1) for p in levels]
    picks = []
    for i, at in enumerate(place):
        picks += [F.min(F.when(F.col("cum___n") > F.floor(at), F.col("__x"))).alias(f"__lo{i}"), F.min(F.when(F.col("cum___n") > F.ceil(at), F.col("__x"))).alias(f"__hi{i}")]
    found = ranked.groupBy(*keys).agg(F.first("__all").alias("__all"), *picks)
    each = (F.when(F.col(f"__lo{i}") == F.col(f"__hi{i}"), F.col(f"__lo{i}")).otherwise(F.col(f"__lo{i}") + (at - F.floor(at)) * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))) for i, at in enumerate(place))
    return found.select(*keys, F.array(*each).alias(out))


def at_thresholds(df: DataFrame, value: str, sums: dict[str, Column], thresholds: Sequence[float], by: By = None) -> DataFrame:
    """(by, threshold, ge_<c>, lt_<c>): sums over rows with value >= threshold, and below it.

    Rows are binned between thresholds and summed on the map side, so the shuffle
    carries at most len(thresholds) + 1 rows for each group and task.
    """
    keys = groups(by)
    cuts = sorted({float(t) for t in thresholds})
    binned = bin_index(df, value, cuts, "__bin").groupBy(*keys, "__bin").agg(*(F.sum(e).alias(c) for c, e in sums.items()))
    every = binned.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("__bin"), *(F.lit(0.0).alias(c) for c in sums)) if keys else None
    if every is None:
        every = binned.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("__bin"), *(F.lit(0.0).alias(c) for c in sums))
    full = binned.unionByName(every).groupBy(*keys, "__bin").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums))
    # At most len(thresholds) + 1 rows for each group from here on.
    up = Window.partitionBy(*keys).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    out = full.withColumns({f"ge_{c}": F.sum(c).over(up) for c in sums} | {f"lt_{c}": F.coalesce(F.sum(c).over(down), F.lit(0.0)) for c in sums})
    return out.filter("__bin > 0").select(*keys, F.get(doubles(cuts), F.col("__bin") - 1).alias("threshold"), *(f"ge_{c}" for c in sums), *(f"lt_{c}" for c in sums))


def next_at_least(targets: DataFrame, data: DataFrame, key: str, value: str, by: By = None) -> DataFrame:
    """As-of join: for each target key, the value of the least data key that is not below it, or NULL.

    Both sides are put on one axis and the last value seen from above is carried down. Without
    ``by`` the axis is one partition, so use it for bounded inputs or with groups.
    """
    keys = groups(by)
    both = targets.select(*keys, key, F.lit(None).cast(data.schema[value].dataType).alias(value), F.lit(0).alias("__src")).unionByName(data.select(*keys, key, value, F.lit(1).alias("__src")))
    w = Window.partitionBy(*keys).orderBy(F.desc(key), F.desc("__src")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("__src = 0").drop("__src")
