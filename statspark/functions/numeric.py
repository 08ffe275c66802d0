"""Numeric Column functions: normal distribution, hashed randomness, closeness, sums and areas."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import By, groups

# Acklam's rational approximation of the normal quantile.
PPF_A = (-39.6968302866538, 220.946098424521, -275.928510446969, 138.357751867269, -30.6647980661472, 2.50662827745924)
PPF_B = (-54.4760987982241, 161.585836858041, -155.698979859887, 66.8013118877197, -13.2806815528857)
PPF_C = (-7.78489400243029e-03, -0.322396458041136, -2.40075827716184, -2.54973253934373, 4.37466414146497, 2.93816398269878)
PPF_D = (7.78469570904146e-03, 0.32246712907004, 2.445134137143, 3.75440866190742)
PPF_LOW = 0.02425
# Formula 7.1.26 of Abramowitz and Stegun for the error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _poly(coefficients: Iterable[float], x: Column) -> Column:
    out = None
    for c in coefficients:
        out = F.lit(c) if out is None else out * x + F.lit(c)
    return out


def norm_ppf(q: Column | str | float) -> Column:
    """Normal quantile: -inf at 0, +inf at 1, NaN outside of [0, 1], NULL for NULL."""
    q = _col(q).cast("double")
    tail = lambda p: _poly(PPF_C, r := F.sqrt(-2.0 * F.ln(p))) / _poly((*PPF_D, 1.0), r)
    d = q - 0.5
    r = d * d
    middle = _poly(PPF_A, r) * d / _poly((*PPF_B, 1.0), r)
    return (
        F.when(q.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(q) | (q < 0) | (q > 1), F.lit(math.nan))
        .when(q == 0, F.lit(-math.inf))
        .when(q == 1, F.lit(math.inf))
        .when(q < PPF_LOW, tail(q))
        .when(q < 1 - PPF_LOW, middle)
        .otherwise(-tail(1.0 - q))
    )


def norm_cdf(x: Column | str | float) -> Column:
    """Normal distribution function, to about 1e-7."""
    x = _col(x).cast("double")
    z = F.abs(x) / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * z)
    erf = 1.0 - _poly((*reversed(ERF_A), 0.0), t) * F.exp(-z * z)
    return 0.5 * (1.0 + F.when(x < 0, -erf).otherwise(erf))


# Odd multipliers of the integer hash below, for the low and high part of the first key, the second key, and the mixing rounds.
HASH_LOW, HASH_HIGH, HASH_SECOND, HASH_MIX = 2654435761, 2246822519, 1597334677, 73244475


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A uniform value in [0, 1) from a seed and one or two whole-number keys.

    64-bit integer arithmetic without overflow, which plain SQL can repeat. Both halves of the first
    key count, and 31 bits of the second.
    """
    m, half = F.lit(2**32), F.lit(2**31)
    a = keys[0].cast("long")
    b = keys[1].cast("long") if len(keys) > 1 else F.lit(0).cast("long")
    h = F.pmod((F.pmod(a, half) + 1) * F.lit(HASH_LOW), m) + F.pmod((F.pmod(F.shiftright(a, 31), half) + 1) * F.lit(HASH_HIGH), m)
    h = F.pmod(h + F.pmod((F.pmod(b, half) + 1) * F.lit(HASH_SECOND), m) + F.lit((seed * 40503 + 12345) % 2**32), m)
    for _ in range(2):
        h = F.pmod(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(HASH_MIX), m)
    return h.bitwiseXOR(F.shiftright(h, 16)).cast("double") / float(2**32)


def with_hash_uniform(df: DataFrame, out: str, seed: int, *keys: Column) -> DataFrame:
    """Adds :func:`hash_uniform` as a column, one mixing round a projection, so that no step is written out twice in generated code."""
    m, half = F.lit(2**32), F.lit(2**31)
    a = keys[0].cast("long")
    b = keys[1].cast("long") if len(keys) > 1 else F.lit(0).cast("long")
    first = F.pmod((F.pmod(a, half) + 1) * F.lit(HASH_LOW), m) + F.pmod((F.pmod(F.shiftright(a, 31), half) + 1) * F.lit(HASH_HIGH), m)
    df = df.withColumn(out, F.pmod(first + F.pmod((F.pmod(b, half) + 1) * F.lit(HASH_SECOND), m) + F.lit((seed * 40503 + 12345) % 2**32), m))
    h = F.col(out)
    for _ in range(2):
        df = df.withColumn(out, F.pmod(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(HASH_MIX), m))
    return df.withColumn(out, h.bitwiseXOR(F.shiftright(h, 16)).cast("double") / float(2**32))


def hash_uniform_sql(seed: int, a: str, b: str = "0") -> str:
    """The same as DuckDB SQL, for keys that are not negative."""
    part = lambda k, mul: f"((({k}) % 2147483648 + 1) * {mul}) % 4294967296"
    h = f"({part(a, HASH_LOW)} + {part(f'({a})::BIGINT >> 31', HASH_HIGH)} + {part(b, HASH_SECOND)} + {(seed * 40503 + 12345) % 2**32}) % 4294967296"
    for _ in range(2):
        h = f"((xor(({h})::BIGINT, (({h})::BIGINT >> 16)) * {HASH_MIX}) % 4294967296)"
    return f"(xor(({h})::BIGINT, (({h})::BIGINT >> 16))::DOUBLE / 4294967296.0::DOUBLE)"


@lru_cache(maxsize=4)
def _rings(seed: int, n: int, iterations: int) -> tuple[np.ndarray, ...]:
    """Where draws lie on the ring of 32-bit numbers once the mixing rounds are undone and the first key's factor is divided out.

    The draws of an iteration (and of each 2^31 rows) are one arc there. Returns the arcs' starts, lengths and iterations, and for each of
    65,536 equal parts of the ring how many arcs meet it, where its list starts, and the lists.
    """
    m, half, inverse = 2**32, 2**31, pow(HASH_LOW, -1, 2**32)
    arcs = [(((hi + 1) * HASH_HIGH + (i + 1) * HASH_SECOND + seed * 40503 + 12345) * inverse + 1, min(half, n - hi * half), i) for hi in range(-(-n // half)) for i in range(iterations)]
    starts, lengths, its = (np.array(c, dtype=np.int64) for c in zip(*((a % m, size, i) for a, size, i in arcs), strict=True))
    meets = ((starts + lengths - 1) >> 16) - (starts >> 16) + 1
    arc = np.repeat(np.arange(len(arcs), dtype=np.int32), meets)
    part = (np.repeat((starts >> 16) - (np.cumsum(meets) - meets), meets) + np.arange(len(arc))) & 0xFFFF
    counts = np.bincount(part, minlength=1 << 16)
    return starts.astype(np.uint32), lengths.astype(np.uint32), its, counts.astype(np.min_scalar_type(counts.max())), np.cumsum(counts) - counts, arc[np.argsort(part, kind="stable")]


def draws_of(rows: np.ndarray, seed: int, n: int, iterations: int, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """For ascending row numbers: how many iterations drew each, and ``k << bits | iteration`` of those, row by row.

    Draw r of an iteration takes row floor(u * n) by :func:`hash_uniform` u of (r, iteration), for r below n. The hash is one to one in r for each 2^31
    of them, so a row finds its draws by undoing it for the 2^32 / n values that fall on the row: no draw has to be sent to its row.
    """
    starts, lengths, its, counts, lists, arcs = _rings(seed, n, iterations)
    bits, undo, divide = draw_bits(iterations), np.uint32(pow(HASH_MIX, -1, 2**32)), np.uint32(pow(HASH_LOW, -1, 2**32))
    pick = lambda h: math.floor(h / 4294967296.0 * float(n))

    def edge(row: int) -> int:
        """The least hash that falls on this row or one after it."""
        h = min(-(-row * 2**32 // n), 2**32)
        while h > 0 and pick(h - 1) >= row:
            h -= 1
        while h < 2**32 and pick(h) < row:
            h += 1
        return h

    per = max(1, int(chunk // max(2**32 / n, iterations)))
    ends = np.flatnonzero(np.diff(rows) != 1) + 1
    sizes, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    most = int(per * (2**32 / n + 1)) + 2
    ramp, z_all, temp_all = np.arange(most, dtype=np.uint32), np.empty(most, np.uint32), np.empty(most, np.uint32)
    part_all, meets_all = np.empty(most, np.intp), np.empty(most, counts.dtype)
    for run in np.split(rows, ends) if len(rows) else []:
        for a in range(int(run[0]), int(run[-1]) + 1, per):
            b = min(a + per, int(run[-1]) + 1)
            low, high = edge(a), edge(b)
            z, temp, part, meets = (x[: high - low] for x in (z_all, temp_all, part_all, meets_all))
            np.add(ramp[: high - low], np.uint32(low), out=z)
            for factor in (undo, undo, divide):
                np.bitwise_xor(z, np.right_shift(z, 16, out=temp), out=z)
                np.multiply(z, factor, out=z)
            np.right_shift(z, 16, out=part, casting="unsafe")
            np.take(counts, part, out=meets, mode="clip")
            at = np.flatnonzero(meets != 0)
            meets = meets[at].astype(np.int64)
            rep = np.repeat(at, meets)
            arc = arcs[np.repeat(lists[part[at]] - (np.cumsum(meets) - meets), meets) + np.arange(len(rep))]
            hit = z[rep] - starts[arc] < lengths[arc]
            row = np.floor((rep[hit] + low) / 4294967296.0 * float(n)).astype(np.int64) - a
            k = np.bincount(row * iterations + its[arc[hit]], minlength=(b - a) * iterations)
            some = np.flatnonzero(k)
            sizes.append(np.bincount(some // iterations, minlength=b - a))
            codes.append(k[some] << bits | some % iterations)
    return np.concatenate(sizes), np.concatenate(codes)


def draw_bits(iterations: int) -> int:
    """Bits of an iteration's number in the codes of :func:`draws_of`."""
    return max(1, (iterations - 1).bit_length())


def poisson_cdf(lam: float) -> list[float]:
    """Cumulative probabilities of 0, 1, ... until the rest is below 1e-12."""
    out, term, total, k = [], math.exp(-lam), 0.0, 0
    while total < 1 - 1e-12 and k < 1000 + 20 * lam:
        total += term
        out.append(total)
        k += 1
        term *= lam / k
    return out


def poisson_draw(u: Column, lam: float = 1.0) -> Column:
    """Poisson counts by inverting the distribution function at uniform values.

    ``u`` should be a column, not a deep expression: it is named once for each count.
    """
    cdf = poisson_cdf(lam)
    out = F.when(u < cdf[0], F.lit(0).cast("long"))
    for k, c in enumerate(cdf[1:], 1):
        out = out.when(u < c, F.lit(k).cast("long"))
    return out.otherwise(F.lit(len(cdf)).cast("long"))


class Random:
    """Seeded draws; each call moves the seed on by one."""

    def __init__(self, seed: int = 208):
        self.seed = seed

    def poisson(self, spark, lam: float, size: int) -> DataFrame:  # noqa: ANN001
        """(id, value): ``size`` Poisson draws."""
        out = with_hash_uniform(spark.range(size), "u", self.seed, F.col("id")).select("id", poisson_draw(F.col("u"), lam).alias("value"))
        self.seed += 1
        return out


def is_close(x: Column | str, y: Column | str | float, rtol: float = 1e-5, atol: float = 1e-8, null_equal: bool = False) -> Column:
    """abs(x - y) <= atol + rtol * abs(y). NaN equals nothing; with ``null_equal`` two NULLs are close, and one is not."""
    x, y = _col(x).cast("double"), _col(y).cast("double")
    near = F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)
    near = F.when(F.isnan(x) | F.isnan(y), F.lit(False)).when(x == y, F.lit(True)).otherwise(near)
    if not null_equal:
        return F.when(x.isNotNull() & y.isNotNull(), near)
    return F.when(x.isNull() & y.isNull(), F.lit(True)).when(x.isNull() | y.isNull(), F.lit(False)).otherwise(near)


def sum_horizontal(*exprs: Column | str | Iterable[Column | str], null_method: str = "kleene") -> Column:
    """Sum of columns of a row. kleene: NULL if all are; ignore: NULL counts as 0; propagate: NULL if any is."""
    flat = list(exprs[0]) if len(exprs) == 1 and not isinstance(exprs[0], (str, Column)) else list(exprs)
    cols = [_col(e) for e in flat]
    if null_method not in ("kleene", "ignore", "propagate"):
        raise ValueError("`null_method` must be one of `kleene`, `ignore` or `propagate`")
    total = None
    for c in cols:
        part = c if null_method == "propagate" else F.coalesce(c, F.lit(0))
        total = part if total is None else total + part
    if null_method == "kleene":
        return F.when(F.coalesce(*cols).isNotNull(), total)
    return total


def auc(df: DataFrame, x: str, y: str, by: By = None, method: str = "trapezoidal") -> DataFrame:
    """(by, auc): area under y over x, sorted by x (ties by y). Rows with a null are dropped.

    The rectangular method takes the height at the middle of each step, which is the
    trapezoid's area too. Without ``by``, the steps between slices of the x axis are
    closed from each slice's first and last point, so no task holds all points.
    """
    if method not in ("trapezoidal", "rectangular"):
        raise ValueError("`method` must be one of `rectangular` or `trapezoidal`")
    keys = groups(by)
    pts = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    area = lambda w: (F.lead("x").over(w) - F.col("x")) * (F.lead("y").over(w) + F.col("y")) / 2.0
    if keys:
        w = Window.partitionBy(*keys).orderBy("x", "y")
        return pts.withColumn("a", area(w)).groupBy(*keys).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc"))
    edges = pts.agg(F.percentile_approx("x", F.array(*(F.lit(i / 64) for i in range(1, 64))), F.lit(1000)).alias("e"))
    cut = pts.crossJoin(F.broadcast(edges)).withColumn("b", F.size(F.filter("e", lambda e: e < F.col("x")))).drop("e")
    inner = Window.partitionBy("b").orderBy("x", "y")
    part = cut.withColumn("a", area(inner)).groupBy("b").agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"), F.min(F.struct("x", "y")).alias("lo"), F.max(F.struct("x", "y")).alias("hi"))
    ends = Window.orderBy("b")  # at most 64 rows
    gap = (F.lead("lo.x").over(ends) - F.col("hi.x")) * (F.lead("lo.y").over(ends) + F.col("hi.y")) / 2.0
    return part.withColumn("g", gap).agg((F.sum("a") + F.coalesce(F.sum("g"), F.lit(0.0))).alias("auc"))


def auc_expr(x: Column | str, y: Column | str) -> Column:
    """The same area as an aggregate expression, for use in ``groupBy().agg()``; a group's points are sorted in one place."""
    pts = F.sort_array(F.collect_list(F.when(_col(x).isNotNull() & _col(y).isNotNull(), F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y")))))
    step = F.zip_with(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), lambda a, b: (b["x"] - a["x"]) * (a["y"] + b["y"]) / 2.0)
    return F.aggregate(step, F.lit(0.0), lambda s, v: s + v)
