"""Bootstrap confidence intervals.

A replicate is a weight for each row, so all replicates of a metric are one job:
rows x iterations get a hashed weight, and the metric is computed by iteration with
that weight. Weights depend on (seed, iteration, row key) only, so a rerun of a
lost task, or plain SQL, gives the same draw.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import By, coerce, groups, join_groups, number, sdiv, truth
from ..functions.numeric import draw_bits, draws_of, norm_cdf, norm_ppf, poisson_draw, with_hash_uniform
from ..plans.prefix import SLICES, running, with_slices
from . import metrics as M

METHODS = ("standard", "percentile", "basic", "BCa")
SAMPLERS = ("multinomial", "poisson")
#: Distinct weights up to which BCa intervals of average precision and KS are offered: each weight has prefix sums of its own.
JACKKNIFE_WEIGHTS = 1_000
#: Rows and draws from which a row finds its draws by undoing the hash; rows to a task there, and least tasks.
FOUND_ROWS, FOUND_DRAWS, PART_ROWS, PARTS = 1 << 16, 1 << 24, 250_000, 24
#: What `run` takes apart between the sums, means and counts of an expression.
ARITHMETIC: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "negative": lambda a: -a,
    "try_divide": F.try_divide, "sqrt": F.sqrt, "abs": F.abs, "ln": F.ln, "exp": F.exp, "coalesce": F.coalesce,
}


def standard_interval(reps: DataFrame, point: DataFrame, alpha: float, by: By = None) -> DataFrame:
    """Mean of the replicates, plus and minus the normal quantile times their deviation."""
    z = norm_ppf(F.lit(1 - alpha))
    s = reps.groupBy(*groups(by)).agg(F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    return join_groups(s.select(*groups(by), (F.col("m") - z * F.col("sd")).alias("lower"), (F.col("m") + z * F.col("sd")).alias("upper")), point, by).select(*groups(by), "lower", "point", "upper")


def percentile_interval(reps: DataFrame, point: DataFrame, alpha: float, by: By = None) -> DataFrame:
    """Linear percentiles of the replicates."""
    s = reps.groupBy(*groups(by)).agg(F.percentile("value", F.array(F.lit(alpha), F.lit(1 - alpha))).alias("q"))
    return join_groups(s, point, by).select(*groups(by), F.get("q", F.lit(0)).alias("lower"), "point", F.get("q", F.lit(1)).alias("upper"))


def basic_interval(reps: DataFrame, point: DataFrame, alpha: float, by: By = None) -> DataFrame:
    """Percentiles mirrored at the point estimate."""
    p = percentile_interval(reps, point, alpha, by)
    return p.select(*groups(by), (2 * F.col("point") - F.col("upper")).alias("lower"), "point", (2 * F.col("point") - F.col("lower")).alias("upper"))


def acceleration(jack: DataFrame, by: By = None) -> DataFrame:
    """(by, acceleration) from leave-one-out values (value, times)."""
    keys, v, k = groups(by), F.col("value"), F.col("times")
    center = jack.groupBy(*keys).agg(sdiv(F.sum(v * k), F.sum(k)).alias("center"))
    d = F.col("center") - v
    out = join_groups(jack, center, by).groupBy(*keys).agg(F.sum(k * d * d * d).alias("a3"), F.sum(k * d * d).alias("a2"))
    return out.select(*keys, sdiv(F.col("a3"), 6 * F.pow("a2", F.lit(1.5))).alias("acceleration"))


def bca_interval(reps: DataFrame, point: DataFrame, jack: DataFrame, alpha: float, by: By = None) -> DataFrame:
    """Bias-corrected and accelerated percentiles; NULL where the correction is undefined."""
    keys = groups(by)
    a = acceleration(jack, by)
    s = join_groups(reps, point, by).groupBy(*keys).agg(
        F.sort_array(F.collect_list("value")).alias("v"), F.first("point").alias("point"),
        (F.sum((F.col("value") < F.col("point")).cast("double") + (F.col("value") <= F.col("point")).cast("double")) / (2 * F.count("*"))).alias("below"),
    )
    s = join_groups(s, a, by).withColumn("z0", norm_ppf("below"))

    # One step a projection, so that no step is written out again in the next.
    shifted = {n: F.col("z0") + norm_ppf(F.lit(z)) for n, z in (("lo", alpha), ("hi", 1 - alpha))}
    s = s.withColumns({f"x_{n}": F.col("z0") + sdiv(e, 1 - F.col("acceleration") * e) for n, e in shifted.items()})
    s = s.withColumns({f"p_{n}": norm_cdf(f"x_{n}") for n in shifted})
    s = s.withColumns({f"at_{n}": F.when(~F.isnan(f"p_{n}"), F.col(f"p_{n}")) * (F.size("v") - 1) for n in shifted})
    s = s.withColumns({f"low_{n}": F.floor(f"at_{n}").cast("int") for n in shifted})

    def pick(n: str) -> Column:
        low = F.col(f"low_{n}")
        return F.get("v", low) + (F.col(f"at_{n}") - low) * (F.get("v", F.least(low + 1, F.size("v") - 1)) - F.get("v", low))

    usable = (F.abs("z0") < float("inf")) & F.col("acceleration").isNotNull()
    return s.select(*keys, F.when(usable, pick("lo")).alias("lower"), "point", F.when(usable, pick("hi")).alias("upper"))


def taken_apart(df: DataFrame, stat: Column) -> tuple[list[Column], Callable[[Callable[[int, str], Column]], Column]] | None:
    """What an aggregate expression sums, averages or counts, and the expression as a function of those aggregates, by number and name.

    None if it has other aggregates, or anything but ``ARITHMETIC`` and literals around them.
    """
    from pyspark.sql.classic.column import Column as Classic

    if not isinstance(stat, Classic):
        return None
    column = lambda node: Classic(df.sparkSession._jvm.org.apache.spark.sql.Column(node))
    args: list[Column] = []

    def walk(node):  # noqa: ANN001, ANN202
        kind = node.getClass().getSimpleName()
        if kind == "Literal":
            return lambda of, c=column(node): c
        if kind == "Alias" or kind == "Cast" and node.dataType().simpleString() == "double":
            return walk(node.child())
        if kind != "UnresolvedFunction" or node.isDistinct():
            return None
        name, inner = node.functionName(), [node.arguments().apply(i) for i in range(node.arguments().size())]
        if name in ("sum", "avg", "count") and len(inner) == 1 and "Window(" not in inner[0].toString():
            args.append(F.lit(1) if inner[0].getClass().getSimpleName() == "UnresolvedStar" else column(inner[0]))
            return lambda of, i=len(args) - 1: of(i, name)
        parts = [walk(n) for n in inner] if name in ARITHMETIC else [None]
        return None if None in parts else lambda of: ARITHMETIC[name](*(p(of) for p in parts))

    whole = walk(stat._jc.node())
    return None if whole is None else (args, whole)


def running_before(steps: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``prior_<c>``: the value of rising column c at the step before, within ``lw``; 0 at the first.

    A slice looks its own rows up in order; its first row takes the largest value of the slices before.
    """
    inner = Window.partitionBy("lw", "__slice").orderBy("s")
    before = Window.partitionBy("lw").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = steps.groupBy("lw", "__slice").agg(*(F.max(c).alias(f"m_{c}") for c in columns))
    ends = ends.select(F.col("lw").alias("lw1"), F.col("__slice").alias("sl1"), *(F.coalesce(F.max(f"m_{c}").over(before), F.lit(0.0)).alias(f"e_{c}") for c in columns))
    held = steps.withColumns({f"lag_{c}": F.lag(c).over(inner) for c in columns})
    out = held.join(ends, (F.col("lw") == F.col("lw1")) & (F.col("__slice") == F.col("sl1")))
    return out.withColumns({f"prior_{c}": F.coalesce(f"lag_{c}", f"e_{c}") for c in columns}).select(*steps.columns, *(f"prior_{c}" for c in columns))


def _found(seed: int, n: int, iterations: int) -> Callable[[str], Column]:
    """The codes of a row's draws, by its number."""

    def codes(rows: pa.Array) -> pa.Array:
        at = rows.to_numpy()
        order = None if (np.diff(at) > 0).all() else np.argsort(at)
        sizes, values = draws_of(at if order is None else at[order], seed, n, iterations)
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
        return out if order is None else out.take(pa.array(np.argsort(order)))

    return F.arrow_udf(codes, "array<long>")


class Bootstrap:
    """Intervals of metrics over replicates.

    ``key``: a column that is unique for each row, which seeds the row's draws.
    Methods return (by..., lower, point, upper).
    """

    def __init__(self, iterations: int = 1000, confidence: float = 0.95, method: str = "percentile", sampling_method: str = "multinomial", seed: int = 208):
        if method not in METHODS:
            raise ValueError(f"`method` must be one of {METHODS}")
        if sampling_method not in SAMPLERS:
            raise ValueError(f"`sampling_method` must be one of {SAMPLERS}")
        self.iterations, self.confidence, self.method, self.sampling_method, self.seed = iterations, confidence, method, sampling_method, seed
        self.alpha = (1 - confidence) / 2

    def replicates(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` for each iteration, with columns ``iter`` and ``k`` (how often the row was drawn).

        Poisson: rows that were not drawn keep k = 0; a filter would be pushed below the
        draw and repeat it. Multinomial: n draws for each iteration of the rows
        numbered by key, and only drawn rows are kept. Each row finds its own draws (``draws_of``), so that no draw is shuffled;
        few draws are counted and joined instead, as finding them costs 2^32 steps at least. Rows are counted when this is called.
        """
        it = F.explode(F.sequence(F.lit(0), F.lit(self.iterations - 1))).alias("iter")
        if self.sampling_method == "poisson":
            u = with_hash_uniform(df.select("*", it), "__u", self.seed, F.col(key), F.col("iter"))
            return u.withColumn("k", poisson_draw(F.col("__u")).cast("double")).drop("__u")
        n = df.count()
        if n >= FOUND_ROWS and n * self.iterations >= FOUND_DRAWS:
            bits = draw_bits(self.iterations)
            found = self._numbered(df, key, min(SLICES, max(PARTS, n // PART_ROWS))).withColumn("__code", _found(self.seed, n, self.iterations)("__row")).drop("__row")
            code = F.col("__code")
            each = found.select(*df.columns, F.explode("__code").alias("__code"))
            return each.select(*df.columns, F.shiftright(code, bits).cast("double").alias("k"), code.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int").alias("iter"))
        draws = with_hash_uniform(df.sparkSession.range(n).select(F.col("id").alias("__row"), it), "__u", self.seed, F.col("__row"), F.col("iter"))
        draws = draws.select(F.col("iter").alias("__it"), F.floor(F.col("__u") * F.lit(n)).cast("long").alias("__pick"))
        drawn = draws.groupBy("__it", "__pick").agg(F.count("*").cast("double").alias("k"))
        return self._numbered(df, key).join(drawn, F.col("__row") == F.col("__pick")).withColumn("iter", F.col("__it")).drop("__row", "__pick", "__it")

    def _numbered(self, df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
        """Adds ``__row``: 0, 1, ... in the order of key. Slices of the keys are dealt over ``parts`` tasks, as what follows is much more work than its bytes."""
        placed = with_slices(df, key, out="__axis")
        before = Window.orderBy("__axis").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
        sizes = placed.groupBy("__axis").agg(F.count("*").alias("__size"))
        starts = sizes.select(F.col("__axis").alias("__at"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
        dealt = placed if parts is None else placed.repartition(parts, "__axis")
        at = dealt.withColumn("__nth", F.row_number().over(Window.partitionBy("__axis").orderBy(key)))
        return at.join(F.broadcast(starts), F.col("__axis") == F.col("__at")).select(*df.columns, (F.col("__start") + F.col("__nth") - 1).cast("long").alias("__row"))

    def _interval(self, reps: DataFrame, point: DataFrame, by: By, jack: DataFrame | None) -> DataFrame:
        reps = reps.filter(F.col("value").isNotNull() & ~F.isnan("value"))
        if self.method == "standard":
            return standard_interval(reps, point, self.alpha, by)
        if self.method == "percentile":
            return percentile_interval(reps, point, self.alpha, by)
        if self.method == "basic":
            return basic_interval(reps, point, self.alpha, by)
        return bca_interval(reps, point, jack, self.alpha, by)

    def _metric(self, rows: DataFrame, key: str, metric: Callable[..., DataFrame], name: str, jack: Callable[[], DataFrame]) -> DataFrame:
        """``rows``: key, w and what the metric reads; metric(df, weight=, by=) gives column ``name``."""
        reps = metric(self.replicates(rows, key).withColumn("w", F.coalesce("w", F.lit(0.0)) * F.col("k")), weight="w", by="iter")
        point = metric(rows, weight="w", by=None)
        return self._interval(reps.select(F.col(name).alias("value")), point.select(F.col(name).alias("point")), None, jack() if self.method == "BCa" else None)

    def _steps(self, rows: DataFrame, descending: bool) -> tuple[DataFrame, DataFrame]:
        """Distinct scores (s, p, n, cum_p, cum_n), each once for each distinct weight ``lw``, with totals; and cells (s, y, w, times).

        Leaving out a row changes all steps from its score on in the same way for equal weights, so prefix sums for each weight give all
        leave-one-out values.
        """
        weights = [r["w"] for r in rows.select("w").distinct().limit(JACKKNIFE_WEIGHTS + 1).collect()]
        if len(weights) > JACKKNIFE_WEIGHTS:
            raise NotImplementedError(f"BCa of this metric is offered for at most {JACKKNIFE_WEIGHTS} distinct weights")
        cells = rows.groupBy("s").agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum(F.col("w") * (1 - F.col("y"))).alias("n"))
        cum = running(with_slices(cells, "s"), "s", ["p", "n"], descending=descending, slices="__slice")
        totals = cells.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
        steps = cum.crossJoin(F.broadcast(totals)).withColumn("lw", F.explode(F.array(*(F.lit(float(w)) for w in sorted(weights)))) if weights else F.lit(0.0))
        return steps, rows.groupBy("s", "y", "w").agg(F.count("*").cast("double").alias("times"))

    def _at_cells(self, cells: DataFrame, steps: DataFrame) -> DataFrame:
        """The step of each cell for its own weight."""
        renamed = steps.withColumnRenamed("s", "at")
        return cells.join(renamed, (F.col("s") == F.col("at")) & (F.col("w") == F.col("lw")))

    def _ap_jackknife(self, rows: DataFrame) -> DataFrame:
        steps, cells = self._steps(rows, descending=True)
        cp, cn, p, lw = F.col("cum_p"), F.col("cum_n"), F.col("p"), F.col("lw")
        part = lambda x, up, down: F.coalesce(x * F.try_divide(up, down), F.lit(0.0))
        # Steps from a row's score down change: without a negative (f_n), without a positive (f_p); the others stay (f).
        steps = steps.withColumns({"f": part(p, cp, cp + cn), "f_n": part(p, cp, cp + cn - lw), "f_p": part(p, cp - lw, cp + cn - lw)})
        sums = running(steps, "s", ["f", "f_n", "f_p"], "lw", descending=True, slices="__slice")
        ends = sums.groupBy("lw").agg(*(F.sum(c).alias(f"all_{c}") for c in ("f_n", "f_p"))).withColumnRenamed("lw", "__lw")
        sums = sums.join(F.broadcast(ends), F.col("lw") == F.col("__lw"))
        x = self._at_cells(cells, sums)
        before = F.col("cum_f") - F.col("f")
        from_here = lambda c: F.col(f"all_{c}") - F.col(f"cum_{c}") + F.col(c)
        own = part(F.col("w"), cp - lw, cp + cn - lw)  # the row's own gain at its step
        value = F.when(F.col("y") == 1, sdiv(before + from_here("f_p") - own, F.col("all_p") - F.col("w"))).otherwise(sdiv(before + from_here("f_n"), F.col("all_p")))
        return x.select(value.alias("value"), "times").filter("value IS NOT NULL")

    def _ks_jackknife(self, rows: DataFrame) -> DataFrame:
        steps, cells = self._steps(rows, descending=False)
        cp, cn, ap, an, lw = (F.col(c) for c in ("cum_p", "cum_n", "all_p", "all_n", "lw"))
        gap = lambda a, b, c, d: F.coalesce(F.abs(sdiv(a, b) - sdiv(c, d)), F.lit(0.0))
        # The distance at a step below a row that is left out (b), and from it on (a), by the row's class.
        steps = steps.withColumns({"bp": gap(cp, ap - lw, cn, an), "ap": gap(cp - lw, ap - lw, cn, an), "bn": gap(cp, ap, cn, an - lw), "an": gap(cp, ap, cn - lw, an - lw)})
        low = running(steps, "s", ["bp", "bn"], "lw", slices="__slice", largest=True)
        high = running(low, "s", ["ap", "an"], "lw", descending=True, slices="__slice", largest=True)
        # Below a step: the maximum up to it without the step itself, which is the one of the step before; both classes at once.
        x = self._at_cells(cells, high)
        prior = running_before(high, ["cum_bp", "cum_bn"])
        x = x.join(prior.select(F.col("s").alias("s0"), F.col("lw").alias("lw0"), "prior_cum_bp", "prior_cum_bn"), (F.col("s") == F.col("s0")) & (F.col("w") == F.col("lw0")))
        one = lambda c: F.greatest(f"cum_a{c}", f"prior_cum_b{c}")
        left = F.when(F.col("y") == 1, F.col("all_p") - F.col("w")).otherwise(F.col("all_n") - F.col("w"))
        value = F.when(left > 0, F.when(F.col("y") == 1, one("p")).otherwise(one("n")))
        return x.select(value.alias("value"), "times").filter("value IS NOT NULL")

    def _air_jackknife(self, rows: DataFrame) -> DataFrame:
        w = F.col("w")
        parts = {"ya": w * F.col("y") * F.col("a"), "a_all": w * F.col("a"), "yb": w * F.col("y") * F.col("b"), "b_all": w * F.col("b")}
        cells = rows.withColumns({f"x_{k}": e for k, e in parts.items()}).groupBy(*(f"x_{k}" for k in parts)).agg(F.count("*").cast("double").alias("times"))
        t = cells.agg(*(F.sum(F.col(f"x_{k}") * F.col("times")).alias(f"t_{k}") for k in parts))
        left = lambda k: F.col(f"t_{k}") - F.col(f"x_{k}")
        value = sdiv(sdiv(left("ya"), left("a_all")), sdiv(left("yb"), left("b_all")))
        return cells.crossJoin(F.broadcast(t)).select(value.alias("value"), "times")

    def _moments(self, rows: DataFrame, value: Column, out: Callable[[Column], Column] = lambda c: c) -> DataFrame:
        """Leave-one-out weighted means, in closed form."""
        v = rows.withColumn("v", value)
        t = v.agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("sw"))
        return v.crossJoin(F.broadcast(t)).select(out(sdiv(F.col("s") - F.col("v") * F.col("w"), F.col("sw") - F.col("w"))).alias("value"), F.lit(1.0).alias("times"))

    def confusion_matrix(self, df: DataFrame, key: str, y_true: str, y_pred: str, beta: float = 1.0, weight: str | None = None) -> DataFrame:
        """(metric, lower, point, upper) for the 27 measures."""
        rows = coerce(df, key, weight, y=truth(y_true), p=truth(y_pred))
        long = lambda d, by: M.to_long(M.confusion_matrix(d, "y", "p", beta, "w", by), by)
        reps = long(self.replicates(rows, key).withColumn("w", F.coalesce("w", F.lit(0.0)) * F.col("k")), "iter").select("metric", "value")
        point = long(rows, None).withColumnRenamed("value", "point")
        jack = None
        if self.method == "BCa":
            cells = rows.groupBy("y", "p", "w").agg(F.count("*").cast("double").alias("times"))
            is_ = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
            mine = {k: F.when((F.col("y") == y) & (F.col("p") == p), F.col("w")).otherwise(0.0) for k, (y, p) in is_.items()}
            totals = cells.agg(*(F.sum(e * F.col("times")).alias(f"all_{k}") for k, e in mine.items()))
            left = cells.crossJoin(F.broadcast(totals)).select("times", *((F.col(f"all_{k}") - e).alias(k) for k, e in mine.items()))
            jack = M.to_long(M.derive(left, beta).select("times", *M.CONFUSION), "times").filter("value IS NOT NULL")
        return self._interval(reps, point, "metric", jack)

    def _swept(self, rows: DataFrame, key: str, thresholds: Sequence[float] | None, sweep: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Values of all replicates and of the rows themselves. For all scores, each replicate has every score, also those it did not draw."""
        if thresholds is None:
            rows = with_slices(rows, "s")
        reps = self.replicates(rows, key).withColumn("w", F.coalesce("w", F.lit(0.0)) * F.col("k"))
        if thresholds is None and self.sampling_method == "multinomial":
            it = F.explode(F.sequence(F.lit(0), F.lit(self.iterations - 1))).alias("iter")
            labels = [c for c in rows.columns if c not in (key, "s", "__slice", "w")]
            every = rows.select("s", "__slice").distinct().select("s", "__slice", it).select("iter", "s", "__slice", *(F.lit(0.0).alias(c) for c in labels), F.lit(0.0).alias("w"))
            reps = reps.select("iter", "s", "__slice", *labels, "w").unionByName(every)
        return sweep(reps, "iter").drop("iter"), sweep(rows, None).withColumnRenamed("value", "point")

    def confusion_matrix_at_thresholds(self, df: DataFrame, key: str, y_true: str, y_score: str, thresholds: Sequence[float] | None = None, metrics: Sequence[str] = M.CONFUSION, beta: float = 1.0, weight: str | None = None, strategy: str = "auto") -> DataFrame:
        """(threshold, metric, lower, point, upper); all scores are thresholds if none are given.

        BCa is offered for given thresholds, whose bins' rows are alike, so that each bin, label and weight is left out once.
        """
        rows = coerce(df, key, weight, y=truth(y_true), s=number(y_score))
        sweep = lambda d, by: M.confusion_matrix_at_thresholds(d, "y", "s", thresholds, metrics, strategy, beta, "w", by, "__slice" if thresholds is None else M.SLICES)
        reps, point = self._swept(rows, key, thresholds, sweep)
        jack = None
        if self.method == "BCa":
            parts = {"tn": ("lt", 0), "fp": ("ge", 0), "fn": ("lt", 1), "tp": ("ge", 1)}
            left = self._bins(rows, ("y",), thresholds, {k: (side, F.col("y") == y) for k, (side, y) in parts.items()})
            jack = M.to_long(M.derive(left, beta).select("threshold", "times", *metrics), ["threshold", "times"], list(metrics)).filter("value IS NOT NULL")
        return self._interval(reps, point, ["threshold", "metric"], jack)

    def _bins(self, rows: DataFrame, labels: Sequence[str], thresholds: Sequence[float] | None, parts: dict[str, tuple[str, Column]]) -> DataFrame:
        """(threshold, times, parts): sums without one row of each bin, label and weight, for each threshold.

        ``parts``: on which side of a threshold, and by which condition on labels, a row counts.
        """
        if thresholds is None:
            raise NotImplementedError("BCa at all scores is not offered; give thresholds")
        cuts = sorted({float(t) for t in thresholds})
        cells = M.bin_index(rows, "s", cuts, "b").groupBy(*labels, "b", "w").agg(F.count("*").cast("double").alias("times"))
        each = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)))).alias("t")
        spread = cells.select("*", each).select(*cells.columns, "t.*")
        mine = {k: F.when((F.col("b") >= F.col("i") if side == "ge" else F.col("b") < F.col("i")) & cond, F.col("w")).otherwise(0.0) for k, (side, cond) in parts.items()}
        totals = spread.groupBy("i").agg(*(F.sum(e * F.col("times")).alias(f"all_{k}") for k, e in mine.items())).withColumnRenamed("i", "j")
        return spread.join(F.broadcast(totals), F.col("i") == F.col("j")).select("threshold", "times", *((F.col(f"all_{k}") - e).alias(k) for k, e in mine.items()))

    def roc_auc(self, df: DataFrame, key: str, y_true: str, y_score: str, weight: str | None = None) -> DataFrame:
        """One row. BCa's leave-one-out values are in closed form: a row's own pairs are taken from the sum of pairs."""
        rows = coerce(df, key, weight, y=truth(y_true), s=number(y_score))
        return self._metric(with_slices(rows, "s"), key, lambda d, weight, by: M.roc_auc(d, "y", "s", weight, by, "__slice"), "roc_auc", lambda: self._auc_jackknife(rows))

    def _auc_jackknife(self, rows: DataFrame) -> DataFrame:
        cells = rows.groupBy("s").agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum(F.col("w") * (1 - F.col("y"))).alias("n"))
        cum = running(cells, "s", ["p", "n"])
        t = cum.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.sum(F.col("p") * (F.col("cum_n") - F.col("n") / 2)).alias("won"))
        each = rows.groupBy("s", "y", "w").agg(F.count("*").cast("double").alias("times"))
        x = each.join(cum.withColumnRenamed("s", "at"), F.col("s") == F.col("at")).crossJoin(F.broadcast(t))
        below, above = F.col("cum_n") - F.col("n") / 2, F.col("all_p") - F.col("cum_p") + F.col("p") / 2
        value = F.when(F.col("y") == 1, sdiv(F.col("won") - F.col("w") * below, (F.col("all_p") - F.col("w")) * F.col("all_n"))).otherwise(sdiv(F.col("won") - F.col("w") * above, F.col("all_p") * (F.col("all_n") - F.col("w"))))
        return x.select(value.alias("value"), "times").filter("value IS NOT NULL")

    def average_precision(self, df: DataFrame, key: str, y_true: str, y_score: str, weight: str | None = None) -> DataFrame:
        rows = coerce(df, key, weight, y=truth(y_true), s=number(y_score))
        metric = lambda d, weight, by: M.average_precision(d, "y", "s", weight, by, "__slice")
        return self._metric(with_slices(rows, "s"), key, metric, "average_precision", lambda: self._ap_jackknife(rows))

    def max_ks(self, df: DataFrame, key: str, y_true: str, y_score: str, weight: str | None = None) -> DataFrame:
        rows = coerce(df, key, weight, y=truth(y_true), s=number(y_score))
        metric = lambda d, weight, by: M.max_ks(d, "y", "s", weight, by, "__slice")
        return self._metric(with_slices(rows, "s"), key, metric, "max_ks", lambda: self._ks_jackknife(rows))

    def brier_loss(self, df: DataFrame, key: str, y_true: str, y_score: str, weight: str | None = None) -> DataFrame:
        d = truth(y_true) - number(y_score)
        return self._mean_of(df, key, d * d, weight)

    def mean(self, df: DataFrame, key: str, y: str, weight: str | None = None) -> DataFrame:
        return self._mean_of(df, key, number(y), weight)

    def mean_squared_error(self, df: DataFrame, key: str, y_true: str, y_score: str, weight: str | None = None) -> DataFrame:
        d = number(y_true) - number(y_score)
        return self._mean_of(df, key, d * d, weight)

    def root_mean_squared_error(self, df: DataFrame, key: str, y_true: str, y_score: str, weight: str | None = None) -> DataFrame:
        d = number(y_true) - number(y_score)
        return self._mean_of(df, key, d * d, weight, F.sqrt)

    def _mean_of(self, df: DataFrame, key: str, value: Column, weight: str | None, out: Callable[[Column], Column] = lambda c: c) -> DataFrame:
        rows = coerce(df, key, weight, v=value)
        metric = lambda d, weight, by: M.mean(d, "v", weight, by).withColumn("mean", out(F.col("mean")))
        return self._metric(rows, key, metric, "mean", lambda: self._moments(rows, F.col("v"), out))

    def r2(self, df: DataFrame, key: str, y_true: str, y_score: str, weight: str | None = None) -> DataFrame:
        rows = coerce(df, key, weight, y=number(y_true), s=number(y_score))

        def jack() -> DataFrame:
            w, y, e = F.col("w"), F.col("y"), (F.col("y") - F.col("s")) * (F.col("y") - F.col("s"))
            t = rows.agg(F.sum("w").alias("all_w"), F.sum(w * y).alias("all_y"), F.sum(w * y * y).alias("all_yy"), F.sum(w * e).alias("all_e"))
            left = F.col("all_y") - w * y
            deviations = F.col("all_yy") - w * y * y - sdiv(left * left, F.col("all_w") - w)
            return rows.crossJoin(F.broadcast(t)).select((1 - sdiv(F.col("all_e") - w * e, deviations)).alias("value"), F.lit(1.0).alias("times"))

        return self._metric(rows, key, lambda d, weight, by: M.r2(d, "y", "s", weight, by), "r2", jack)

    def adverse_impact_ratio(self, df: DataFrame, key: str, y_pred: str, protected: str, control: str, weight: str | None = None) -> DataFrame:
        rows = coerce(df, key, weight, y=truth(y_pred), a=truth(protected), b=truth(control))
        metric = lambda d, weight, by: M.adverse_impact_ratio(d, "y", "a", "b", weight, by)
        return self._metric(rows, key, metric, "air", lambda: self._air_jackknife(rows))

    def adverse_impact_ratio_at_thresholds(self, df: DataFrame, key: str, y_score: str, protected: str, control: str, thresholds: Sequence[float] | None = None, weight: str | None = None, strategy: str = "auto") -> DataFrame:
        """(threshold, lower, point, upper); all scores are thresholds if none are given. BCa is offered for given thresholds."""
        rows = coerce(df, key, weight, s=number(y_score), a=truth(protected), b_=truth(control))
        sweep = lambda d, by: M.adverse_impact_ratio_at_thresholds(d, "s", "a", "b_", thresholds, "w", strategy, by, "__slice" if thresholds is None else M.SLICES).withColumnRenamed("air", "value")
        reps, point = self._swept(rows, key, thresholds, sweep)
        jack = None
        if self.method == "BCa":
            left = self._bins(rows, ("a", "b_"), thresholds, {f"{side}_{g}": (side, F.col(g) == 1) for side in ("lt", "ge") for g in ("a", "b_")})
            rate = lambda g: sdiv(F.col(f"lt_{g}"), F.col(f"lt_{g}") + F.col(f"ge_{g}"))
            jack = left.select("threshold", "times", sdiv(rate("a"), rate("b_")).alias("value")).filter("value IS NOT NULL")
        return self._interval(reps, point, "threshold", jack)

    def run(self, df: DataFrame, key: str, stat: Callable, as_expression: bool = False) -> DataFrame:
        """Interval of any statistic.

        ``as_expression``: stat(weight) gives an aggregate Column over ``df`` that honours
        the weight column's name, and stays in the JVM. Otherwise stat takes a pandas frame
        of one replicate, with drawn rows repeated, and gives a float; a replicate then
        has to fit in one task's memory. BCa needs the statistic without each row. Arithmetic of sums, means and counts takes a row's own part off
        the totals; any other statistic is evaluated once without each row, over rows x rows.
        """
        reps = self.replicates(df, key)
        cols = df.columns

        def one(pdf):  # noqa: ANN001, ANN202
            import pandas as pd

            drawn = pdf.loc[pdf.index.repeat(pdf["k"].astype(int)), cols].reset_index(drop=True)
            return pd.DataFrame({"value": [float(stat(drawn))]})

        def evaluate(weighted: DataFrame) -> DataFrame:
            if as_expression:
                return weighted.groupBy("iter").agg(stat("k").cast("double").alias("value")).select("value")
            return weighted.groupBy("iter").applyInPandas(one, "value double")

        point = evaluate(df.withColumns({"k": F.lit(1.0), "iter": F.lit(0)})).withColumnRenamed("value", "point")
        return self._interval(evaluate(reps).select("value"), point, None, self._without_each(df, key, evaluate, stat("k") if as_expression else None) if self.method == "BCa" else None)

    def _without_each(self, df: DataFrame, key: str, evaluate: Callable[[DataFrame], DataFrame], stat: Column | None) -> DataFrame:
        usable = "value IS NOT NULL AND NOT isnan(value)"
        if stat is not None and (apart := taken_apart(df, stat)) is not None:
            return self._off_totals(df, *apart).filter(usable)
        ids = df.select(F.col(key).alias("iter"))
        pairs = df.crossJoin(ids).withColumn("k", (F.col(key) != F.col("iter")).cast("double"))
        return evaluate(pairs if ids.limit(2).count() > 1 else pairs.filter(F.lit(False))).withColumn("times", F.lit(1.0)).filter(usable)

    def _off_totals(self, df: DataFrame, args: list[Column], whole: Callable[[Callable[[int, str], Column]], Column]) -> DataFrame:
        """(value, times) without each row: totals, less what the row adds with weight 1, plus what it adds with weight 0.

        Infinite values and NaN are counted apart, as they can't be taken off a sum.
        """
        inf = float("inf")
        own = df
        for side, weight in (("o", 1.0), ("z", 0.0)):
            own = own.withColumn("k", F.lit(weight)).withColumns({f"__{side}{i}": a.cast("double") for i, a in enumerate(args)})
        finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < inf), x).otherwise(0.0)
        kinds = {"sum": finite, "some": lambda x: x.isNotNull().cast("double"), "up": lambda x: (x == inf).cast("double"), "down": lambda x: (x == -inf).cast("double"), "nan": lambda x: F.isnan(x).cast("double")}
        part = lambda side, i, k: F.coalesce(kinds[k](F.col(f"__{side}{i}")), F.lit(0.0))
        each = [(i, k) for i in range(len(args)) for k in kinds]
        totals = own.agg(F.count("*").alias("__n"), *(F.sum(part("o", i, k)).alias(f"__t_{k}{i}") for i, k in each))
        left = own.select(*(c for i in range(len(args)) for c in (f"__o{i}", f"__z{i}"))).crossJoin(F.broadcast(totals)).filter("__n > 1")
        left = left.select(*(F.col(f"__t_{k}{i}") - part("o", i, k) + part("z", i, k) for i, k in each)).toDF(*(f"{k}{i}" for i, k in each))

        def of(i: int, name: str) -> Column:
            some, up, down = (F.col(f"{k}{i}") > 0 for k in ("some", "up", "down"))
            total = F.when((F.col(f"nan{i}") > 0) | (up & down), float("nan")).when(up, inf).when(down, -inf).when(some, F.col(f"sum{i}"))
            return F.col(f"some{i}") if name == "count" else total / F.nullif(F.col(f"some{i}"), F.lit(0.0)) if name == "avg" else total

        return left.select(whole(of).cast("double").alias("value"), F.lit(1.0).alias("times"))


__all__ = ["Bootstrap", "METHODS", "SAMPLERS", "acceleration", "basic_interval", "bca_interval", "percentile_interval", "standard_interval"]
