"""Metrics of classification, ranking, regression and fairness, and sweeps over thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import By, coerce, groups, join_groups, number, sdiv, truth
from ..plans.prefix import SLICES, at_thresholds, bin_index, running, with_slices
from ..plans.prefix import quantiles as exact_quantiles

#: Fixed names, in the order of output.
CONFUSION = (
    "tn fp fn tp tpr fpr fnr tnr prevalence prevalence_threshold informedness precision false_omission_rate plr nlr acc "
    "balanced_accuracy fbeta folkes_mallows_index mcc threat_score markedness fdr npv dor ppr pnr"
).split()
STRATEGIES = ("auto", "loop", "cum_sum")
#: From this many thresholds on, "auto" bins scores and sums bins instead of summing for each threshold.
FEW_THRESHOLDS = 10


def derive(df: DataFrame, beta: float = 1.0) -> DataFrame:
    """Adds the 23 measures that follow from columns tn, fp, fn and tp; undefined ones are NULL."""
    c = F.col
    p, n, b2 = c("tp") + c("fn"), c("fp") + c("tn"), beta * beta
    # One select: later columns refer to earlier ones by name.
    return df.select("*", *(e.alias(k) for k, e in {
        "tpr": sdiv(c("tp"), p), "fpr": sdiv(c("fp"), n), "prevalence": sdiv(p, p + n), "precision": sdiv(c("tp"), c("tp") + c("fp")),
        "false_omission_rate": sdiv(c("fn"), c("fn") + c("tn")), "acc": sdiv(c("tp") + c("tn"), p + n),
        "threat_score": sdiv(c("tp"), c("tp") + c("fn") + c("fp")), "ppr": sdiv(c("tp") + c("fp"), p + n), "pnr": sdiv(c("tn") + c("fn"), p + n),
        "fnr": 1 - c("tpr"), "tnr": 1 - c("fpr"), "fdr": 1 - c("precision"), "npv": 1 - c("false_omission_rate"),
        "prevalence_threshold": sdiv(F.sqrt(c("tpr") * c("fpr")) - c("fpr"), c("tpr") - c("fpr")),
        "informedness": c("tpr") + c("tnr") - 1, "plr": sdiv(c("tpr"), c("fpr")), "nlr": sdiv(c("fnr"), c("tnr")),
        "balanced_accuracy": (c("tpr") + c("tnr")) / 2, "fbeta": sdiv((1 + b2) * c("precision") * c("tpr"), b2 * c("precision") + c("tpr")),
        "folkes_mallows_index": F.sqrt(c("precision") * c("tpr")), "markedness": c("precision") - c("false_omission_rate"),
        "mcc": F.sqrt(c("tpr") * c("tnr") * c("precision") * c("npv")) - F.sqrt(c("fnr") * c("fpr") * c("false_omission_rate") * c("fdr")),
        "dor": sdiv(c("plr"), c("nlr")),
    }.items()))


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str, beta: float = 1.0, weight: str | None = None, by: By = None) -> DataFrame:
    """(by, 27 measures): weighted counts in one aggregation, then ratios."""
    rows = coerce(df, by, weight, y=truth(y_true), p=truth(y_pred))
    cell = lambda y, p: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("p") == p), F.col("w"))), F.lit(0.0))
    out = rows.groupBy(*groups(by)).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    return derive(out, beta).select(*groups(by), *CONFUSION)


def to_long(df: DataFrame, by: By = None, metrics: Sequence[str] = CONFUSION) -> DataFrame:
    """(by, metric, value) from one column for each metric."""
    return df.unpivot(groups(by), list(metrics), "metric", "value")


def _cells(df: DataFrame, y_true: str, y_score: str, weight: str | None, by: By, slices: int | str | None = None) -> DataFrame:
    """(by, s, p, n): weights of positives and negatives for each distinct score, so that ties are one step. A column of slices is kept."""
    keys = _with_slice(by, slices)
    rows = coerce(df, keys, weight, y=truth(y_true), s=number(y_score))
    return rows.groupBy(*keys, "s").agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum(F.col("w") * (1 - F.col("y"))).alias("n"))


def roc_auc(df: DataFrame, y_true: str, y_score: str, weight: str | None = None, by: By = None, slices: int | str | None = SLICES) -> DataFrame:
    """(by, roc_auc): the share of positive-negative pairs in the right order, ties counting half. NULL with one class only."""
    keys = groups(by)
    cells = _cells(df, y_true, y_score, weight, by, slices)
    won = F.sum(F.col("p") * (F.col("cum_n") - F.col("n") / 2))
    if slices is None:
        return running(cells, "s", ["n"], by, slices=None).groupBy(*keys).agg(sdiv(won, F.sum("p") * F.sum("n")).alias("roc_auc"))
    # Pairs within a slice are counted there; a slice's positives win against all negatives of the slices before.
    at = slices if isinstance(slices, str) else "__slice"
    placed = cells if isinstance(slices, str) else with_slices(cells, "s", by, slices)
    parts = running(placed, "s", ["n"], [*keys, at], slices=None).groupBy(*keys, at).agg(won.alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return parts.withColumn("won", F.col("won") + F.col("p") * before).groupBy(*keys).agg(sdiv(F.sum("won"), F.sum("p") * F.sum("n")).alias("roc_auc"))


def max_ks(df: DataFrame, y_true: str, y_score: str, weight: str | None = None, by: By = None, slices: int | str | None = SLICES) -> DataFrame:
    """(by, max_ks): largest distance of the score distributions of both classes. NULL with one class only."""
    cells = _cells(df, y_true, y_score, weight, by, slices)
    totals = cells.groupBy(*groups(by)).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    steps = join_groups(running(cells, "s", ["p", "n"], by, slices=slices), totals, by)
    gap = F.abs(sdiv(F.col("cum_p"), F.col("all_p")) - sdiv(F.col("cum_n"), F.col("all_n")))
    return steps.groupBy(*groups(by)).agg(F.max(gap).alias("max_ks"))


def average_precision(df: DataFrame, y_true: str, y_score: str, weight: str | None = None, by: By = None, slices: int | str | None = SLICES) -> DataFrame:
    """(by, average_precision): precision at each distinct score, weighted by the recall gained there."""
    steps = running(_cells(df, y_true, y_score, weight, by, slices), "s", ["p", "n"], by, descending=True, slices=slices)
    gained = F.sum(F.col("p") * F.coalesce(sdiv(F.col("cum_p"), F.col("cum_p") + F.col("cum_n")), F.lit(0.0)))
    return steps.groupBy(*groups(by)).agg(sdiv(gained, F.sum("p")).alias("average_precision"))


def mean(df: DataFrame, y: str, weight: str | None = None, by: By = None) -> DataFrame:
    """(by, mean)."""
    return _weighted(df, number(y), "mean", weight, by)


def _weighted(df: DataFrame, value: Column, name: str, weight: str | None, by: By) -> DataFrame:
    rows = coerce(df, by, weight, v=value)
    return rows.groupBy(*groups(by)).agg(sdiv(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias(name))


def _squared(y_true: str, y_score: str) -> Column:
    d = number(y_true) - number(y_score)
    return d * d


def brier_loss(df: DataFrame, y_true: str, y_score: str, weight: str | None = None, by: By = None) -> DataFrame:
    """(by, brier_loss): mean squared distance of scores and 0/1 labels."""
    d = truth(y_true) - number(y_score)
    return _weighted(df, d * d, "brier_loss", weight, by)


def mean_squared_error(df: DataFrame, y_true: str, y_score: str, weight: str | None = None, by: By = None) -> DataFrame:
    """(by, mean_squared_error)."""
    return _weighted(df, _squared(y_true, y_score), "mean_squared_error", weight, by)


def root_mean_squared_error(df: DataFrame, y_true: str, y_score: str, weight: str | None = None, by: By = None) -> DataFrame:
    """(by, root_mean_squared_error)."""
    out = _weighted(df, _squared(y_true, y_score), "root_mean_squared_error", weight, by)
    return out.withColumn("root_mean_squared_error", F.sqrt("root_mean_squared_error"))


def r2(df: DataFrame, y_true: str, y_score: str, weight: str | None = None, by: By = None) -> DataFrame:
    """(by, r2): 1 - squared residuals over squared deviations, in one pass; NULL for a constant y."""
    rows = coerce(df, by, weight, y=number(y_true), s=number(y_score))
    w, y = F.col("w"), F.col("y")
    if weight is None:
        deviations = F.var_pop("y") * F.count("*")
    else:
        deviations = F.sum(w * y * y) - sdiv(F.sum(w * y) * F.sum(w * y), F.sum("w"))
    return rows.groupBy(*groups(by)).agg((1 - sdiv(F.sum(w * (y - F.col("s")) * (y - F.col("s"))), deviations)).alias("r2"))


def adverse_impact_ratio(df: DataFrame, y_pred: str, protected: str, control: str, weight: str | None = None, by: By = None) -> DataFrame:
    """(by, air): approval rate of the protected group over that of the control group. Rows with any null are dropped."""
    rows = coerce(df, by, weight, y=truth(y_pred), a=truth(protected), b=truth(control))
    rate = lambda g: sdiv(F.sum(F.col("w") * F.col(g) * F.col("y")), F.sum(F.col("w") * F.col(g)))
    return rows.groupBy(*groups(by)).agg(sdiv(rate("a"), rate("b")).alias("air"))


def _strategy(thresholds: Sequence[float] | None, strategy: str) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"`strategy` must be one of {STRATEGIES}")
    if thresholds is None:
        return "cum_sum"
    return ("loop" if len(thresholds) < FEW_THRESHOLDS else "cum_sum") if strategy == "auto" else strategy


def _with_slice(by: By, slices: int | str | None) -> list[str]:
    return [*groups(by), *([slices] if isinstance(slices, str) else [])]


def _sweep(rows: DataFrame, sums: dict[str, Column], thresholds: Sequence[float] | None, strategy: str, by: By, slices: int | str | None) -> DataFrame:
    """(by, threshold, ge_<c>, lt_<c>) for given thresholds or for all scores ``s``.

    Few thresholds: one conditional sum for each in one aggregation without a
    sort. More: binned sums. All scores: prefix sums along the score axis.
    """
    keys = groups(by)
    kind = _strategy(thresholds, strategy)
    if thresholds is None:
        cells = rows.groupBy(*_with_slice(by, slices), "s").agg(*(F.sum(e).alias(c) for c, e in sums.items()))
        up = running(cells, "s", list(sums), by, descending=True, slices=slices)
        totals = cells.groupBy(*keys).agg(*(F.sum(c).alias(f"all_{c}") for c in sums))
        joined = join_groups(up, totals, by)
        return joined.select(*keys, F.col("s").alias("threshold"), *(F.col(f"cum_{c}").alias(f"ge_{c}") for c in sums), *((F.col(f"all_{c}") - F.col(f"cum_{c}")).alias(f"lt_{c}") for c in sums))
    if kind == "cum_sum":
        return at_thresholds(rows, "s", sums, thresholds, by)
    cuts = sorted({float(t) for t in thresholds})
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    aggs = [zero(F.sum(F.when(F.col("s") >= t, e))).alias(f"ge_{c}_{i}") for i, t in enumerate(cuts) for c, e in sums.items()]
    aggs += [zero(F.sum(F.when(F.col("s") < t, e))).alias(f"lt_{c}_{i}") for i, t in enumerate(cuts) for c, e in sums.items()]
    wide = rows.groupBy(*keys).agg(*aggs)
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), *(F.col(f"{side}_{c}_{i}").alias(f"{side}_{c}") for side in ("ge", "lt") for c in sums)) for i, t in enumerate(cuts))))
    return wide.select(*keys, each.alias("x")).select(*keys, "x.*")


def confusion_matrix_at_thresholds(
    df: DataFrame, y_true: str, y_score: str, thresholds: Sequence[float] | None = None, metrics: Sequence[str] = CONFUSION, strategy: str = "auto",
    beta: float = 1.0, weight: str | None = None, by: By = None, slices: int | str | None = SLICES, wide: bool = False,
) -> DataFrame:
    """(by, threshold, metric, value): the measures with score >= threshold as the prediction.

    Thresholds are distinct; None takes all scores. The definition is the same under every strategy, also above
    the largest score. ``wide`` keeps a column for each metric.
    """
    rows = coerce(df, _with_slice(by, slices), weight, y=truth(y_true), s=number(y_score))
    swept = _sweep(rows, {"p": F.col("w") * F.col("y"), "n": F.col("w") * (1 - F.col("y"))}, thresholds, strategy, by, slices)
    keys = [*groups(by), "threshold"]
    base = swept.select(*keys, F.col("lt_n").alias("tn"), F.col("ge_n").alias("fp"), F.col("lt_p").alias("fn"), F.col("ge_p").alias("tp"))
    if thresholds is None:  # differences of sums: what is left of a zero is rounded away
        base = base.withColumns({c: F.round(c, 12) for c in ("tn", "fn")})
    out = derive(base, beta).select(*keys, *metrics)
    return out if wide else to_long(out, keys, metrics)


def predicted_positive_ratio_at_thresholds(df: DataFrame, y_score: str, thresholds: Sequence[float] | None = None, weight: str | None = None, strategy: str = "auto", by: By = None, slices: int | str | None = SLICES) -> DataFrame:
    """(by, threshold, ppr): weighted share of rows with score >= threshold."""
    rows = coerce(df, _with_slice(by, slices), weight, s=number(y_score))
    swept = _sweep(rows, {"w": F.col("w")}, thresholds, strategy, by, slices)
    return swept.select(*groups(by), "threshold", sdiv(F.col("ge_w"), F.col("ge_w") + F.col("lt_w")).alias("ppr"))


def adverse_impact_ratio_at_thresholds(df: DataFrame, y_score: str, protected: str, control: str, thresholds: Sequence[float] | None = None, weight: str | None = None, strategy: str = "auto", by: By = None, slices: int | str | None = SLICES) -> DataFrame:
    """(by, threshold, air): adverse impact ratio where a row is approved if its score is below the threshold."""
    rows = coerce(df, _with_slice(by, slices), weight, s=number(y_score), a=truth(protected), b=truth(control))
    swept = _sweep(rows, {g: F.col("w") * F.col(g) for g in ("a", "b")}, thresholds, strategy, by, slices)
    rate = lambda g: sdiv(F.col(f"lt_{g}"), F.col(f"lt_{g}") + F.col(f"ge_{g}"))
    return swept.select(*groups(by), "threshold", sdiv(rate("a"), rate("b")).alias("air"))


def capture_rate_at_quantiles(df: DataFrame, y_true: str, y_score: str, quantiles: int = 10, drop_intermediate: bool = True, raw_quantiles: bool = False, by: By = None) -> DataFrame:
    """(by, quantile, capture_rate): mean label in each right-closed quantile bin of the score, from 1 up.

    Equal edges are one. Without ``drop_intermediate`` also n_pos, n, and
    capture_share, the bin's share of all positives. ``raw_quantiles`` adds the bin's upper
    edge (NULL for the last).
    """
    keys = groups(by)
    rows = coerce(df, by, None, y=truth(y_true), s=number(y_score))
    edges = exact_quantiles(rows, "s", [i / quantiles for i in range(1, quantiles)], "e", by).withColumn("e", F.array_distinct("e"))
    binned = join_groups(rows, edges, by).withColumn("b", F.size(F.filter("e", lambda e: e < F.col("s"))))
    upper = F.get("e", F.col("b"))
    out = binned.groupBy(*keys, "b", upper.alias("upper")).agg(F.sum("y").alias("n_pos"), F.count("*").alias("n"), F.avg("y").alias("capture_rate"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("b")).cast("long")  # one row for each bin
    share = sdiv(F.col("n_pos"), F.sum("n_pos").over(Window.partitionBy(*keys)))
    out = out.select(*keys, rank.alias("quantile"), "upper", "n_pos", "n", "capture_rate", share.alias("capture_share"))
    return out.drop(*([] if raw_quantiles else ["upper"]), *(["n_pos", "n", "capture_share"] if drop_intermediate else []))


__all__ = [n for n, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not n.startswith("_")] + ["CONFUSION", "bin_index"]
