"""Registered queries of the core library and their DuckDB oracles.

Base data: ``events`` with y (purchase or signup), s (value / 500), w (1 to 5), and two groups
of users. Doubles are rounded to 6 digits, as engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import binning, numeric, text_format
from ..operators import bootstrap, correlation, drift, preprocessing, selection
from ..operators import metrics as M
from ..streaming import metrics as streaming
from .prefix import next_at_least

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6

FEW = (0.05, 0.1, 0.25, 0.5, 0.9)
MANY = tuple(i / 100 for i in range(1, 100)) + (1.5,)
SEED = 7
#: Iterations of the registered bootstrap queries.
ITERATIONS = 50


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to so many digits, and minus zero to zero."""

    def one(name: str) -> Column:
        r = F.round(F.col(f"`{name}`"), digits)
        return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(name)

    return df.select(*(one(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def register(name: str, build: Query, oracle: str | None = None, columns: str | None = None, digits: int = DIGITS) -> None:
    """``columns``: the oracle's double columns, which are rounded too."""
    QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir), digits)
    if oracle is not None:
        if columns:
            names = columns.split()
            oracle = f"SELECT * EXCLUDE ({', '.join(names)}), {', '.join(f'CASE WHEN round({c}::DOUBLE, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({c}::DOUBLE, {digits}) END AS {c}' for c in names)} FROM ({oracle})"
        ORACLES[name] = oracle


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").isin("purchase", "signup").alias("y"), (F.col("value") / 500).alias("s"), (F.col("value") >= 50).alias("pred"),
        (1 + F.pmod("user_id", F.lit(5))).cast("double").alias("w"), (F.pmod("user_id", F.lit(3)) == 0).alias("prot"), (F.pmod("user_id", F.lit(3)) == 1).alias("ctrl"),
        (F.col("value") < 50).alias("low"), "event_type",
    )


B = """B AS (SELECT event_id AS id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, value / 500 AS s,
  CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pred, (1 + user_id % 5)::DOUBLE AS w, (user_id % 3 = 0)::INT::DOUBLE AS prot, (user_id % 3 = 1)::INT::DOUBLE AS ctrl,
  (value < 50)::INT::DOUBLE AS low, event_type FROM events)"""


def derive_sql(source: str, keys: str = "", beta: float = 1.0) -> str:
    """The 27 measures from a relation with keys, tn, fp, fn and tp."""
    k = f"{keys}, " if keys else ""
    d = lambda a, b: f"(({a}) / NULLIF({b}, 0))"
    b2 = beta * beta
    return f"""SELECT {k}tn, fp, fn, tp, tpr, fpr, fnr, tnr, prevalence, {d('sqrt(tpr * fpr) - fpr', 'tpr - fpr')} AS prevalence_threshold, tpr + tnr - 1 AS informedness, precision,
      false_omission_rate, {d('tpr', 'fpr')} AS plr, {d('fnr', 'tnr')} AS nlr, acc, (tpr + tnr) / 2 AS balanced_accuracy,
      {d(f'{1 + b2}::DOUBLE * precision * tpr', f'{b2}::DOUBLE * precision + tpr')} AS fbeta, sqrt(precision * tpr) AS folkes_mallows_index,
      sqrt(tpr * tnr * precision * npv) - sqrt(fnr * fpr * false_omission_rate * fdr) AS mcc, threat_score, precision - false_omission_rate AS markedness, fdr, npv,
      {d(d('tpr', 'fpr'), d('fnr', 'tnr'))} AS dor, ppr, pnr
    FROM (SELECT *, 1 - tpr AS fnr, 1 - fpr AS tnr, 1 - precision AS fdr, 1 - false_omission_rate AS npv FROM (
      SELECT *, {d('tp', 'tp + fn')} AS tpr, {d('fp', 'fp + tn')} AS fpr, {d('tp + fn', 'tp + fn + fp + tn')} AS prevalence, {d('tp', 'tp + fp')} AS precision,
        {d('fn', 'fn + tn')} AS false_omission_rate, {d('tp + tn', 'tp + fn + fp + tn')} AS acc, {d('tp', 'tp + fn + fp')} AS threat_score,
        {d('tp + fp', 'tp + fn + fp + tn')} AS ppr, {d('tn + fn', 'tp + fn + fp + tn')} AS pnr FROM ({source})))"""


def cells_sql(pred: str = "pred", w: str = "1.0::DOUBLE", relation: str = "B", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    one = lambda y, p: f"coalesce(sum({w}) FILTER (y = {y} AND {pred} = {p}), 0)"
    return f"SELECT {k}{one(0, 0)} AS tn, {one(0, 1)} AS fp, {one(1, 0)} AS fn, {one(1, 1)} AS tp FROM {relation}" + (f" GROUP BY {keys}" if keys else "")


def long_sql(source: str, metrics: list[str]) -> str:
    return f"SELECT * FROM ({source}) UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(metrics)}))"


ALL = " ".join(M.CONFUSION)
register("confusion_matrix", lambda s, d: M.confusion_matrix(base(s, d), "y", "pred"), f"WITH {B} {derive_sql(cells_sql())}", ALL)
register("confusion_matrix_weighted", lambda s, d: M.confusion_matrix(base(s, d), "y", "pred", weight="w"), f"WITH {B} {derive_sql(cells_sql(w='w'))}", ALL)
register("confusion_matrix_beta", lambda s, d: M.confusion_matrix(base(s, d), "y", "pred", beta=8.0), f"WITH {B} {derive_sql(cells_sql(), beta=8.0)}", ALL)
register("confusion_matrix_long", lambda s, d: M.to_long(M.confusion_matrix(base(s, d), "y", "pred")), f"WITH {B} {long_sql(derive_sql(cells_sql()), M.CONFUSION)}", "value")
register("confusion_matrix_by_group", lambda s, d: M.confusion_matrix(base(s, d), "prot", "pred", by="event_type"), f"WITH {B} " + derive_sql(cells_sql(relation="(SELECT prot AS y, pred, event_type FROM B)", keys="event_type"), "event_type"), ALL)


def auc_sql(w: str = "1.0::DOUBLE") -> str:
    return f"""WITH {B}, c AS (SELECT s, sum({w} * y) AS p, sum({w} * (1 - y)) AS n FROM B GROUP BY s), r AS (SELECT p, n, sum(n) OVER (ORDER BY s) AS cn FROM c)
    SELECT sum(p * (cn - n / 2)) / NULLIF(sum(p) * sum(n), 0) AS roc_auc FROM r"""


def ap_sql(w: str = "1.0::DOUBLE") -> str:
    return f"""WITH {B}, c AS (SELECT s, sum({w} * y) AS p, sum({w} * (1 - y)) AS n FROM B GROUP BY s), r AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM c)
    SELECT sum(p * cp / NULLIF(cp + cn, 0)) / NULLIF(sum(p), 0) AS average_precision FROM r"""


register("roc_auc", lambda s, d: M.roc_auc(base(s, d), "y", "s"), auc_sql(), "roc_auc")
register("roc_auc_weighted", lambda s, d: M.roc_auc(base(s, d), "y", "s", "w"), auc_sql("w"), "roc_auc")
register("max_ks", lambda s, d: M.max_ks(base(s, d), "y", "s"), f"""WITH {B}, c AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM B GROUP BY s),
  r AS (SELECT sum(p) OVER (ORDER BY s) AS cp, sum(n) OVER (ORDER BY s) AS cn FROM c), t AS (SELECT sum(p) AS tp, sum(n) AS tn FROM c) SELECT max(abs(cp / NULLIF(tp, 0) - cn / NULLIF(tn, 0))) AS max_ks FROM r, t""", "max_ks")
register("average_precision", lambda s, d: M.average_precision(base(s, d), "y", "s"), ap_sql(), "average_precision")
register("average_precision_weighted", lambda s, d: M.average_precision(base(s, d), "y", "s", "w"), ap_sql("w"), "average_precision")
register("brier_loss", lambda s, d: M.brier_loss(base(s, d), "y", "s"), f"WITH {B} SELECT avg((y - s) * (y - s)) AS brier_loss FROM B", "brier_loss")
register("mean", lambda s, d: M.mean(base(s, d), "s"), f"WITH {B} SELECT avg(s) AS mean FROM B", "mean")


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("s"))


L = "L AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS s FROM lineitem)"
register("mean_squared_error", lambda s, d: M.mean_squared_error(regression(s, d), "y", "s"), f"WITH {L} SELECT avg((y - s) * (y - s)) AS mean_squared_error FROM L", "mean_squared_error")
register("root_mean_squared_error", lambda s, d: M.root_mean_squared_error(regression(s, d), "y", "s"), f"WITH {L} SELECT sqrt(avg((y - s) * (y - s))) AS root_mean_squared_error FROM L", "root_mean_squared_error")
register("r2", lambda s, d: M.r2(regression(s, d), "y", "s"), f"WITH {L} SELECT 1 - sum((y - s) * (y - s)) / NULLIF(var_pop(y) * count(*), 0) AS r2 FROM L", "r2")


def air_sql(w: str) -> str:
    rate = lambda g: f"(sum({w} * {g} * low) / NULLIF(sum({w} * {g}), 0))"
    return f"WITH {B} SELECT {rate('prot')} / NULLIF({rate('ctrl')}, 0) AS air FROM B"


register("adverse_impact_ratio", lambda s, d: M.adverse_impact_ratio(base(s, d), "low", "prot", "ctrl"), air_sql("1.0::DOUBLE"), "air")
register("adverse_impact_ratio_weighted", lambda s, d: M.adverse_impact_ratio(base(s, d), "low", "prot", "ctrl", "w"), air_sql("w"), "air")


def values_sql(thresholds: tuple[float, ...]) -> str:
    return "T AS (SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in thresholds) + "]) AS threshold)"


def cmt_sql(source: str, w: str = "1.0::DOUBLE") -> str:
    inner = f"(SELECT threshold, y, (s >= threshold)::INT AS pred, w FROM B, {source})"
    return derive_sql(cells_sql(w=w, relation=inner, keys="threshold"), "threshold")


register("cm_at_thresholds", lambda s, d: M.confusion_matrix_at_thresholds(base(s, d), "y", "s", FEW), f"WITH {B}, {values_sql(FEW)} {long_sql(cmt_sql('T'), M.CONFUSION)}", "value")
register("cm_at_thresholds_cum_sum", lambda s, d: M.confusion_matrix_at_thresholds(base(s, d), "y", "s", MANY), f"WITH {B}, {values_sql(MANY)} {long_sql(cmt_sql('T'), M.CONFUSION)}", "value")
register("cm_at_thresholds_weighted", lambda s, d: M.confusion_matrix_at_thresholds(base(s, d), "y", "s", FEW, strategy="cum_sum", weight="w"), f"WITH {B}, {values_sql(FEW)} {long_sql(cmt_sql('T', 'w'), M.CONFUSION)}", "value")
_ALL_CELLS = """SELECT threshold, n_all - cn AS tn, cn AS fp, p_all - cp AS fn, cp AS tp FROM (SELECT s AS threshold, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER () AS p_all, sum(n) OVER () AS n_all
  FROM (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM B GROUP BY s))"""
register("cm_at_thresholds_all", lambda s, d: M.confusion_matrix_at_thresholds(base(s, d), "y", "s"), f"WITH {B} {long_sql(derive_sql(_ALL_CELLS, 'threshold'), M.CONFUSION)}", "threshold value")
register("ppr_at_thresholds", lambda s, d: M.predicted_positive_ratio_at_thresholds(base(s, d), "s", MANY), f"WITH {B}, {values_sql(MANY)} SELECT threshold, avg((s >= threshold)::INT::DOUBLE) AS ppr FROM B, T GROUP BY threshold", "ppr")
register("ppr_at_thresholds_weighted", lambda s, d: M.predicted_positive_ratio_at_thresholds(base(s, d), "s", FEW, "w"), f"WITH {B}, {values_sql(FEW)} SELECT threshold, sum(w * (s >= threshold)::INT) / sum(w) AS ppr FROM B, T GROUP BY threshold", "ppr")


def airt_sql(thresholds: tuple[float, ...], w: str = "1.0::DOUBLE") -> str:
    rate = lambda g: f"(sum({w} * {g} * (s < threshold)::INT) / NULLIF(sum({w} * {g}), 0))"
    return f"WITH {B}, {values_sql(thresholds)} SELECT threshold, {rate('prot')} / NULLIF({rate('ctrl')}, 0) AS air FROM B, T GROUP BY threshold"


register("air_at_thresholds", lambda s, d: M.adverse_impact_ratio_at_thresholds(base(s, d), "s", "prot", "ctrl", MANY), airt_sql(MANY), "air")
register("air_at_thresholds_loop", lambda s, d: M.adverse_impact_ratio_at_thresholds(base(s, d), "s", "prot", "ctrl", FEW, "w", "loop"), airt_sql(FEW, "w"), "air")
register("capture_rate_at_quantiles", lambda s, d: M.capture_rate_at_quantiles(base(s, d), "y", "s", drop_intermediate=False), f"""WITH {B}, E AS (SELECT list_distinct(quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM B),
  C AS (SELECT y, len(list_filter(e, lambda x: x < s)) AS b FROM B, E), G AS (SELECT b, sum(y) AS n_pos, count(*) AS n, avg(y) AS capture_rate FROM C GROUP BY b)
  SELECT row_number() OVER (ORDER BY b) AS quantile, n_pos, n, capture_rate, n_pos / sum(n_pos) OVER () AS capture_share FROM G""", "n_pos capture_rate capture_share")

# Counts of histogram bins
_x = "SELECT value AS x FROM events"
_cube = "pow(count(*)::DOUBLE, 1.0::DOUBLE / 3)"
_rule = lambda rule: lambda s, d: binning.bin_count(_read(s, d, "events"), "value", rule)
register("bin_fd", _rule("fd"), f"SELECT ceil((max(x) - min(x)) / (2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / {_cube}))::BIGINT AS bins FROM ({_x})")
register("bin_scott", _rule("scott"), f"SELECT ceil((max(x) - min(x)) / (3.49::DOUBLE * stddev_samp(x) / {_cube}))::BIGINT AS bins FROM ({_x})")
register("bin_rice", _rule("rice"), f"SELECT ceil(2 * {_cube})::BIGINT AS bins FROM ({_x})")
register("bin_sturges", _rule("sturges"), f"SELECT (ceil(log2(count(*)::DOUBLE)) + 1)::BIGINT AS bins FROM ({_x})")
register("bin_sqrt", _rule("sqrt"), f"SELECT ceil(sqrt(count(*)::DOUBLE))::BIGINT AS bins FROM ({_x})")
register("bin_doane", _rule("doane"), f"""WITH X AS ({_x}), M AS (SELECT avg(x) AS m, var_pop(x) AS v, count(*)::DOUBLE AS n FROM X), G AS (SELECT n, avg(pow(x - m, 3)) / pow(any_value(v), 1.5::DOUBLE) AS g FROM X, M GROUP BY n)
  SELECT floor(1 + log2(n) + log2(1 + abs(g) / sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))))::BIGINT AS bins FROM G""")


# Drift: lineitem before and after a date
def halves(spark: SparkSession, sf_dir: str, column: Column) -> tuple[DataFrame, DataFrame]:
    li = _read(spark, sf_dir, "lineitem")
    return li.filter("l_linestatus = 'O'").select(column.alias("x")), li.filter("l_linestatus <> 'O'").select(column.alias("x"))


def psi_sql(bins: str, column: str, keep: str = "TRUE", possible: str | None = None, epsilon: str = "0.0001::DOUBLE") -> str:
    """``bins``: bin of x over (x, lo, hi)."""
    extra = f" UNION ALL SELECT unnest({possible}) AS b, 0 AS r, 0 AS c" if possible else ""
    return f"""WITH D AS (SELECT {column} AS x, (l_linestatus = 'O')::INT AS r, (l_linestatus <> 'O')::INT AS c FROM lineitem), K AS (SELECT * FROM D WHERE {keep}), R AS (SELECT min(x) AS lo, max(x) AS hi FROM K WHERE r = 1),
      P AS (SELECT {bins} AS b, r, c FROM K, R{extra}), H AS (SELECT b, sum(r) AS r, sum(c) AS c FROM P WHERE b IS NOT NULL GROUP BY b), A AS (SELECT sum(r) AS ra, sum(c) AS ca FROM K),
      S AS (SELECT CASE WHEN r = 0 THEN {epsilon} ELSE r::DOUBLE / ra END AS r, CASE WHEN c = 0 THEN {epsilon} ELSE c::DOUBLE / ca END AS c FROM H, A) SELECT sum((c - r) * ln(c / r)) AS psi FROM S"""


_null_price = lambda: F.when(F.pmod("l_orderkey", F.lit(10)) != 0, F.col("l_extendedprice"))
_null_price_sql = "CASE WHEN l_orderkey % 10 <> 0 THEN l_extendedprice END"
_edges = lambda k: f"CASE WHEN x IS NULL THEN 0 WHEN x < lo OR x > hi THEN NULL ELSE greatest(1, len(list_filter(range(0, {k}), lambda i: lo + i * (hi - lo) / {k} < x))) END"
register("psi_numeric", lambda s, d: drift.psi(*halves(s, d, F.col("l_extendedprice")), "x", bin_count_rule=20, include_nulls=False), psi_sql(_edges(20), "l_extendedprice", possible="range(1, 21)"), "psi")
register("psi_nulls", lambda s, d: drift.psi(*halves(s, d, _null_price()), "x", bin_count_rule=10), psi_sql(_edges(10), _null_price_sql, possible="range(0, 11)"), "psi")
register("psi_bins", lambda s, d: drift.psi(*halves(s, d, F.col("l_quantity")), "x", bins=[0, 10, 20, 30, 40], include_nulls=False), psi_sql("CASE WHEN x >= 0 AND x <= 40 THEN greatest(1, ceil(x / 10)) END", "l_quantity", possible="range(1, 5)"), "psi")
register("psi_categorical", lambda s, d: drift.psi(*halves(s, d, F.col("l_returnflag")), "x"), psi_sql("x", "l_returnflag"), "psi")
register("psi_fd", lambda s, d: drift.psi(*halves(s, d, F.col("l_extendedprice")), "x"), f"""WITH D AS (SELECT l_extendedprice AS x, (l_linestatus = 'O')::INT AS r, (l_linestatus <> 'O')::INT AS c FROM lineitem),
  R AS (SELECT min(x) AS lo, max(x) AS hi, ceil((max(x) - min(x)) / (2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / {_cube}))::BIGINT AS k FROM D WHERE r = 1),
  P AS (SELECT {_edges('k')} AS b, r, c FROM D, R UNION ALL SELECT unnest(range(0, k + 1)) AS b, 0, 0 FROM R), H AS (SELECT b, sum(r) AS r, sum(c) AS c FROM P WHERE b IS NOT NULL GROUP BY b), A AS (SELECT sum(r) AS ra, sum(c) AS ca FROM D),
  S AS (SELECT CASE WHEN r = 0 THEN 0.0001::DOUBLE ELSE r::DOUBLE / ra END AS r, CASE WHEN c = 0 THEN 0.0001::DOUBLE ELSE c::DOUBLE / ca END AS c FROM H, A) SELECT sum((c - r) * ln(c / r)) AS psi FROM S""", "psi")


# Correlation
def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(F.when(F.pmod("l_orderkey", F.lit(10)) != 0, F.col("l_quantity")).alias("a"), F.col("l_extendedprice").alias("b"), F.when(F.pmod("l_partkey", F.lit(7)) != 0, F.col("l_discount")).alias("c"), F.col("l_tax").alias("d"))


N = "N AS (SELECT CASE WHEN l_orderkey % 10 <> 0 THEN l_quantity END AS a, l_extendedprice AS b, CASE WHEN l_partkey % 7 <> 0 THEN l_discount END AS c, l_tax AS d FROM lineitem)"
_pair = lambda p: " UNION ALL ".join(f"SELECT '{a}' AS c1, '{b}' AS c2, corr({a}, {b}) AS value FROM N" for a, b in p)


def spearman_sql(pairs: list[tuple[str, str]]) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
    one = lambda a, b: f"SELECT '{a}' AS c1, '{b}' AS c2, corr(x, y) AS value FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM N WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"WITH {N} " + " UNION ALL ".join(one(a, b) for a, b in pairs)


_SIX = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
register("corr_pearson", lambda s, d: correlation.correlations(measures(s, d)), f"WITH {N} {_pair(_SIX)}", "value")
register("corr_spearman", lambda s, d: correlation.correlations(measures(s, d), method="spearman"), spearman_sql(_SIX), "value")
register("corr_pairs", lambda s, d: correlation.correlations(measures(s, d), [("a", "d"), ("b", "c")]), f"WITH {N} {_pair([('a', 'd'), ('b', 'c')])}", "value")
register("corr_rect", lambda s, d: correlation.correlations(measures(s, d), ["a", "b"], ["c", "d", "nope"]), f"WITH {N} {_pair([('a', 'c'), ('b', 'c'), ('a', 'd'), ('b', 'd')])}", "value")
register("corr_matrix", lambda s, d: correlation.correlation_matrix(measures(s, d), index_name="name"), f"""WITH {N} SELECT 'b' AS name, corr(a, b) AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS c FROM N UNION ALL SELECT 'c', corr(a, c), corr(b, c), NULL FROM N
  UNION ALL SELECT 'd', corr(a, d), corr(b, d), corr(c, d) FROM N""", "a b c")


# Functions
def poly_sql(coefficients, x: str) -> str:  # noqa: ANN001
    out = ""
    for c in coefficients:
        out = f"{c!r}::DOUBLE" if not out else f"({out}) * {x} + ({c!r}::DOUBLE)"
    return f"({out})"


def ppf_sql(q: str) -> str:
    """For q inside (0, 1)."""
    tail = lambda p: f"({poly_sql(numeric.PPF_C, f'sqrt(-2 * ln({p}))')} / {poly_sql((*numeric.PPF_D, 1.0), f'sqrt(-2 * ln({p}))')})"
    middle = f"({poly_sql(numeric.PPF_A, f'(({q} - 0.5) * ({q} - 0.5))')} * ({q} - 0.5) / {poly_sql((*numeric.PPF_B, 1.0), f'(({q} - 0.5) * ({q} - 0.5))')})"
    return f"CASE WHEN {q} < 0.02425 THEN {tail(q)} WHEN {q} < 0.97575 THEN {middle} ELSE -{tail(f'(1 - {q})')} END"


def cdf_sql(x: str) -> str:
    z = f"(abs({x}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + {numeric.ERF_P}::DOUBLE * {z}))"
    erf = f"(1 - {poly_sql((*reversed(numeric.ERF_A), 0.0), t)} * exp(-{z} * {z}))"
    return f"(0.5::DOUBLE * (1 + CASE WHEN {x} < 0 THEN -{erf} ELSE {erf} END))"


register("norm_ppf", lambda s, d: s.range(1, 100).select("id", numeric.norm_ppf(F.col("id") / 100.0).alias("q")), f"SELECT id, {ppf_sql('u')} AS q FROM (SELECT range AS id, range / 100.0::DOUBLE AS u FROM range(1, 100))", "q")
register("norm_cdf", lambda s, d: s.range(-40, 41).select("id", numeric.norm_cdf(F.col("id") / 10.0).alias("p")), f"SELECT id, {cdf_sql('u')} AS p FROM (SELECT range AS id, range / 10.0::DOUBLE AS u FROM range(-40, 41))", "p")


def poisson_sql(u: str, lam: float = 1.0) -> str:
    return "(" + " + ".join(f"({u} >= {c!r}::DOUBLE)::BIGINT" for c in numeric.poisson_cdf(lam)) + ")"


register("random_poisson", lambda s, d: numeric.Random(SEED).poisson(s, 2.5, 1000), f"SELECT id, {poisson_sql('u', 2.5)} AS value FROM (SELECT range AS id, {numeric.hash_uniform_sql(SEED, 'range')} AS u FROM range(1000))")
_curve = "(SELECT event_type, user_id::DOUBLE AS x, value AS y FROM events)"
_curve_of = lambda s, d: _read(s, d, "events").select("event_type", F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
_area = lambda k: f"SELECT {k + ',' if k else ''} sum((nx - x) * (ny + y) / 2) AS auc FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM {_curve} WINDOW w AS ({'PARTITION BY ' + k if k else ''} ORDER BY x, y))" + (f" GROUP BY {k}" if k else "")
register("auc_trapezoidal", lambda s, d: numeric.auc(_curve_of(s, d), "x", "y"), _area(""), "auc")
register("auc_rectangular", lambda s, d: numeric.auc(_curve_of(s, d), "x", "y", method="rectangular"), _area(""), "auc")
register("auc_by_group", lambda s, d: numeric.auc(_curve_of(s, d), "x", "y", by="event_type"), _area("event_type"), "auc")
register("auc_expr", lambda s, d: _curve_of(s, d).groupBy("event_type").agg(numeric.auc_expr("x", "y").alias("auc")), _area("event_type"), "auc")
_near = lambda: F.when(F.pmod("event_id", F.lit(9)) != 0, F.col("value") * (1 + F.pmod("event_id", F.lit(3)) * 0.00001))
_near_sql = "CASE WHEN event_id % 9 <> 0 THEN value * (1 + (event_id % 3) * 0.00001::DOUBLE) END"
register("is_close", lambda s, d: _read(s, d, "events").select("event_id", numeric.is_close("value", _near(), rtol=1.5e-5).alias("close"), numeric.is_close("value", _near(), rtol=1.5e-5, null_equal=True).alias("close_null")), f"""SELECT event_id, abs(value - z) <= 1e-8::DOUBLE + 1.5e-5::DOUBLE * abs(z) AS close,
  coalesce(abs(value - z) <= 1e-8::DOUBLE + 1.5e-5::DOUBLE * abs(z), FALSE) AS close_null FROM (SELECT *, {_near_sql} AS z FROM events)""")
_three = lambda s, d: _read(s, d, "events").select("event_id", *(F.when(F.pmod("event_id", F.lit(m)) != 0, F.col("value")).alias(c) for c, m in (("a", 2), ("b", 3), ("c", 5))))
_three_sql = "(SELECT event_id, CASE WHEN event_id % 2 <> 0 THEN value END AS a, CASE WHEN event_id % 3 <> 0 THEN value END AS b, CASE WHEN event_id % 5 <> 0 THEN value END AS c FROM events)"
for _method, _sql in (("kleene", "CASE WHEN coalesce(a, b, c) IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) END"), ("ignore", "coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)"), ("propagate", "a + b + c")):
    register(f"sum_horizontal_{_method}", lambda s, d, m=_method: _three(s, d).select("event_id", numeric.sum_horizontal("a", "b", "c", null_method=m).alias("total")), f"SELECT event_id, {_sql} AS total FROM {_three_sql}", "total")
register("format", lambda s, d: _read(s, d, "part").select("p_partkey", text_format.format("{:,.2f} is {} at {:+.1f} {{of}} {:_}", F.col("p_retailprice"), F.col("p_brand"), F.col("p_size") - 25, F.col("p_partkey") * 1000).alias("text")), """SELECT p_partkey,
  format('{:,.2f}', p_retailprice) || ' is ' || p_brand || ' at ' || CASE WHEN p_size >= 25 THEN '+' ELSE '' END || printf('%.1f', (p_size - 25)::DOUBLE) || ' {of} ' || replace(format('{:,}', p_partkey * 1000), ',', '_') AS text FROM part""")
register("next_at_least", lambda s, d: next_at_least(s.range(0, 110).select((F.col("id") / 100).alias("s")), base(s, d).groupBy("s").agg(F.min("id").alias("id")), "s", "id"), f"WITH {B} SELECT t.s, (SELECT min(id) FROM B WHERE B.s = (SELECT min(s) FROM B WHERE B.s >= t.s)) AS id FROM (SELECT range / 100.0::DOUBLE AS s FROM range(0, 110)) t")

# Preprocessing
_orders = lambda s, d: _read(s, d, "orders").select("o_orderkey", F.when(F.pmod("o_orderkey", F.lit(10)) != 0, F.col("o_totalprice")).alias("x"), F.col("o_totalprice").alias("z"))
O = "O AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS x, o_totalprice AS z FROM orders)"  # noqa: E741
_scaled = lambda f: f"WITH {O}, P AS (SELECT {', '.join(e.format(c=c) + f' AS {n}_{c}' for c in 'xz' for n, e in f[0].items())} FROM O) SELECT o_orderkey, {', '.join(f[1].format(c=c) + f' AS {c}' for c in 'xz')} FROM O, P"
_MINMAX = ({"lo": "min({c})", "hi": "max({c})"}, "-1 + 2 * ({c} - lo_{c}) / (hi_{c} - lo_{c})")
_STANDARD = ({"m": "avg({c})", "sd": "stddev_samp({c})"}, "({c} - m_{c}) / sd_{c}")
_ROBUST = ({"m": "median({c})", "w": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"}, "({c} - m_{c}) / w_{c}")
register("minmax_scaler", lambda s, d: preprocessing.MinMaxScaler((-1, 1)).fit_transform(_orders(s, d), ["x", "z"]), _scaled(_MINMAX), "x z")
register("minmax_scaler_run", lambda s, d: preprocessing.MinMaxScaler((-1, 1)).run(_orders(s, d), ["x", "z"]), _scaled(_MINMAX), "x z")
register("standard_scaler", lambda s, d: preprocessing.StandardScaler().run(_orders(s, d), ["x", "z"]), _scaled(_STANDARD), "x z")
register("robust_scaler", lambda s, d: preprocessing.RobustScaler().run(_orders(s, d), ["x", "z"]), _scaled(_ROBUST), "x z")


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    scaler = preprocessing.StandardScaler().fit(_orders(s, d), ["x", "z"])
    return scaler.inverse_transform(scaler.transform(_orders(s, d)))


register("scaler_inverse", _round_trip, f"WITH {O} SELECT * FROM O", "x z")
register("one_hot", lambda s, d: preprocessing.OneHotEncoder().fit_transform(_read(s, d, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("f"))), "SELECT f, f = 'A' AS f_A, f = 'R' AS f_R FROM (SELECT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS f FROM lineitem)")

# Bootstrap, with draws that SQL repeats
_u = numeric.hash_uniform_sql(SEED, "id", "it")
RP = f"{B}, I AS (SELECT range AS it FROM range({ITERATIONS})), RP AS (SELECT B.*, it, {poisson_sql('u')}::DOUBLE AS k FROM (SELECT B.*, it, {_u} AS u FROM B, I) B)"
RM = f"""{B}, I AS (SELECT range AS it FROM range({ITERATIONS})), Q AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn FROM B), RM AS (SELECT Q.*, D.it, D.k FROM Q JOIN
  (SELECT it, pick, count(*)::DOUBLE AS k FROM (SELECT it, floor({numeric.hash_uniform_sql(SEED, 'rn', 'it')} * (SELECT count(*) FROM B))::BIGINT AS pick FROM Q, I) GROUP BY it, pick) D ON Q.rn = D.pick)"""
SIMPLE = {
    "mean": ("sum({w} * s) / sum({w})", lambda b: lambda s, d: b.mean(base(s, d), "id", "s")),
    "brier_loss": ("sum({w} * (y - s) * (y - s)) / sum({w})", lambda b: lambda s, d: b.brier_loss(base(s, d), "id", "y", "s")),
    "mse": ("sum({w} * (w - s) * (w - s)) / sum({w})", lambda b: lambda s, d: b.mean_squared_error(base(s, d), "id", "w", "s")),
    "rmse": ("sqrt(sum({w} * (w - s) * (w - s)) / sum({w}))", lambda b: lambda s, d: b.root_mean_squared_error(base(s, d), "id", "w", "s")),
    "r2": ("1 - sum({w} * (w - s) * (w - s)) / (sum({w} * w * w) - sum({w} * w) * sum({w} * w) / sum({w}))", lambda b: lambda s, d: b.r2(base(s, d), "id", "w", "s")),
    "air": ("(sum({w} * prot * low) / sum({w} * prot)) / (sum({w} * ctrl * low) / sum({w} * ctrl))", lambda b: lambda s, d: b.adverse_impact_ratio(base(s, d), "id", "low", "prot", "ctrl")),
}


def interval_sql(method: str, reps: str, point: str, by: str = "", alpha: float = 0.025) -> str:
    k, using = (f"{by}, ", f"USING ({by})") if by else ("", "ON TRUE")
    group = f" GROUP BY {by}" if by else ""
    q = f"SELECT {k}quantile_cont(value, {alpha}) AS lo, quantile_cont(value, {1 - alpha}) AS hi, avg(value) AS m, stddev_samp(value) AS sd FROM ({reps}) WHERE value IS NOT NULL{group}"
    low, high = {"percentile": ("lo", "hi"), "basic": ("2 * point - hi", "2 * point - lo"), "standard": (f"m - ({ppf_sql(f'{1 - alpha}::DOUBLE')}) * sd", f"m + ({ppf_sql(f'{1 - alpha}::DOUBLE')}) * sd")}[method]
    return f"SELECT {k}{low} AS lower, point, {high} AS upper FROM ({q}) JOIN ({point}) {using}"


for _name, (_stat, _build) in SIMPLE.items():
    for _sampler, _cte, _rel in (("poisson", RP, "RP"), ("multinomial", RM, "RM")):
        for _method in ("percentile",) if _name not in ("mean", "air") else ("standard", "percentile", "basic"):
            _b = bootstrap.Bootstrap(ITERATIONS, method=_method, sampling_method=_sampler, seed=SEED)
            register(f"boot_{_name}_{_sampler}_{_method}", _build(_b), f"WITH {_cte} " + interval_sql(_method, f"SELECT {_stat.format(w='k')} AS value FROM {_rel} GROUP BY it", f"SELECT {_stat.format(w='1.0::DOUBLE')} AS point FROM B"), "lower point upper")


def boot_rank_sql(cte: str, rel: str, kind: str, method: str = "percentile") -> str:
    def body(relation: str, w: str, it: str) -> str:
        p = f"PARTITION BY {it}" if it else ""
        keys = f"{it}, s" if it else "s"
        group = f"GROUP BY {it}" if it else ""
        c = f"(SELECT {keys}, sum({w} * y) AS p, sum({w} * (1 - y)) AS n FROM {relation} GROUP BY {keys})"
        if kind == "roc_auc":
            return f"SELECT sum(p * (cn - n / 2)) / NULLIF(sum(p) * sum(n), 0) AS v FROM (SELECT *, sum(n) OVER ({p} ORDER BY s) AS cn FROM {c}) {group}"
        if kind == "max_ks":
            return f"SELECT max(abs(cp / tp - cn / tn)) AS v FROM (SELECT *, sum(p) OVER ({p} ORDER BY s) AS cp, sum(n) OVER ({p} ORDER BY s) AS cn, sum(p) OVER ({p}) AS tp, sum(n) OVER ({p}) AS tn FROM {c}) {group}"
        return f"SELECT sum(p * coalesce(cp / NULLIF(cp + cn, 0), 0)) / NULLIF(sum(p), 0) AS v FROM (SELECT *, sum(p) OVER ({p} ORDER BY s DESC) AS cp, sum(n) OVER ({p} ORDER BY s DESC) AS cn FROM {c}) {group}"

    return f"WITH {cte} " + interval_sql(method, f"SELECT v AS value FROM ({body(rel, 'k', 'it')})", f"SELECT v AS point FROM ({body('B', '1.0::DOUBLE', '')})")


for _kind in ("roc_auc", "max_ks", "average_precision"):
    for _sampler, _cte, _rel in (("poisson", RP, "RP"), ("multinomial", RM, "RM")):
        _b = bootstrap.Bootstrap(ITERATIONS, sampling_method=_sampler, seed=SEED)
        register(f"boot_{_kind}_{_sampler}", lambda s, d, b=_b, k=_kind: getattr(b, k)(base(s, d), "id", "y", "s"), boot_rank_sql(_cte, _rel, _kind), "lower point upper")

_reps_cm = lambda rel: "SELECT metric, value FROM (" + long_sql(derive_sql(cells_sql(w="k", relation=rel, keys="it"), "it"), M.CONFUSION) + ")"
_point_cm = f"SELECT metric, value AS point FROM ({long_sql(derive_sql(cells_sql()), M.CONFUSION)})"
for _sampler, _cte, _rel in (("poisson", RP, "RP"), ("multinomial", RM, "RM")):
    _b = bootstrap.Bootstrap(ITERATIONS, method="basic", sampling_method=_sampler, seed=SEED)
    register(f"boot_cm_{_sampler}", lambda s, d, b=_b: b.confusion_matrix(base(s, d), "id", "y", "pred"), f"WITH {_cte} " + interval_sql("basic", _reps_cm(_rel), _point_cm, "metric"), "lower point upper", 9 if _sampler == "multinomial" else DIGITS)  # at 6 digits, multiples of 1/10,000 interpolate to exact halves
_b = bootstrap.Bootstrap(ITERATIONS, sampling_method="poisson", seed=SEED)
_three_metrics = ["tpr", "precision", "mcc"]
_inner = lambda w, rel, keys: derive_sql(cells_sql(w=w, relation=f"(SELECT {'it, ' if 'it' in keys else ''}threshold, y, (s >= threshold)::INT AS pred{', k' if w == 'k' else ''} FROM {rel}, T)", keys=keys), keys)
register(
    "boot_cm_at_thresholds", lambda s, d: _b.confusion_matrix_at_thresholds(base(s, d), "id", "y", "s", FEW, _three_metrics),
    f"WITH {RP}, {values_sql(FEW)}, V AS ({long_sql('SELECT it, threshold, tpr, precision, mcc FROM (' + _inner('k', 'RP', 'it, threshold') + ')', _three_metrics)}), W AS ({long_sql('SELECT threshold, tpr, precision, mcc FROM (' + _inner('1.0::DOUBLE', 'B', 'threshold') + ')', _three_metrics)}) "
    + interval_sql("percentile", "SELECT threshold, metric, value FROM V", "SELECT threshold, metric, value AS point FROM W", "threshold, metric"), "lower point upper",
)
_airt = lambda w, rel, k: f"SELECT threshold, (sum({w} * prot * (s < threshold)::INT) / NULLIF(sum({w} * prot), 0)) / NULLIF(sum({w} * ctrl * (s < threshold)::INT) / NULLIF(sum({w} * ctrl), 0), 0) AS value FROM {rel}, T GROUP BY {k}"
register("boot_air_at_thresholds", lambda s, d: _b.adverse_impact_ratio_at_thresholds(base(s, d), "id", "s", "prot", "ctrl", FEW), f"WITH {RP}, {values_sql(FEW)} " + interval_sql("percentile", _airt("k", "RP", "it, threshold"), f"SELECT threshold, value AS point FROM ({_airt('1.0::DOUBLE', 'B', 'threshold')})", "threshold"), "lower point upper")
register("boot_run_expression", lambda s, d: _b.run(base(s, d), "id", lambda k: F.try_divide(F.sum(F.col("s") * F.col(k)), F.sum(k)), as_expression=True), f"WITH {RP} " + interval_sql("percentile", "SELECT sum(k * s) / sum(k) AS value FROM RP GROUP BY it", "SELECT avg(s) AS point FROM B"), "lower point upper")


_zero = lambda it: f"CASE WHEN round({it}, 12) = 0 THEN 0 ELSE round({it}, 12) END"
_all_steps = lambda rel, it, grid: f"""SELECT {it} s AS threshold, {_zero('n_all - cn')} AS tn, cn AS fp, {_zero('p_all - cp')} AS fn, cp AS tp FROM (SELECT {it} s, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER g AS p_all, sum(n) OVER g AS n_all
  FROM (SELECT {it} s, sum(k * y) AS p, sum(k * (1 - y)) AS n FROM ({rel}) GROUP BY {it} s) WINDOW w AS ({'PARTITION BY it' if it else ''} ORDER BY s DESC), g AS ({'PARTITION BY it' if it else ''}))"""  # noqa: E731
_some = lambda rel, it: long_sql(f"SELECT {it} threshold, tpr, precision, mcc FROM ({derive_sql(_all_steps(rel, it, ''), f'{it} threshold')})", _three_metrics)
for _sampler, _cte, _rel in (("poisson", RP, "SELECT it, s, y, k FROM RP"), ("multinomial", RM, "SELECT it, s, y, k FROM RM UNION ALL SELECT it, s, 0.0::DOUBLE AS y, 0.0::DOUBLE AS k FROM (SELECT DISTINCT s FROM B), I")):
    _a = bootstrap.Bootstrap(ITERATIONS, sampling_method=_sampler, seed=SEED)
    register(
        f"boot_cm_at_all_scores_{_sampler}", lambda s, d, b=_a: b.confusion_matrix_at_thresholds(base(s, d), "id", "y", "s", None, _three_metrics),
        f"WITH {_cte}, V AS ({_some(_rel, 'it,')}), W AS ({_some('SELECT s, y, 1.0::DOUBLE AS k FROM B', '')}) " + interval_sql("percentile", "SELECT threshold, metric, value FROM V", "SELECT threshold, metric, value AS point FROM W", "threshold, metric"),
        "threshold lower point upper",
    )
_air_steps = lambda rel, it: f"""SELECT {it} s AS threshold, ((a_all - ca) / NULLIF(a_all, 0)) / NULLIF((b_all - cb) / NULLIF(b_all, 0), 0) AS value FROM (SELECT {it} s, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER g AS a_all, sum(b) OVER g AS b_all
  FROM (SELECT {it} s, sum(k * prot) AS a, sum(k * ctrl) AS b FROM ({rel}) GROUP BY {it} s) WINDOW w AS ({'PARTITION BY it' if it else ''} ORDER BY s DESC), g AS ({'PARTITION BY it' if it else ''}))"""  # noqa: E731
register("boot_air_at_all_scores", lambda s, d: _b.adverse_impact_ratio_at_thresholds(base(s, d), "id", "s", "prot", "ctrl"), f"WITH {RP} " + interval_sql("percentile", _air_steps("SELECT * FROM RP", "it,"), f"SELECT threshold, value AS point FROM ({_air_steps('SELECT *, 1.0::DOUBLE AS k FROM B', '')})", "threshold"), "threshold lower point upper")


def bca_sql(reps: str, point: str, jack: str, by: str = "", alpha: float = 0.025) -> str:
    """``jack``: (by, value, times)."""
    k, group, using = (f"{by}, ", f"GROUP BY {by}", f"USING ({by})") if by else ("", "", "ON TRUE")
    z = lambda q: f"({ppf_sql(f'{q}::DOUBLE')})"
    at = lambda q: cdf_sql(f"(z0 + (z0 + {z(q)}) / (1 - a * (z0 + {z(q)})))")
    pick = lambda p: f"v[floor({p} * (len(v) - 1))::INT + 1] + ({p} * (len(v) - 1) - floor({p} * (len(v) - 1))) * (v[least(floor({p} * (len(v) - 1))::INT + 2, len(v))] - v[floor({p} * (len(v) - 1))::INT + 1])"
    return f"""J AS (SELECT * FROM ({jack}) WHERE value IS NOT NULL), JM AS (SELECT {k}sum(value * times) / sum(times) AS m FROM J {group}),
      A AS (SELECT {k}sum(times * pow(m - value, 3)) / NULLIF(6 * pow(sum(times * pow(m - value, 2)), 1.5::DOUBLE), 0) AS a FROM J JOIN JM {using} {group}), PT AS ({point}),
      V AS (SELECT {k}list_sort(list(value)) AS v, avg(((value < point)::INT + (value <= point)::INT) / 2.0::DOUBLE) AS below, any_value(point) AS point FROM (SELECT * FROM ({reps}) WHERE value IS NOT NULL) JOIN PT {using} {group}),
      Z AS (SELECT {k}v, point, a, {ppf_sql('b')} AS z0 FROM (SELECT *, CASE WHEN below > 0 AND below < 1 THEN below END AS b FROM V) JOIN A {using}),
      PP AS (SELECT {k}v, point, {at(alpha)} AS p1, {at(1 - alpha)} AS p2 FROM Z) SELECT {k}{pick('p1')} AS lower, point, {pick('p2')} AS upper FROM PP"""


def rank_bca_sql(kind: str) -> str:
    """Leave-one-out values by leaving out one row of every (score, label), step by step."""
    steps = "S AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM B GROUP BY s), O AS (SELECT s AS os, y AS oy, count(*)::DOUBLE AS times FROM B GROUP BY s, y)"
    order = "DESC" if kind == "average_precision" else "ASC"
    cum = f"C AS (SELECT s, p, n, sum(p) OVER (ORDER BY s {order}) AS cp, sum(n) OVER (ORDER BY s {order}) AS cn, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM S)"
    reached = "s <= os" if kind == "average_precision" else "s >= os"
    left = f"SELECT os, oy, times, s, p - (s = os)::INT * oy AS p, cp - ({reached})::INT * oy AS cp, cn - ({reached})::INT * (1 - oy) AS cn, ap - oy AS ap, an - (1 - oy) AS an FROM C, O"
    value = "sum(coalesce(p * cp / NULLIF(cp + cn, 0), 0)) / NULLIF(any_value(ap), 0)" if kind == "average_precision" else "max(abs(cp / NULLIF(ap, 0) - cn / NULLIF(an, 0)))"
    one = boot_rank_sql(RP, "RP", kind)
    reps, point = one[one.index("(SELECT v AS value") + 1 : one.index(") WHERE value IS NOT NULL")], one[one.rindex("(SELECT v AS point") + 1 : one.rindex(") ON TRUE")]
    return f"WITH {RP}, {steps}, {cum}, " + bca_sql(reps, point, f"SELECT {value} AS value, any_value(times) AS times FROM ({left}) GROUP BY os, oy")


_c = bootstrap.Bootstrap(ITERATIONS, method="BCa", sampling_method="poisson", seed=SEED)
register("boot_mean_bca", lambda s, d: _c.mean(base(s, d), "id", "s"), f"WITH {RP}, " + bca_sql("SELECT sum(k * s) / sum(k) AS value FROM RP GROUP BY it", "SELECT avg(s) AS point FROM B", "SELECT (sum(s) OVER () - s) / (count(*) OVER () - 1) AS value, 1 AS times FROM B"), "lower point upper")
_auc_one = boot_rank_sql(RP, "RP", "roc_auc")
register("boot_roc_auc_bca", lambda s, d: _c.roc_auc(base(s, d), "id", "y", "s"), f"""WITH {RP}, S AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM B GROUP BY s), C AS (SELECT s, p, n, sum(n) OVER (ORDER BY s) - n / 2 AS below, sum(p) OVER () - sum(p) OVER (ORDER BY s) + p / 2 AS above, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM S),
  U AS (SELECT sum(p * below) AS won FROM C), """ + bca_sql(_auc_one[_auc_one.index("(SELECT v AS value") + 1 : _auc_one.index(") WHERE value IS NOT NULL")], _auc_one[_auc_one.rindex("(SELECT v AS point") + 1 : _auc_one.rindex(") ON TRUE")],
  "SELECT CASE WHEN y = 1 THEN (won - below) / ((ap - 1) * an) ELSE (won - above) / (ap * (an - 1)) END AS value, 1 AS times FROM B JOIN C USING (s), U"), "lower point upper")
register("boot_average_precision_bca", lambda s, d: _c.average_precision(base(s, d), "id", "y", "s"), rank_bca_sql("average_precision"), "lower point upper")
register("boot_max_ks_bca", lambda s, d: _c.max_ks(base(s, d), "id", "y", "s"), rank_bca_sql("max_ks"), "lower point upper")
_r2 = "(1 - sum({w} * (w - s) * (w - s)) / (sum({w} * w * w) - sum({w} * w) * sum({w} * w) / sum({w})))"
register("boot_r2_bca", lambda s, d: _c.r2(base(s, d), "id", "w", "s"), f"WITH {RP}, T AS (SELECT count(*) AS aw, sum(w) AS ay, sum(w * w) AS ayy, sum((w - s) * (w - s)) AS ae FROM B), " + bca_sql(f"SELECT {_r2.format(w='k')} AS value FROM RP GROUP BY it", f"SELECT {_r2.format(w='1.0::DOUBLE')} AS point FROM B",
  "SELECT 1 - (ae - (w - s) * (w - s)) / (ayy - w * w - (ay - w) * (ay - w) / (aw - 1)) AS value, 1 AS times FROM B, T"), "lower point upper")
_left_cm = lambda pred, extra="": f"""(SELECT o.y AS oy, o.p AS op, o.times, c.y, c.p AS pred, c.times - (c.y = o.y AND c.p = o.p)::INT AS w2{extra.format('o')} FROM LC c JOIN LC o ON {'c.threshold = o.threshold' if extra else 'TRUE'})"""
register("boot_cm_bca", lambda s, d: _c.confusion_matrix(base(s, d), "id", "y", "pred"), f"WITH {RP}, LC AS (SELECT y, pred AS p, count(*)::DOUBLE AS times FROM B GROUP BY ALL), " + bca_sql(_reps_cm("RP"), _point_cm,
  f"SELECT metric, value, times FROM ({long_sql('SELECT * EXCLUDE (oy, op) FROM (' + derive_sql(cells_sql(w='w2', relation=_left_cm('p'), keys='oy, op, times'), 'oy, op, times') + ')', M.CONFUSION)})", "metric"), "lower point upper")
register("boot_cm_at_thresholds_bca", lambda s, d: _c.confusion_matrix_at_thresholds(base(s, d), "id", "y", "s", FEW, _three_metrics), f"""WITH {RP}, {values_sql(FEW)}, V0 AS ({long_sql('SELECT it, threshold, tpr, precision, mcc FROM (' + _inner('k', 'RP', 'it, threshold') + ')', _three_metrics)}),
  W0 AS ({long_sql('SELECT threshold, tpr, precision, mcc FROM (' + _inner('1.0::DOUBLE', 'B', 'threshold') + ')', _three_metrics)}), LC AS (SELECT threshold, y, (s >= threshold)::INT AS p, count(*)::DOUBLE AS times FROM B, T GROUP BY ALL), """ + bca_sql("SELECT threshold, metric, value FROM V0", "SELECT threshold, metric, value AS point FROM W0",
  f"SELECT threshold, metric, value, times FROM ({long_sql('SELECT threshold, times, tpr, precision, mcc FROM (' + derive_sql(cells_sql(w='w2', relation=_left_cm('p', ', {}.threshold'), keys='threshold, oy, op, times'), 'threshold, oy, op, times') + ')', _three_metrics)})", "threshold, metric"), "lower point upper")
_air = "(sum({w} * prot * {y}) / NULLIF(sum({w} * prot), 0)) / NULLIF(sum({w} * ctrl * {y}) / NULLIF(sum({w} * ctrl), 0), 0)"
_left_air = lambda extra="": f"SELECT {extra.format('o')} o.prot AS op, o.ctrl AS oc, o.y AS oy, o.times, c.prot, c.ctrl, c.y, c.times - (c.prot = o.prot AND c.ctrl = o.ctrl AND c.y = o.y)::INT AS w2 FROM LC c JOIN LC o ON {'c.threshold = o.threshold' if extra else 'TRUE'}"
register("boot_air_bca", lambda s, d: _c.adverse_impact_ratio(base(s, d), "id", "low", "prot", "ctrl"), f"WITH {RP}, LC AS (SELECT prot, ctrl, low AS y, count(*)::DOUBLE AS times FROM B GROUP BY ALL), " + bca_sql(f"SELECT {_air.format(w='k', y='low')} AS value FROM RP GROUP BY it", f"SELECT {_air.format(w='1.0::DOUBLE', y='low')} AS point FROM B",
  f"SELECT {_air.format(w='w2', y='y')} AS value, any_value(times) AS times FROM ({_left_air()}) GROUP BY op, oc, oy"), "lower point upper")
register("boot_air_at_thresholds_bca", lambda s, d: _c.adverse_impact_ratio_at_thresholds(base(s, d), "id", "s", "prot", "ctrl", FEW), f"WITH {RP}, {values_sql(FEW)}, LC AS (SELECT threshold, prot, ctrl, (s < threshold)::INT AS y, count(*)::DOUBLE AS times FROM B, T GROUP BY ALL), " + bca_sql(
  _airt("k", "RP", "it, threshold"), f"SELECT threshold, value AS point FROM ({_airt('1.0::DOUBLE', 'B', 'threshold')})", f"SELECT threshold, {_air.format(w='w2', y='y')} AS value, any_value(times) AS times FROM ({_left_air('{}.threshold,')}) GROUP BY threshold, op, oc, oy", "threshold"), "lower point upper")
_suppliers = "S AS (SELECT s_suppkey AS id, s_acctbal AS x FROM supplier)"
register("boot_run_bca", lambda s, d: _c.run(_read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x")), "id", lambda k: F.try_divide(F.sum(F.col("x") * F.col(k)), F.sum(k)), as_expression=True),
  f"WITH {_suppliers}, RS AS (SELECT x, it, {poisson_sql('u')}::DOUBLE AS k FROM (SELECT x, it, {_u} AS u FROM S, (SELECT range AS it FROM range({ITERATIONS})))), " + bca_sql("SELECT sum(k * x) / sum(k) AS value FROM RS GROUP BY it", "SELECT avg(x) AS point FROM S", "SELECT (sum(x) OVER () - x) / (count(*) OVER () - 1) AS value, 1 AS times FROM S"), "lower point upper")


# Selection and streaming
def _features(s: SparkSession, d: str) -> DataFrame:
    li = _read(s, d, "lineitem")
    return li.select(F.xxhash64(*li.columns).alias("key"), *(F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), (F.col("l_quantity") > 25).cast("double").alias("label"))


_NAMES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _tree():  # noqa: ANN202
    from pyspark.ml.classification import DecisionTreeClassifier

    return DecisionTreeClassifier(maxDepth=3, seed=1)


def rfe(s: SparkSession, d: str) -> DataFrame:
    found = selection.RFE(_tree(), 1, callbacks=[selection.EarlyStopping(max_delta=0.5)]).fit(_features(s, d), _NAMES, "label")
    return s.createDataFrame([(f,) for f in found.selected_features_], "feature string")


def nfe(s: SparkSession, d: str) -> DataFrame:
    found = selection.NFE(_tree(), seed=SEED).fit(_features(s, d), _NAMES, "label", "key")
    return s.createDataFrame([(f,) for f in found.selected_features_], "feature string")


register("rfe", rfe, "SELECT 'l_quantity' AS feature")
register("nfe", nfe, "SELECT 'l_quantity' AS feature")


def _windowed(s: SparkSession, d: str) -> DataFrame:
    e = _read(s, d, "events").select(F.col("ts").cast("timestamp").alias("t"), F.col("event_type").isin("purchase", "signup").alias("y"), (F.col("value") >= 50).alias("p"))
    return streaming.windowed_confusion_matrix(e, "t", "y", "p", "1 day").select(F.col("start").cast("string").alias("start"), *M.CONFUSION)


register("streaming_confusion_matrix", _windowed, "WITH E AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, (event_type IN ('purchase', 'signup'))::INT AS y, (value >= 50)::INT AS pred FROM events) " + derive_sql(cells_sql(relation="E", keys="start"), "start"), ALL)
