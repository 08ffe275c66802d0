import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from statspark.functions import binning, numeric, text_format
from statspark.operators import bootstrap, correlation, drift, preprocessing, selection
from statspark.operators import metrics as M
from statspark.plans.prefix import next_at_least
from statspark.streaming.metrics import windowed_confusion_matrix


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_normal(spark):
    nd = statistics.NormalDist()
    rows = spark.range(1, 1000).select((F.col("id") / 1000).alias("q")).select("q", numeric.norm_ppf("q").alias("x"), numeric.norm_cdf(numeric.norm_ppf("q")).alias("back")).collect()
    for r in rows:
        assert r.x == pytest.approx(nd.inv_cdf(r.q), abs=1e-6)
        assert r.back == pytest.approx(r.q, abs=1e-6)
    edge = one(spark, *(numeric.norm_ppf(F.lit(q)).alias(f"e{i}") for i, q in enumerate((0.0, 1.0, 1.5))))
    assert edge[0] == -math.inf and edge[1] == math.inf and math.isnan(edge[2])


def test_random_is_seeded(spark):
    r = numeric.Random(3)
    a, b = (sorted(x.value for x in r.poisson(spark, 2.0, 500).collect()) for _ in range(2))
    assert a != b and a == sorted(x.value for x in numeric.Random(3).poisson(spark, 2.0, 500).collect())
    assert 1.7 < sum(a) / 500 < 2.3


def test_is_close_and_sums(spark):
    df = spark.createDataFrame([(1.0, 1.000001), (math.nan, math.nan), (None, None), (1.0, None), (0.0, 1e-9)], "x double, y double")
    assert [r[0] for r in df.select(numeric.is_close("x", "y")).collect()] == [True, False, None, None, True]
    assert [r[0] for r in df.select(numeric.is_close("x", "y", null_equal=True)).collect()] == [True, False, True, False, True]
    abc = spark.createDataFrame([(1, 1, 1), (None, None, None), (None, None, 1)], "a int, b int, c int")
    got = {m: [r[0] for r in abc.select(numeric.sum_horizontal("a", "b", "c", null_method=m)).collect()] for m in ("kleene", "ignore", "propagate")}
    assert got == {"kleene": [3, None, 1], "ignore": [3, 0, 1], "propagate": [3, None, None]}
    with pytest.raises(ValueError):
        numeric.sum_horizontal("a", null_method="x")


def test_format(spark):
    r = one(spark, text_format.format("{:.5f} {{x}} {:+_.3%} {}", F.lit(-0.99999), F.lit(1234.5), F.lit("s")).alias("a"), text_format.format("{:,}", F.lit(-123456)).alias("b"), text_format.format("{:+.1f}", F.lit(-0.5)).alias("c"))
    assert tuple(r) == ("-0.99999 {x} +123_450.000% s", "-123,456", "-0.5")
    for bad in ("}", "{"):
        with pytest.raises(ValueError):
            text_format.format(bad)
    with pytest.raises(NotImplementedError):
        text_format.format("{:e}", F.lit(1.0))
    with pytest.raises(ValueError):
        text_format.format("{}")


def test_area(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0), (3.0, 7.0)], "x double, y double")
    assert numeric.auc(df, "x", "y").first()[0] == 12.0
    assert df.agg(numeric.auc_expr("x", "y")).first()[0] == 12.0
    with pytest.raises(ValueError):
        numeric.auc(df, "x", "y", method="x")


def test_bins(spark):
    zeros = spark.createDataFrame([(0.0,)] * 1000 + [(1.0,)] * 5, "x double")
    assert all(binning.bin_count(zeros, "x", r).first()[0] > 0 for r in binning.RULES)
    with pytest.raises(ValueError):
        binning.bin_count(zeros, "x", "nope")


def test_psi(spark):
    a = spark.range(1000).select((F.col("id") / 7).alias("x"))
    for rule in (*binning.RULES, 1, 5):
        assert drift.psi(a, a, "x", bin_count_rule=rule).first()[0] == 0.0
    b = a.filter("x < 50")
    assert drift.psi(a, b, "x").first()[0] > 0.1
    left, right = (spark.createDataFrame([(v,) for v in vs], "x string") for vs in (["p"] * 4, ["p", "q"] * 2))
    want = (0.5 - 1) * math.log(0.5) + (0.5 - 1e-4) * math.log(0.5 / 1e-4)
    assert drift.psi(left, right, "x").first()[0] == pytest.approx(want)
    assert drift.psi(left, right, "x", epsilon=None).first()[0] == pytest.approx((0.5 - 1) * math.log(0.5))


def test_correlation_against_pandas(spark):
    pdf = spark.range(200).select(*(F.when(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10)) != 0, F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(25)).cast("double")).alias(c) for i, c in enumerate("abcd"))).toPandas()
    df = spark.createDataFrame(pdf)
    for method in ("pearson", "spearman"):
        want = pdf.corr(method="pearson") if method == "pearson" else None
        for r in correlation.correlations(df, method=method).collect():
            pair = pdf[[r.c1, r.c2]].dropna()
            expected = want.loc[r.c1, r.c2] if want is not None else pair.rank().corr().iloc[0, 1]
            assert r.value == pytest.approx(expected, abs=1e-12)
    m = correlation.correlation_matrix(df, index_name="n")
    assert m.columns == ["n", "a", "b", "c"] and m.count() == 3


def test_spearman_counts_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return float(x % 17)

    rows = spark.range(300).select(watched.asNondeterministic()("id").alias("a"), (F.col("id") * 7 % 23).cast("double").alias("b"), F.lit(1.0).alias("c"))
    got = {(r.c1, r.c2): r.value for r in correlation.correlations(rows, method="spearman").collect()}
    assert seen.value == 300
    want = rows.toPandas().rank().corr()
    assert got[("a", "b")] == pytest.approx(want.loc["a", "b"]) and got[("a", "c")] is None and got[("b", "c")] is None
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_auc_metric_scores_rows_once(spark):
    from pyspark.ml.classification import LogisticRegression

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return x

    df = spark.range(200).select((F.col("id") % 37).cast("double").alias("x"), F.when(F.col("id") % 9 != 0, (F.pmod(F.xxhash64("id"), F.lit(50)) < F.col("id") % 37).cast("double")).alias("y"))
    model = LogisticRegression(featuresCol="__features", labelCol="y").fit(selection.assemble(df.dropna(), ["x"]))
    got = selection.auc_metric(model, df.withColumn("x", watched.asNondeterministic()("x")), "y", ["x"])
    assert seen.value == 200
    assert got == pytest.approx(M.roc_auc(df, "y", "x").first()[0])
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_scalers_round_trip_and_save(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (4.0, 5.0)], "a double, k double")
    for i, scaler in enumerate((preprocessing.MinMaxScaler((-1, 1)), preprocessing.StandardScaler(0), preprocessing.RobustScaler())):
        out = scaler.fit_transform(df)
        assert [r.a for r in out.collect() if r.a is not None] == pytest.approx([r.a for r in scaler.run(df).collect() if r.a is not None])
        assert {r.k for r in out.collect()} == {None}  # a constant column
        back = [r.a for r in scaler.inverse_transform(out).collect()]
        assert [x for x in back if x is not None] == pytest.approx([1.0, 2.0, 4.0])
        scaler.save(spark, f"{tmp_path}/{i}")
        again = type(scaler).load(spark, f"{tmp_path}/{i}")
        assert again.transform(df).collect() == out.collect()
    one_hot = preprocessing.OneHotEncoder().fit(spark.createDataFrame([("a",), (None,), ("b",)], "x string"))
    one_hot.save(spark, f"{tmp_path}/h")
    seen = preprocessing.OneHotEncoder.load(spark, f"{tmp_path}/h").transform(spark.createDataFrame([("a",), (None,), ("z",)], "x string"))
    assert [tuple(r) for r in seen.collect()] == [("a", True, False), (None, None, None), ("z", False, False)]


def test_nan_counts_as_null(spark):
    nan = float("nan")
    clean = spark.createDataFrame([(float(i),) for i in range(50)] + [(None,)], "x double")
    dirty = spark.createDataFrame([(float(i),) for i in range(50)] + [(nan,)], "x double")
    other = spark.range(40).select((F.col("id") * 0.9).alias("x"))
    for nulls in (True, False):
        assert drift.psi(dirty, other, "x", include_nulls=nulls).first()[0] == pytest.approx(drift.psi(clean, other, "x", include_nulls=nulls).first()[0])
        assert drift.psi(other, dirty, "x", bins=[0, 10, 60], include_nulls=nulls).first()[0] == pytest.approx(drift.psi(other, clean, "x", bins=[0, 10, 60], include_nulls=nulls).first()[0])
    for scaler in (preprocessing.MinMaxScaler(), preprocessing.StandardScaler(), preprocessing.RobustScaler(), preprocessing.RobustScaler(exact=False)):
        assert [r.x for r in scaler.fit_transform(dirty).collect()][:50] == pytest.approx([r.x for r in scaler.fit_transform(clean).collect()][:50])


def test_categories_of_any_type_are_saved(spark, tmp_path):
    import datetime
    import decimal

    rows = [(datetime.date(2020, 1, i), decimal.Decimal(f"{i}.50"), i % 2 == 0) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "d date, m decimal(6,2), b boolean")
    fitted = preprocessing.OneHotEncoder().fit(df)
    fitted.save(spark, f"{tmp_path}/e")
    again = preprocessing.OneHotEncoder.load(spark, f"{tmp_path}/e")
    assert again.categories_ == fitted.categories_ and again.transform(df).collect() == fitted.transform(df).collect()


def test_tables_and_arrays(spark, tmp_path):
    from statspark import core
    from statspark.sources import io

    df = spark.range(20).select("id", (F.col("id") % 3).alias("k"))
    for kind, options in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true"})):
        io.write(df, f"{tmp_path}/{kind}", kind, partition_by=["k"] if kind == "parquet" else None, **options)
        back = io.read(spark, f"{tmp_path}/{kind}", kind, None if kind in ("parquet", "orc") else "id long, k long", **options)
        assert sorted((r.id, int(r.k)) for r in back.collect()) == [(i, i % 3) for i in range(20)]
    for bad in (lambda: io.read(spark, "x", "csv"), lambda: io.read(spark, "x", "nope")):
        with pytest.raises(ValueError):
            bad()
    got = M.roc_auc(core.from_arrays(spark, y=[True, False, None, True], s=np.array([0.9, 0.1, 0.5, float("nan")])), "y", "s").first()[0]
    assert got == 1.0
    with pytest.raises(ValueError):
        core.from_arrays(spark, a=[1], b=[1, 2])


def test_exact_quantiles(spark):
    from statspark.plans.prefix import quantiles

    pdf = spark.range(500).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x")).toPandas()
    levels = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for r in quantiles(spark.createDataFrame(pdf), "x", levels, "q", "g").collect():
        assert r.q == pytest.approx(list(pdf[pdf.g == r.g].x.quantile(levels)))
    assert quantiles(spark.createDataFrame(pdf), "x", levels, "q").first().q == pytest.approx(list(pdf.x.quantile(levels)))


def test_as_of(spark):
    t = spark.createDataFrame([(0.1,), (0.5,), (2.0,)], "k double")
    d = spark.createDataFrame([(0.5, "a"), (1.0, "b")], "k double, v string")
    assert {r.k: r.v for r in next_at_least(t, d, "k", "v").collect()} == {0.1: "a", 0.5: "a", 2.0: None}


@pytest.mark.parametrize("sampler", bootstrap.SAMPLERS)
def test_bootstrap_intervals_hold_the_point(spark, sampler):
    df = spark.range(400).select("id", (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("v")).withColumn("y", (F.col("v") > 0.5).cast("int"))
    for method in bootstrap.METHODS:
        r = bootstrap.Bootstrap(40, method=method, sampling_method=sampler, seed=1).mean(df, "id", "v").first()
        assert r.lower < r.point < r.upper
    r = bootstrap.Bootstrap(20, sampling_method=sampler, seed=1).run(df, "id", lambda p: p["v"].median()).first()
    assert r.lower <= r.point <= r.upper
    for bad in ({"method": "x"}, {"sampling_method": "x"}):
        with pytest.raises(ValueError):
            bootstrap.Bootstrap(**bad)


def test_jackknife_of_auc_against_brute_force(spark):
    rows = [(i, int(i * 7 % 5 > 1), float(i * 13 % 6)) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, y int, s double")
    b = bootstrap.Bootstrap(2)
    cells = M.coerce(df, "id", None, y=M.truth("y"), s=M.number("s"))
    got = sorted(v for r in b._auc_jackknife(cells).collect() for v in [r.value] * int(r.times))
    want = sorted(M.roc_auc(df.filter(F.col("id") != i), "y", "s", slices=None).first()[0] for i in range(0, 24, 6))
    assert len(got) == 24 and all(any(abs(w - g) < 1e-12 for g in got) for w in want)


def test_run_without_each_row_against_brute_force(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 7 != 0, F.pmod(F.xxhash64("id"), F.lit(100)).cast("double")).alias("x"))
    b = bootstrap.Bootstrap(5, method="BCa", sampling_method="poisson", seed=1)
    w = lambda k: F.col(k)
    stats = [
        lambda k: F.try_divide(F.sum(F.col("x") * w(k)), F.sum(k)), lambda k: F.sqrt(F.avg(F.when(w(k) > 0, F.col("x")))) + F.count("x") / F.lit(2), lambda k: -F.sum(w(k)).cast("double").alias("q"),
        lambda k: F.max(F.col("x") * w(k)), lambda k: F.sum(w(k)) * F.max("x"), lambda k: F.expr("sum(x * k)"),
    ]
    for i, stat in enumerate(stats):
        assert (bootstrap.taken_apart(df, stat("k")) is None) == (i > 2)
        evaluate = lambda d, s=stat: d.groupBy("iter").agg(s("k").cast("double").alias("value")).select("value")
        got = sorted(r.value for r in b._without_each(df, "id", evaluate, stat("k")).collect())
        want = sorted(r.value for r in b._without_each(df, "id", evaluate, None).collect())
        assert len(got) == 40 and got == pytest.approx(want)
    odd = spark.createDataFrame([(0, 1.0), (1, math.inf), (2, None), (3, math.nan)], "id long, x double")
    for bad in (3, None):
        some = odd.filter(F.col("id") != bad) if bad is not None else odd
        stat = F.sum(F.when(F.col("k") > 0, F.col("x")))
        got = b._without_each(some, "id", lambda d, s=stat: d.groupBy("iter").agg(s.alias("value")).select("value"), stat).collect()
        want = b._without_each(some, "id", lambda d, s=stat: d.groupBy("iter").agg(s.alias("value")).select("value"), None).collect()
        assert sorted(r.value for r in got) == sorted(r.value for r in want)
    assert b._without_each(odd.limit(1), "id", evaluate, stat).collect() == []


@pytest.mark.parametrize("n", [70_001, 3_000_000])
def test_rows_find_their_draws(n):
    draws = np.arange(n, dtype=np.int64)
    rows = np.array(sorted({0, 1, 2, n - 2, n - 1, *range(n // 3, n // 3 + 20)}))
    found = np.zeros((5, len(rows)), np.int64)
    sizes, codes = numeric.draws_of(rows, 7, n, 5)
    found[codes & 7, np.repeat(np.arange(len(rows)), sizes)] = codes >> numeric.draw_bits(5)
    for it in range(5):
        h = ((draws + 1) * numeric.HASH_LOW + numeric.HASH_HIGH + (it + 1) * numeric.HASH_SECOND + 7 * 40503 + 12345) % 2**32
        for _ in range(2):
            h = ((h ^ (h >> 16)) * numeric.HASH_MIX) % 2**32
        picks = np.floor((h ^ (h >> 16)) / 2**32 * n).astype(np.int64)
        assert (found[it] == np.bincount(picks, minlength=n)[rows]).all()


def test_rows_find_the_draws_that_a_join_gives(spark, monkeypatch):
    n = 70_000
    df = spark.range(n).select((F.lit(5 * n) - F.col("id") * 3).alias("id"), F.pmod("id", F.lit(97)).cast("double").alias("v"))
    b = bootstrap.Bootstrap(3, seed=1)
    some = lambda d: sorted(map(tuple, d.filter("id % 1009 = 0").select("id", "v", "iter", "k").collect()))
    joined = some(b.replicates(df, "id"))
    monkeypatch.setattr(bootstrap, "FOUND_DRAWS", 1)
    found = b.replicates(df, "id")
    assert some(found) == joined and len(joined) > 100
    total = found.groupBy("iter").agg(F.sum("k")).collect()
    assert sorted(map(tuple, total)) == [(i, float(n)) for i in range(3)]
    # No draw is shuffled: rows are dealt once, and nothing is dealt by the draws' rows.
    assert "__pick" not in found._jdf.queryExecution().toString()


def test_run_offers_bca_for_any_number_of_rows(spark):
    df = spark.range(20_000).select("id", F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("x"))
    r = bootstrap.Bootstrap(20, method="BCa", sampling_method="poisson", seed=1).run(df, "id", lambda k: F.try_divide(F.sum(F.col("x") * F.col(k)), F.sum(k)), as_expression=True).first()
    assert r.lower < r.point < r.upper


@pytest.mark.parametrize("weighted", [False, True])
def test_jackknife_of_ranks_against_brute_force(spark, weighted):
    rows = [(i, int(i * 7 % 5 > 1), float(i * 13 % 6), float(1 + i % 3 if weighted else 1)) for i in range(18)] + [(18, 1, -1.0, 1.0)]
    b = bootstrap.Bootstrap(2)
    cells = M.coerce(spark.createDataFrame(rows, "id long, y int, s double, w double"), "id", "w", y=M.truth("y"), s=M.number("s"))

    def ap(left):
        out = 0.0
        for t in {s for _, _, s, _ in left}:
            tp = sum(w for _, y, s, w in left if y and s >= t)
            out += sum(w for _, y, s, w in left if y and s == t) * tp / sum(w for _, _, s, w in left if s >= t)
        return out / sum(w for _, y, _, w in left if y)

    def ks(left):
        share = lambda c, t: sum(w for _, y, s, w in left if y == c and s <= t) / sum(w for _, y, _, w in left if y == c)
        return max(abs(share(1, t) - share(0, t)) for t in {s for _, _, s, _ in left})

    for jack, brute in ((b._ap_jackknife, ap), (b._ks_jackknife, ks)):
        got = sorted(v for r in jack(cells).collect() for v in [r.value] * int(r.times))
        assert got == pytest.approx(sorted(brute([r for r in rows if r is not out]) for out in rows))


def test_selection(spark, tmp_path):
    from pyspark.ml.classification import DecisionTreeClassifier

    df = spark.range(500).select("id", (F.pmod(F.xxhash64("id"), F.lit(97)) / 97).alias("good"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(89)) / 89).alias("bad")).withColumn("y", (F.col("good") > 0.5).cast("double"))
    tree = DecisionTreeClassifier(maxDepth=2, seed=1)
    stop = selection.EarlyStopping(max_delta=0.9)
    assert selection.RFE(tree, 1, callbacks=[stop]).fit(df, ["bad", "good"], "y").selected_features_ == ["good"]
    assert len(stop.metrics) == 2 and stop.best_metric > 0.9
    assert selection.NFE(tree).fit(df, ["bad", "good"], "y", "id").selected_features_ == ["good"]
    rfe = selection.RFE(tree, 1, callbacks=[selection.ModelCheckpoint(f"{tmp_path}/models")]).fit(df, ["bad", "good"], "y")
    assert sorted(p.name for p in (tmp_path / "models").iterdir()) == ["0", "1"]
    assert rfe.transform().numFeatures == 1 and rfe.transform(df, "y").numFeatures == 1
    with pytest.raises(TypeError):
        selection.RFE(DecisionTreeClassifier)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.range(200).select(F.timestamp_seconds(F.col("id") * 600).alias("t"), (F.col("id") % 3 == 0).alias("y"), (F.col("id") % 2 == 0).alias("p"))
    df.write.parquet(f"{tmp_path}/in")
    stream = windowed_confusion_matrix(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "t", "y", "p")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("cm").start()
    q.processAllAvailable()
    q.stop()
    order = lambda d: sorted(tuple(r) for r in d.select("start", "tp", "fp", "acc").collect())
    assert order(spark.table("cm")) == order(windowed_confusion_matrix(df, "t", "y", "p"))


def test_entry_imports_without_the_corpus_operators(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "roc_auc" in entry.queries() and not any(k.startswith("op1_") for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
