import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statspark.operators import metrics as M


def frame(spark, rows, schema="y int, s double, w double"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def tied(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.randint(0, 12) / 10, float(rng.randint(1, 3))) for _ in range(300)]
    return rows, frame(spark, rows).cache()


def brute_auc(rows):
    won = total = 0.0
    for y, s, w in rows:
        for y2, s2, w2 in rows:
            if y == 1 and y2 == 0:
                total += w * w2
                won += w * w2 * (1.0 if s > s2 else 0.5 if s == s2 else 0.0)
    return won / total


def test_auc_with_ties_and_weights(tied):
    rows, df = tied
    assert M.roc_auc(df, "y", "s", "w").first()[0] == pytest.approx(brute_auc(rows))
    flipped = df.withColumn("s", 1 - F.col("s"))
    assert M.roc_auc(flipped, "y", "s", "w").first()[0] == pytest.approx(1 - brute_auc(rows))


def test_slices_do_not_change_prefix_sums(tied):
    _, df = tied
    for metric, name in ((M.roc_auc, "roc_auc"), (M.max_ks, "max_ks"), (M.average_precision, "average_precision")):
        assert metric(df, "y", "s", slices=3).first()[name] == pytest.approx(metric(df, "y", "s", slices=None).first()[name])


def test_hand_cases(spark):
    one = lambda rows: frame(spark, [(y, s, 1.0) for y, s in rows])
    assert M.roc_auc(one([(1, 0.5), (0, 0.5)]), "y", "s").first()[0] == 0.5
    perfect = one([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)])
    assert (M.roc_auc(perfect, "y", "s").first()[0], M.max_ks(perfect, "y", "s").first()[0]) == (1.0, 1.0)
    single = one([(1, 0.1), (1, 0.2)])
    assert (M.roc_auc(single, "y", "s").first()[0], M.max_ks(single, "y", "s").first()[0]) == (None, None)
    assert M.roc_auc(one([(1, 0.5), (0, 0.5), (1, None), (0, math.nan)]), "y", "s").first()[0] == 0.5


def test_confusion_matrix_without_predicted_positives(spark):
    r = M.confusion_matrix(spark.createDataFrame([(1, 0), (0, 0)], "y int, p int"), "y", "p").first()
    assert (r.precision, r.tpr, r.fpr, r.acc) == (None, 0.0, 0.0, 0.5)


@pytest.mark.parametrize("beta", [1.0, 8.0])
def test_sweep_strategies_agree_with_a_loop(tied, beta):
    rows, df = tied
    cuts = [0.0, 0.35, 0.5, 0.55, 1.2, 9.0]
    loop = {(r.threshold, r.metric): r.value for r in M.confusion_matrix_at_thresholds(df, "y", "s", cuts, strategy="loop", beta=beta, weight="w").collect()}
    binned = {(r.threshold, r.metric): r.value for r in M.confusion_matrix_at_thresholds(df, "y", "s", cuts, strategy="cum_sum", beta=beta, weight="w").collect()}
    assert loop.keys() == binned.keys() and len(loop) == 27 * len(cuts)
    for k, v in loop.items():
        assert v == pytest.approx(binned[k]) if v is not None else binned[k] is None
    y, s, w = (np.array(c) for c in zip(*rows))
    for t in cuts:
        tp, fp = w[(y == 1) & (s >= t)].sum(), w[(y == 0) & (s >= t)].sum()
        assert (loop[t, "tp"], loop[t, "fp"]) == (pytest.approx(tp), pytest.approx(fp))


def test_all_scores_as_thresholds(tied):
    rows, df = tied
    out = M.confusion_matrix_at_thresholds(df, "y", "s", metrics=["tp", "tn"], wide=True, slices=4).collect()
    assert len(out) == len({s for _, s, _ in rows})
    for r in out:
        assert r.tp == sum(y for y, s, _ in rows if s >= r.threshold)
        assert r.tn == sum(1 - y for y, s, _ in rows if s < r.threshold)


def test_by_groups_equals_filters(tied):
    _, df = tied
    g = df.withColumn("g", F.when(F.col("w") > 1, F.lit("a")))
    got = {r.g: r.roc_auc for r in M.roc_auc(g, "y", "s", by="g").collect()}
    assert got["a"] == pytest.approx(M.roc_auc(df.filter("w > 1"), "y", "s").first()[0])
    assert got[None] == pytest.approx(M.roc_auc(df.filter("w = 1"), "y", "s").first()[0])


def test_air_and_bad_strategy(spark):
    df = spark.createDataFrame([(i < 50, i % 2 == 0) for i in range(100)], "p boolean, a boolean").withColumn("b", ~F.col("a"))
    assert M.adverse_impact_ratio(df, "p", "a", "b").first()[0] == 1.0
    with pytest.raises(ValueError):
        M.predicted_positive_ratio_at_thresholds(df, "p", [0.1], strategy="nope")


def test_integer_weights_repeat_rows(spark, tied):
    _, df = tied
    repeated = df.withColumn("r", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    assert M.average_precision(df, "y", "s", "w").first()[0] == pytest.approx(M.average_precision(repeated, "y", "s").first()[0])
