"""Feature selection around pyspark.ml estimators."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hash_uniform
from . import metrics as M

_VECTOR = "__features"
NOISE = "__noise"


@dataclass
class State:
    """What callbacks and importance functions see of an iteration."""

    model: object
    df: DataFrame
    label: str
    features: list[str]
    iteration: int = 0
    eval_df: DataFrame | None = None


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=_VECTOR, handleInvalid="skip").transform(df)


def importance_of(state: State) -> list[float]:
    """featureImportances, else coefficients (the largest absolute one over classes)."""
    model = state.model
    if hasattr(model, "featureImportances"):
        return [float(x) for x in model.featureImportances.toArray()]
    if hasattr(model, "coefficientMatrix") and getattr(model, "numClasses", 2) > 2:
        return [float(x) for x in abs(model.coefficientMatrix.toArray()).max(axis=0)]
    if hasattr(model, "coefficients"):
        return [float(x) for x in model.coefficients.toArray()]
    raise ValueError("the model has no featureImportances or coefficients")


def auc_metric(model, df: DataFrame, label: str, features: Sequence[str]) -> float:  # noqa: ANN001
    """ROC-AUC of the probability of class 1.

    Rows are scored once: those of a label and score are counted, and the counts are kept while AUC reads them.
    """
    scored = model.transform(assemble(df, features)).select(F.col(label).alias("y"), F.get(vector_to_array("probability"), F.lit(1)).alias("s"))
    cells = scored.groupBy("y", "s").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return M.roc_auc(cells, "y", "s", weight="n").first()["roc_auc"]
    finally:
        cells.unpersist()


class EarlyStopping:
    """Stops once the metric is ``max_delta`` or more behind its best value."""

    def __init__(self, df: DataFrame | None = None, metric: Callable[..., float] = auc_metric, max_delta: float = 0.1, direction: str = "maximize"):
        if direction not in ("maximize", "minimize"):
            raise ValueError("`direction` must be `maximize` or `minimize`")
        self.df, self.metric, self.max_delta, self.sign = df, metric, max_delta, 1 if direction == "maximize" else -1
        self.best_metric, self.best_iteration, self.best_features = -math.inf * self.sign, 0, []
        self.metrics: list[float] = []
        self._stop = False

    def __call__(self, state: State) -> None:
        df = self.df if self.df is not None else state.eval_df if state.eval_df is not None else state.df
        value = self.metric(state.model, df, state.label, state.features)
        self.metrics.append(value)
        if self.sign * value > self.sign * self.best_metric:
            self.best_metric, self.best_iteration, self.best_features = value, state.iteration, list(state.features)
        self._stop = self._stop or self.sign * (self.best_metric - value) >= self.max_delta

    def stop(self) -> bool:
        return self._stop


class ModelCheckpoint:
    """Saves the model of each iteration as ``<folder>/<iteration>``."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, state: State) -> None:
        state.model.write().overwrite().save(f"{self.folder}/{state.iteration}")


def step_size(n_features: int, step: float) -> int:
    """A share of the features (one at least), or a number of them."""
    return max(1, int(step * n_features)) if 0 < step < 1 else int(step)


class _Selector:
    def __init__(self, estimator):  # noqa: ANN001
        if isinstance(estimator, type):
            raise TypeError("`estimator` must be an instance, not a class")
        self.estimator = estimator

    def _fit(self, df: DataFrame, features: Sequence[str], label: str):  # noqa: ANN202
        own = self.estimator.copy()
        own.setFeaturesCol(_VECTOR)
        if own.hasParam("labelCol"):
            own.setLabelCol(label)
        return own.fit(assemble(df, features))

    def transform(self, df: DataFrame | None = None, label: str | None = None):  # noqa: ANN201
        """The fitted model, or one that is fitted anew on the selected features of ``df``."""
        return self.estimator_ if df is None or label is None else self._fit(df, self.selected_features_, label)


class RFE(_Selector):
    """Recursive elimination: fits, ranks by absolute importance, and drops ``step`` features until fewer than ``n_features_to_select`` would remain.

    The input is kept on executors' memory and disk while it runs; the driver
    holds importances only.
    """

    def __init__(self, estimator, n_features_to_select: float = 1, step: float = 1, importance: Callable[[State], Sequence[float]] = importance_of, callbacks: Sequence[Callable[[State], None]] = ()):  # noqa: ANN001
        super().__init__(estimator)
        self.n_features_to_select, self.step, self.importance, self.callbacks = n_features_to_select, step, importance, list(callbacks)

    def fit(self, df: DataFrame, features: Sequence[str], label: str, eval_df: DataFrame | None = None) -> RFE:
        remaining = list(features)
        n = self.n_features_to_select
        target = int(len(remaining) * n) if 0 < n < 1 else int(n)
        target = max(1, target)
        if len(remaining) < target:
            raise ValueError("there are fewer features than are to be selected")
        held = df.select(*dict.fromkeys(remaining), label).persist(StorageLevel.MEMORY_AND_DISK)
        iteration = 0
        try:
            while len(remaining) >= target and remaining:
                self.selected_features_ = list(remaining)
                self.estimator_ = self._fit(held, remaining, label)
                state = State(self.estimator_, held, label, list(remaining), iteration, eval_df)
                for callback in self.callbacks:
                    callback(state)
                if any(callable(getattr(c, "stop", None)) and c.stop() for c in self.callbacks):
                    break
                weights = self.importance(state)
                order = sorted(range(len(remaining)), key=lambda i: (-abs(weights[i]), i))
                keep = len(remaining) - step_size(len(remaining), self.step)
                remaining = [remaining[i] for i in order[: max(0, keep)]]
                iteration += 1
        finally:
            held.unpersist()
        return self

    def fit_transform(self, df: DataFrame, features: Sequence[str], label: str, eval_df: DataFrame | None = None):  # noqa: ANN201
        return self.fit(df, features, label, eval_df).transform()


class NFE(_Selector):
    """Noise elimination: keeps features whose importance is above that of a uniform noise column.

    ``key``: a whole-number column that seeds the noise of each row.
    """

    def __init__(self, estimator, importance: Callable[[State], Sequence[float]] = importance_of, seed: int = 208):  # noqa: ANN001
        super().__init__(estimator)
        self.importance, self.seed = importance, seed

    def fit(self, df: DataFrame, features: Sequence[str], label: str, key: str) -> NFE:
        noisy = df.select(*features, label, hash_uniform(self.seed, F.col(key)).alias(NOISE)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            every = [*features, NOISE]
            state = State(self._fit(noisy, every, label), noisy, label, every)
            weights = [abs(w) for w in self.importance(state)]
        finally:
            noisy.unpersist()
        self.estimator_ = state.model
        self.selected_features_ = [f for f, w in zip(features, weights, strict=False) if w > weights[-1]]
        return self

    def fit_transform(self, df: DataFrame, features: Sequence[str], label: str, key: str):  # noqa: ANN201
        """Fits, then fits again on the selected features."""
        self.fit(df, features, label, key)
        return self._fit(df, self.selected_features_, label) if self.selected_features_ else self.estimator_
