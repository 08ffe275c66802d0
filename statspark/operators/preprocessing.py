"""Scalers and one-hot encoding as plain column arithmetic.

``fit`` runs one aggregation and keeps a few numbers for each column; ``transform``
then adds no job and no shuffle. ``run`` does both lazily in one plan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..core import columns_of, number, sdiv
from ..plans.prefix import quantiles
from ..sources.io import load_params, load_table, save_params, save_table


class _Scaler:
    """A linear map of each column: x * scale + shift, with scale and shift from one aggregation. Nulls and NaN take no part in fitting and stay as they are."""

    def __init__(self) -> None:
        self.columns: list[str] = []
        self.scale_: dict[str, float | None] = {}
        self.shift_: dict[str, float | None] = {}

    def _options(self) -> dict:
        return {}

    def _stats(self, c: str) -> dict[str, Column]:
        raise NotImplementedError

    def _map(self, s: dict[str, Column]) -> tuple[Column, Column]:
        """Scale and shift from statistics."""
        raise NotImplementedError

    def _fitted(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """One row with scale_i and shift_i of the i-th column."""
        names = {i: list(self._stats(c)) for i, c in enumerate(columns)}
        stats = df.agg(*(e.alias(f"{k}_{i}") for i, c in enumerate(columns) for k, e in self._stats(c).items()))
        maps = {i: self._map({k: F.col(f"{k}_{i}") for k in ks}) for i, ks in names.items()}
        return stats.select(*(e.alias(f"{n}_{i}") for i, m in maps.items() for n, e in zip(("scale", "shift"), m, strict=True)))

    def fit(self, df: DataFrame, columns: str | Iterable[str] | None = None) -> _Scaler:
        self.columns = columns_of(df, columns)
        row = self._fitted(df, self.columns).first()
        self.scale_ = {c: row[f"scale_{i}"] for i, c in enumerate(self.columns)}
        self.shift_ = {c: row[f"shift_{i}"] for i, c in enumerate(self.columns)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        lit = lambda v: F.lit(v).cast("double")
        return df.withColumns({c: F.col(c) * lit(self.scale_[c]) + lit(self.shift_[c]) for c in self.columns})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        lit = lambda v: F.lit(v).cast("double")
        return df.withColumns({c: sdiv(F.col(c) - lit(self.shift_[c]), lit(self.scale_[c])) for c in self.columns})

    def fit_transform(self, df: DataFrame, columns: str | Iterable[str] | None = None) -> DataFrame:
        return self.fit(df, columns).transform(df)

    def run(self, df: DataFrame, columns: str | Iterable[str] | None = None) -> DataFrame:
        """Fits and transforms without an action; the one row of parameters is broadcast."""
        cols = columns_of(df, columns)
        fitted = self._fitted(df, cols)
        fitted = fitted.select(*(F.col(c).alias(f"__{c}") for c in fitted.columns))
        out = df.crossJoin(F.broadcast(fitted)).withColumns({c: F.col(c) * F.col(f"__scale_{i}") + F.col(f"__shift_{i}") for i, c in enumerate(cols)})
        return out.select(*df.columns)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes options and parameters."""
        save_params(spark, path, {"kind": type(self).__name__, "options": self._options(), "columns": self.columns, "scale": self.scale_, "shift": self.shift_})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> _Scaler:
        p, _ = load_params(spark, path)
        if p["kind"] != cls.__name__:
            raise ValueError(f"{path} holds a {p['kind']}")
        out = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in p["options"].items()})
        out.columns, out.scale_, out.shift_ = p["columns"], p["scale"], p["shift"]
        return out


class MinMaxScaler(_Scaler):
    """Maps the range of a column to ``feature_range``; a constant column becomes NULL."""

    def __init__(self, feature_range: tuple[float, float] = (0.0, 1.0)):
        super().__init__()
        self.feature_range = feature_range

    def _options(self) -> dict:
        return {"feature_range": list(self.feature_range)}

    def _stats(self, c: str) -> dict[str, Column]:
        x = number(c)
        return {"lo": F.min(x), "hi": F.max(x)}

    def _map(self, s: dict[str, Column]) -> tuple[Column, Column]:
        a, b = self.feature_range
        scale = sdiv(F.lit(float(b - a)), s["hi"] - s["lo"])
        return scale, F.lit(float(a)) - s["lo"] * scale


class StandardScaler(_Scaler):
    """Subtracts the mean and divides by the standard deviation with ``ddof``."""

    def __init__(self, ddof: int = 1):
        super().__init__()
        self.ddof = ddof

    def _options(self) -> dict:
        return {"ddof": self.ddof}

    def _stats(self, c: str) -> dict[str, Column]:
        x = number(c)
        return {"mean": F.avg(x), "var": F.var_pop(x), "n": F.count(x)}

    def _map(self, s: dict[str, Column]) -> tuple[Column, Column]:
        left = s["n"] - self.ddof
        scale = sdiv(F.lit(1.0), F.sqrt(F.when(left > 0, s["var"] * s["n"] / left)))
        return scale, -s["mean"] * scale


class RobustScaler(_Scaler):
    """Subtracts the median and divides by the width of ``quantile_range``, with exact quantiles (``exact=False``: approximate)."""

    def __init__(self, quantile_range: tuple[float, float] = (0.25, 0.75), exact: bool = True):
        super().__init__()
        self.quantile_range, self.exact = quantile_range, exact

    def _options(self) -> dict:
        return {"quantile_range": list(self.quantile_range), "exact": self.exact}

    def _stats(self, c: str) -> dict[str, Column]:
        return {"q": F.percentile_approx(number(c), F.array(*(F.lit(p) for p in self._levels())), F.lit(10_000))}

    def _levels(self) -> list[float]:
        return [self.quantile_range[0], 0.5, self.quantile_range[1]]

    def _fitted(self, df: DataFrame, columns: list[str]) -> DataFrame:
        if not self.exact:
            return super()._fitted(df, columns)
        # All columns in one pass: (column, value) rows, and their quantiles by prefix sums.
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), number(c).alias("x")) for i, c in enumerate(columns)))).alias("r")
        found = quantiles(df.select(each).select("r.*").dropna(), "x", self._levels(), "q", "i")
        one = found.agg(*(F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q_{i}") for i in range(len(columns))))
        maps = [self._map({"q": F.col(f"q_{i}")}) for i in range(len(columns))]
        return one.select(*(e.alias(f"{n}_{i}") for i, m in enumerate(maps) for n, e in zip(("scale", "shift"), m, strict=True)))

    def _map(self, s: dict[str, Column]) -> tuple[Column, Column]:
        scale = sdiv(F.lit(1.0), F.get(s["q"], F.lit(2)) - F.get(s["q"], F.lit(0)))
        return scale, -F.get(s["q"], F.lit(1)) * scale


class OneHotEncoder:
    """Adds a boolean ``<column>_<value>`` for each distinct value; NULL stays NULL, and an unseen value is false everywhere."""

    def __init__(self, max_categories: int = 10_000):
        #: More categories raise ValueError: each becomes a column.
        self.max_categories = max_categories
        self.categories_: dict[str, list] = {}
        self.types_: dict[str, DataType] = {}

    def fit(self, df: DataFrame, columns: str | Iterable[str] | None = None) -> OneHotEncoder:
        self.categories_, self.types_ = {}, {}
        for c in columns_of(df, columns):
            found = [r[0] for r in df.select(c).dropna().distinct().limit(self.max_categories + 1).collect()]
            if len(found) > self.max_categories:
                raise ValueError(f"{c} has over {self.max_categories} categories")
            self.categories_[c], self.types_[c] = sorted(found), df.schema[c].dataType
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}_{v}": F.col(c) == F.lit(v) for c, vs in self.categories_.items() for v in vs})

    def fit_transform(self, df: DataFrame, columns: str | Iterable[str] | None = None) -> DataFrame:
        return self.fit(df, columns).transform(df)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the options as JSON and each column's categories as a table, so that dates, decimals and all other types come back as they are."""
        save_params(spark, path, {"kind": "OneHotEncoder", "max_categories": self.max_categories, "columns": list(self.categories_)})
        for i, c in enumerate(self.categories_):
            save_table(spark, f"{path}/categories-{i}", self.types_[c], self.categories_[c])

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OneHotEncoder:
        p, _ = load_params(spark, path)
        out = cls(p["max_categories"])
        for i, c in enumerate(p["columns"]):
            out.types_[c], out.categories_[c] = load_table(spark, f"{path}/categories-{i}")
        return out
