"""Input coercion and small helpers that all operators share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

By = str | Sequence[str] | None


def groups(by: By) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def columns_of(df: DataFrame, columns: str | Iterable[str] | None) -> list[str]:
    """None stands for all columns, a string for one."""
    return list(df.columns) if columns is None else [columns] if isinstance(columns, str) else list(columns)


def sdiv(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0 or either is NULL."""
    return F.try_divide(a, b)


def number(c: str | Column) -> Column:
    """As double, NaN as NULL."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def truth(c: str | Column) -> Column:
    """A label as 0.0 or 1.0: booleans as they are, numbers by being nonzero."""
    x = F.col(c) if isinstance(c, str) else c
    return x.cast("boolean").cast("double")


def coerce(df: DataFrame, by: By = None, weight: str | None = None, **values: Column) -> DataFrame:
    """Groups, the given values and the weight ``w`` (1.0 by default), without rows that miss any value."""
    # A weight w that cannot be null has been coerced before. A test of it would be pushed below whatever computes it.
    clean = weight is None or weight == "w" and (df.schema[weight].dataType.simpleString() == "double" and not df.schema[weight].nullable)
    w = F.lit(1.0) if weight is None else F.col(weight) if clean else number(weight)
    out = df.select(*groups(by), *(v.alias(k) for k, v in values.items()), w.alias("w"))
    return out.dropna(subset=[*values, *([] if clean else ["w"])])


def from_arrays(spark: SparkSession, **columns: Sequence) -> DataFrame:
    """A table from local arrays of one length (lists, numpy arrays, pandas or Arrow columns); nulls stay null."""
    arrays = {k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
    if len({len(v) for v in arrays.values()}) > 1:
        raise ValueError("all columns must have the same length")
    return spark.createDataFrame(pa.table(arrays))


def join_groups(left: DataFrame, right: DataFrame, by: By, how: str = "inner") -> DataFrame:
    """Joins on group columns, null groups included; without groups, ``right`` must have one row, which is broadcast."""
    keys = groups(by)
    if not keys:
        return left.crossJoin(F.broadcast(right))
    renamed = right.select(*(F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    return left.join(renamed, on, how).drop(*(f"__g{i}" for i in range(len(keys))))
