"""Metrics over event-time windows of a stream.

Every count metric is a sum over rows, so a stream keeps four sums for each window, and
the watermark bounds how long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import number, truth
from ..operators.metrics import CONFUSION, derive


def windowed_confusion_matrix(stream: DataFrame, time: str, y_true: str, y_pred: str, window: str = "1 hour", slide: str | None = None, watermark: str = "1 hour", weight: str | None = None, beta: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """(start, end, by, 27 measures) for tumbling or sliding windows; rows later than the watermark are dropped. Works on streams and tables."""
    w = F.lit(1.0) if weight is None else number(weight)
    rows = stream.select(F.col(time).alias("t"), *by, truth(y_true).alias("y"), truth(y_pred).alias("p"), w.alias("w")).dropna(subset=["t", "y", "p", "w"])
    cell = lambda y, p: F.sum(F.when((F.col("y") == y) & (F.col("p") == p), F.col("w")).otherwise(0.0))
    frame = F.window("t", window, slide) if slide else F.window("t", window)
    sums = rows.withWatermark("t", watermark).groupBy(frame.alias("win"), *by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    return derive(sums, beta).select(F.col("win.start").alias("start"), F.col("win.end").alias("end"), *by, *CONFUSION)


def windowed_mean_squared_error(stream: DataFrame, time: str, y_true: str, y_score: str, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """(start, end, mean_squared_error, n)."""
    d = number(y_true) - number(y_score)
    rows = stream.select(F.col(time).alias("t"), (d * d).alias("v")).dropna()
    out = rows.withWatermark("t", watermark).groupBy(F.window("t", window).alias("win")).agg(F.avg("v").alias("mean_squared_error"), F.count("*").alias("n"))
    return out.select(F.col("win.start").alias("start"), F.col("win.end").alias("end"), "mean_squared_error", "n")
