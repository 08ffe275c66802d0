"""Readers and writers: any Spark source by name, and fitted parameters as parquet and JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

FORMATS = ("parquet", "orc", "csv", "json", "text", "jdbc", "table")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Reads a table; csv and json need a schema, so that no pass over the data infers it."""
    if kind not in FORMATS:
        raise ValueError(f"`kind` must be one of {FORMATS}")
    if kind == "table":
        return spark.table(path)
    reader = spark.read.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    elif kind in ("csv", "json"):
        raise ValueError(f"{kind} needs a schema")
    return reader.load() if kind == "jdbc" else reader.load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:  # noqa: ANN003
    """Writes a table."""
    out = df.write.format(kind).mode(mode).options(**options)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.saveAsTable(path) if kind == "table" else out.save(path)


def save_params(spark: SparkSession, path: str, params: dict, tables: dict[str, DataFrame] | None = None) -> None:
    """Writes JSON parameters and tables below ``path``, through Spark's file systems."""
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")
    for name, df in (tables or {}).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_params(spark: SparkSession, path: str, tables: tuple[str, ...] = ()) -> tuple[dict, dict[str, DataFrame]]:
    """What save_params wrote."""
    params = json.loads(spark.read.text(f"{path}/params").first()[0])
    return params, {t: spark.read.parquet(f"{path}/{t}") for t in tables}


def save_table(spark: SparkSession, path: str, kind: DataType, values: list) -> None:
    """Writes a short list of values of one type."""
    schema = StructType([StructField("value", kind)])
    spark.createDataFrame([(v,) for v in values], schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> tuple[DataType, list]:
    """The type and the sorted values that save_table wrote."""
    df = spark.read.parquet(path)
    return df.schema["value"].dataType, sorted(r["value"] for r in df.collect())
