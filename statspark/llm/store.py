"""Scratch tables that survive the loss of an executor.

Iterative operators cut lineage by writing a parquet table to the folder that
the cluster shares, and reading it back. Operators delete the tables that nothing reads any more. A lazy result
still reads some; :func:`scratch` deletes these too, once the caller has used the result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables that have not been deleted, the oldest first.
_HELD: dict[str, None] = {}
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or else the one given to ``SparkContext.setCheckpointDir``.

    Where neither is set, a local session (tests) gets a temporary folder, which goes with the process; a session on a cluster raises
    RuntimeError, as its machines share no such folder.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if sc.applicationId not in _LOCAL:
            made = tempfile.mkdtemp(prefix="statspark-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _LOCAL[sc.applicationId] = "file://" + made
        folder = _LOCAL[sc.applicationId]
    return folder.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _HELD[path] = None
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _HELD.pop(path, None)


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables made by :func:`table`, once nothing reads them any more; anything else is left alone."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path in _HELD:
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession, *keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes all tables made inside the block when it ends, but those that the block appends to the list it is given."""
    before, kept = set(_HELD), list(keep)
    try:
        yield kept
    finally:
        for path in [p for p in _HELD if p not in before and all(getattr(df, "_scratch_path", None) != p for df in kept)]:
            _delete(spark, path)
