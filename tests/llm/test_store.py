import os
import subprocess
import sys
from pathlib import Path

import pytest

from statspark.llm import graph, simhash, store

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.sparkContext.getConf().get("spark.checkpoint.dir") is None
from statspark.llm import simhash, store
print("ROWS", simhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")).count(), store.shared_dir(spark))
"""


def test_a_local_session_without_the_setting_works_and_leaves_nothing(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    out = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300)
    line = next(x for x in out.stdout.splitlines() if x.startswith("ROWS"))
    _, n, folder = line.split()
    assert n == "2" and folder.startswith("file:///") and not Path(folder.removeprefix("file://")).exists()


def test_a_cluster_without_the_setting_is_an_error():
    class Context:
        master, applicationId = "spark://host:7077", "x"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        store.shared_dir(Session)


def test_scratch_deletes_what_the_block_does_not_keep(spark):
    before = set(store._HELD)
    with store.scratch(spark) as kept:
        kept.append(store.table(simhash.near_duplicates(spark.createDataFrame([(i, f"t{i // 2} x") for i in range(8)], "doc_id long, text string")), "out"))
        store.table(spark.range(3), "left")
    assert kept[0].count() == 8 and set(store._HELD) - before == {kept[0]._scratch_path}
    store.drop(kept[0])
    assert set(store._HELD) == before


def test_components_leave_one_table(spark):
    before = set(store._HELD)
    out = graph.components(spark.createDataFrame([(1, 2), (2, 3)], "u long, v long"))
    assert set(store._HELD) - before == {out._scratch_path}
    store.drop(out)
