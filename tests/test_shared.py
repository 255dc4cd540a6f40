"""The shared folder, in a session of its own without Spark's default file."""

import os
import subprocess
import sys
import time
from pathlib import Path

from jobloom.sources.shared import staged

SCRIPT = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master({master!r}).config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from jobloom.sources.shared import shared_copy, shared_folder, staged
assert shared_folder(spark) == shared_folder(spark)
assert staged(spark.range(5)).count() == 5
assert shared_copy(spark.range(7)).count() == 7
print("worked")
"""


def test_plain_local_session_gets_one_temporary_folder(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(master="local[2]")], env=env, cwd=tmp_path,
                          capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("worked"), done.stderr[-2000:]
    assert len(list(tmp_path.glob("jobloom-*"))) == 1


def test_staging_leaves_no_shuffle_files(spark):
    """Their rows are read from storage; other queries keep their setting."""
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in found.mkString("\n").split("\n") if f.endswith(".data") and "shuffle_" in f}

    before = files()
    kept = staged(spark.range(1000).repartition(3).groupBy("id").count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert kept.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
