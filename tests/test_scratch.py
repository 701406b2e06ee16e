"""Scratch folders go: on request while the session lives, and when its JVM ends."""

import os
import subprocess
import sys
import tempfile

from strandline.plans.registry import load
from strandline.sources.scratch import clear_scratch, scratch

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
AFTER_STOP = """
import sys
from pyspark.sql import SparkSession
from strandline.plans.registry import load
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
for name in ("source_orc", "stream_distinct_users"):
    load()[0][name](spark, sys.argv[2]).count()
import os
assert sum(x.startswith("strandline") for x in os.listdir(sys.argv[1])) == 1
spark.stop()
"""


def test_clear(spark, sf_dir):
    df = load()[0]["source_csv"](spark, sf_dir)
    assert df.count() > 0
    files = [f.removeprefix("file://") for f in df.inputFiles()]
    assert all(os.path.exists(f) for f in files)
    one, two = scratch(spark, "x"), scratch(spark, "x")
    assert one != two and os.path.dirname(one) == os.path.dirname(two)
    clear_scratch(spark)
    assert not any(os.path.exists(f) for f in files)
    clear_scratch(spark)


def test_gone_after_stop(sf_dir):
    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    env = os.environ | {"PYTHONPATH": ROOT}
    subprocess.run([sys.executable, "-c", AFTER_STOP, at, sf_dir], check=True, env=env, timeout=300, capture_output=True)
    assert not [x for x in os.listdir(at) if x.startswith("strandline")]
