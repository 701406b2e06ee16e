"""Scratch folders that driver and executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"

#: Where each application writes, by its id and the folder set.
_roots: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a temporary folder serves a local master alone.

    All paths of an application lie in one folder, which goes by
    :func:`clear_scratch` or, stopped session or not, when the driver's JVM ends.
    """
    at = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    key = spark.sparkContext.applicationId, at or ""
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {KEY} to a folder that all executors share")
    if key not in _roots:
        root = f"{at or 'file://' + tempfile.mkdtemp(prefix='spark-')}/strandline-{uuid.uuid4().hex}"
        files, place = _place(spark, root)
        files.mkdirs(place)
        files.deleteOnExit(place)
        _roots[key] = root
    return f"{_roots[key]}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path there."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(sc._jsc.hadoopConfiguration()), place


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what the application wrote to scratch paths; DataFrames over them can't be read afterwards."""
    for key in [k for k in _roots if k[0] == spark.sparkContext.applicationId]:
        files, place = _place(spark, _roots.pop(key))
        files.delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch path and read again: cuts the lineage, and what it holds is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
