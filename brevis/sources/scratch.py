"""Tables that a query makes for itself: stored as Parquet in the folder that executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir; a temporary folder only where that is unset and the master is local; else none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    return f"file://{tempfile.gettempdir()}/brevis-scratch" if spark.sparkContext.master.startswith("local") else None


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once and read again, so that what uses it twice computes it once and a lost executor loses nothing; df itself where there is no shared folder."""
    root = scratch_root(df.sparkSession)
    if root is None:
        return df
    path = f"{root}/brevis/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, DataFrame] = {}


def state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at path: what a table made from them depends on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))


def kept(make, tag: str, path: str, spark: SparkSession) -> DataFrame:
    """The table that make() gives for the files at path: stored when first asked for, and again when the files change, for as long as the application runs."""
    if scratch_root(spark) is None:
        return make()
    key = (spark.sparkContext.applicationId, tag, path, state(spark, path))
    if key not in _KEPT:
        _KEPT[key] = stored(make(), tag)
    return spark.read.schema(_KEPT[key].schema).parquet(*_KEPT[key].inputFiles()) if _KEPT[key].sparkSession is not spark else _KEPT[key]
