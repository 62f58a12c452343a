"""Session settings and lineage."""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

#: Settings that the engine expects of a session.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.parquet.filterPushdown": "true"}

#: With this set, Spark deletes a query's shuffle files when it has run. Once a result is checkpointed nobody needs them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only on one machine, where it is unset, a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="siltlog-")


_lock, _cutting = threading.Lock(), {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder. While one runs, shuffle files of the session's queries are deleted as each query ends; the setting is put back when the
    last of them has run, so several threads may cut at once."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    key = id(spark._jsparkSession)
    with _lock:
        n, before = _cutting.get(key) or (0, spark.conf.get(CLEANUP, "false"))
        _cutting[key] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        with _lock:
            n, before = _cutting.pop(key)
            if n > 1:
                _cutting[key] = n - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def forget(*cut: DataFrame) -> None:
    """Delete the files of what cut_lineage returned, once nothing that reads it is to run any more."""
    for df in cut:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
