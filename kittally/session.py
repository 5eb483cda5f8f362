"""Session construction and the one setting the jobs take from the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Cell tables are long runs of like values: a megabyte of parquet or of shuffle files holds a hundred times
# the rows of other tables, and unfolding a row into its cells does not raise Spark's estimate. So joins are
# broadcast by measured row bytes only, and scans and shuffles are dealt in small parts.
BY_ROWS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "4m",
    "spark.sql.files.maxPartitionBytes": "4m",
    "spark.sql.files.openCostInBytes": "1m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}


def size_by_rows(spark: SparkSession) -> SparkSession:
    """The session with task and broadcast sizes that fit tables which compress well."""
    for key, value in BY_ROWS.items():
        spark.conf.set(key, value)
    return spark


def own_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the caller's settings and :data:`BY_ROWS`.

    Plans are made when rows are asked for, by the settings of their session at that time: whatever the caller
    sets or puts back after it got its result, a result of this session is planned by row sizes.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.get(key, None) != value:
            own.conf.set(key, value)
    return size_by_rows(own)


def build_session(master: str | None = None, app: str = "kittally", **conf) -> SparkSession:
    """Session with AQE on; a cluster passes its own master and checkpoint folder."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return size_by_rows(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="kittally-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    For results used several times downstream: they are computed once, survive lost executors
    and keep plans short.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/kittally-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def file_system(spark: SparkSession, folder: str):
    """Spark's own file system and path of a folder, whatever store it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def finished(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the completely written subfolders ``name=N`` of a folder, in order."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith(f"{name}=")]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = file_system(spark, folder)
    fs.delete(path, True)
