"""Session helpers shared by every subpackage: inputs and durable intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset a local master gets a temporary
    folder; a cluster gets a folder under the warehouse, never a machine-local one.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if conf.get("spark.master", "").startswith("local"):
        folder = "file://" + tempfile.mkdtemp(prefix="spark-chainweave-", dir="/tmp")
    else:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_chainweave"
        store = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        if folder.startswith("file:") or folder.startswith("/") and store.startswith("file:"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already; the shared folder is scratch space
        pass


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_table(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    The written table cuts the lineage and outlives any executor. It is removed when the
    session's process ends. If tidy, Spark drops the shuffle files of the write at its end, not when the
    driver's memory is next collected.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    try:
        if tidy:
            spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes staged tables that nothing will read again; a result that was made from them must be staged by then."""
    for t in tables:
        _drop(t.sparkSession, t._staged_at)
