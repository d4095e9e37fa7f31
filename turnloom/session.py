"""Session factory and lineage cutting.

Nothing here changes the configuration of a session that already runs: the
cluster's own settings (shuffle partitions, checkpoint folder, broadcast
threshold) are read, never overwritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str | int = "*", app: str = "turnloom", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter makes it."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the session names in ``spark.checkpoint.dir``.

    Where that is unset, a local session (one machine) uses its warehouse
    folder. On a cluster it must be set: executors share no other folder.
    """
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = set_.get() if set_.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/turnloom-intermediate"


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _filesystem(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it from there.

    Used where a frame feeds several branches or a driver loop: the result
    survives the loss of executors and is computed once. :func:`discard` removes
    it when a later one has taken its place; else it goes with the session.
    """
    spark = df.sparkSession
    path = new_folder(spark, "cut")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._turnloom_path = path
    return kept


def discard(df: DataFrame) -> None:
    """Remove a table written by :func:`cut`; nothing may read it any more."""
    fs, where = _filesystem(df.sparkSession, df._turnloom_path)
    fs.delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
