"""Streaming forms: tumbling activity, first-seen results, and replaying a table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.session import new_folder


def tumbling(rows: DataFrame, at: str, width: str, keys: list[str], value: str = "value") -> DataFrame:
    """Count and sum per window and key; the same for a batch and a stream."""
    window = F.window(at, width)
    counted = rows.groupBy(window, *keys).agg(F.count("*").alias("events"), F.round(F.sum(value), 6).alias("value"))
    return counted.select(F.col("window.start").alias("start"), *keys, "events", "value")


def first_seen(rows: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """A stream's first row per key within the watermark: what a cache would have to compute."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def split_late(rows: DataFrame, at: str, arrived: str, late: str) -> tuple[DataFrame, DataFrame]:
    """Rows that arrived in time, and those to be quarantined."""
    limit = F.col(at) + F.expr(f"interval {late}")
    return rows.filter(F.col(arrived) <= limit), rows.filter(F.col(arrived) > limit)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream, its files in batches."""
    schema = spark.read.parquet(path).schema
    folder = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{folder[0]}/{folder[1]}*")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def replayed_tumbling(spark: SparkSession, path: str, at: str, width: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Run :func:`tumbling` as a stream over all files of a table and return what it wrote.

    Complete mode writes the state of all windows, so nothing waits behind a
    watermark. State and result lie in the shared folder; a run that names the
    ``folder`` of an earlier one goes on from its state and reads new files only.
    """
    base = folder or new_folder(spark, "replay")
    result = tumbling(stream_of(spark, path), at, width, keys)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    query = result.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")
