"""JSON and parquet in and out, checksums, and publishing a finished folder at once."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Objects of a JSON-lines file under a fixed schema; blank lines are skipped, anything else fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_requests(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Request records of a ``.jsonl`` file, or the single object of any other."""
    return read_jsonl(spark, path, schema) if path.endswith(".jsonl") else read_json_document(spark, path, schema)


def unsafe_path(path: Column) -> Column:
    """Is a listed path absolute, or does it leave its folder? So are null and empty ones."""
    return F.coalesce((path == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), ".."), F.lit(True))


def read_listed(spark: SparkSession, path: str, field: str = "wav") -> DataFrame:
    """Paths listed in a JSON-lines file with their ``place``, and whether they are ``safe``.

    The place counts the lines of the file, which aren't blank, in order: lines are
    numbered within each split of the file, and splits by a table of their sizes.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.filter(F.trim("value") != "")
    inside = F.row_number().over(Window.partitionBy("block").orderBy("line")) - 1
    sizes = lines.groupBy("block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.withColumn("inside", inside).join(sizes.select("block", before.alias("before")), "block")
    name = F.get_json_object("value", f"$.{field}")
    return placed.select((F.col("before") + F.col("inside")).cast("bigint").alias("place"), name.alias("path"), (~unsafe_path(name)).alias("safe"))


def walked(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """``place``, ``path`` (relative), ``safe`` of the files below a folder, in the order of their paths; nothing is read of them."""
    root = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select(F.element_at(F.split("path", root), -1).alias("path"))
    # a test set is some thousand names
    return files.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path")) - 1).cast("bigint").alias("place"), "path", (~unsafe_path(F.col("path"))).alias("safe"))


def discovery_faults(samples: DataFrame, label: str, expected: int) -> DataFrame:
    """What is wrong with a discovered test set: ``unsafe``, ``repeated`` and mislabelled paths, and their number if it isn't ``expected``.

    A path's label is the name of a folder in it.
    """
    named = F.array_contains(F.split("path", "/"), label)
    each = samples.select("path", F.explode(F.array_compact(F.array(F.when(~F.col("safe"), "unsafe"), F.when(~F.coalesce(named, F.lit(False)), "label")))).alias("fault"))
    twice = samples.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select("path", F.lit("repeated").alias("fault"))
    number = samples.agg(F.count("*").alias("n")).filter(F.col("n") != expected).select(F.col("n").cast("string").alias("path"), F.lit("number").alias("fault"))
    return each.unionByName(twice).unionByName(number)


def read_secret(path: str, name: str) -> str:
    """A value of a protected file of ``NAME=value`` lines, which nobody but its owner may read."""
    import os
    import stat

    if stat.S_IMODE(os.stat(path).st_mode) != 0o600:
        raise PermissionError(f"{path} must have mode 0600")
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, found, value = line.strip().partition("=")
            if found and key.strip() == name and value.strip().strip("'\""):
                return value.strip().strip("'\"")
    raise KeyError(name)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in alphabetical order and nulls written out."""
    df.select(*sorted(df.columns)).write.option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def inventory(spark: SparkSession, folder: str, pattern: str = "*", block: int = 8 * 2**20) -> DataFrame:
    """``path`` (relative), ``size`` and ``sha256`` of every file below a folder.

    Files are listed without their content and then read in blocks, so their size
    doesn't matter.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    root = folder.rstrip("/") + "/"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            digests = []
            for path in pdf["path"]:
                # one slash after the scheme is a local path
                where, name = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
                digest = hashlib.sha256()
                with where.open_input_stream(name) as f:
                    while part := f.read(block):
                        digest.update(part)
                digests.append(digest.hexdigest())
            yield pdf.assign(sha256=digests)

    hashed = files.mapInPandas(run, "path string, length bigint, sha256 string")
    return hashed.select(F.element_at(F.split("path", root), -1).alias("path"), F.col("length").alias("size"), "sha256")


def checksum_lines(files: DataFrame) -> DataFrame:
    """``sha256  path`` a line, by path."""
    return files.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))


def checksum_faults(spark: SparkSession, expected: DataFrame, folder: str) -> DataFrame:
    """Paths of an ``expected`` (path, sha256) that are repeated, missing or changed, and files it doesn't name."""
    found = inventory(spark, folder).select("path", F.col("sha256").alias("found"))
    counted = expected.groupBy("path").agg(F.count("*").alias("entries"), F.first("sha256").alias("sha256"))
    both = counted.join(found, "path", "full_outer")
    fault = (
        F.when(F.col("entries") > 1, "repeated").when(F.col("found").isNull(), "missing")
        .when(F.col("entries").isNull(), "unnamed").when(F.col("sha256") != F.col("found"), "changed")
    )
    return both.select("path", fault.alias("fault")).filter("fault is not null")


def publish(spark: SparkSession, target: str, write) -> None:
    """Let ``write(folder)`` fill a new folder beside ``target``, then rename it there.

    An existing target is refused; if writing fails, nothing is left behind.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(target)):
        raise FileExistsError(target)
    staged = f"{target}.{uuid.uuid4().hex}.tmp"
    try:
        write(staged)
        if not fs.rename(path(staged), path(target)):
            raise OSError(f"{staged} could not be renamed to {target}")
    except BaseException:
        fs.delete(path(staged), True)
        raise


def replace(spark: SparkSession, target: str, write) -> None:
    """Let ``write(folder)`` fill a new folder, then put it in the place of ``target``, which may exist.

    The old one is moved aside first and comes back if the new one can't be put in its place.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    staged, old = f"{target}.{mark}.tmp", f"{target}.{mark}.old"
    try:
        write(staged)
        moved = fs.exists(path(target)) and fs.rename(path(target), path(old))
        if not fs.rename(path(staged), path(target)):
            if moved:
                fs.rename(path(old), path(target))
            raise OSError(f"{staged} could not be renamed to {target}")
    except BaseException:
        fs.delete(path(staged), True)
        raise
    fs.delete(path(old), True)
