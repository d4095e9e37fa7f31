"""Tar archives of recordings and annotations as a Spark data source.

``spark.read.format("tar_members").option("suffix", ".json").load(path)`` reads
every tar under a path: a partition per archive, members streamed, so a task
holds one member at a time.
"""

from __future__ import annotations

import io
import os
import tarfile
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class TarMembers(DataSource):
    """Rows ``archive``, ``member``, ``stem``, ``size``, ``content`` of a tar's files with a suffix."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "archive string, member string, stem string, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(self.options)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object stores) and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _TarReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self):
        where, name = _filesystem(self.path)
        info = where.get_file_info(name)
        if info.type == fs.FileType.Directory:
            found = sorted(x.path for x in where.get_file_info(fs.FileSelector(name)) if ".tar" in x.base_name and x.is_file)
        elif info.type == fs.FileType.File:
            found = [name]
        else:
            raise FileNotFoundError(self.path)
        return [_Archive(p) for p in found]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        where, _ = _filesystem(self.path)
        with where.open_input_stream(partition.path, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
            for member in tar:
                if member.isfile() and member.name.endswith(self.suffix):
                    content = tar.extractfile(member).read()
                    stem = os.path.basename(member.name).removesuffix(self.suffix)
                    yield partition.path, member.name, stem, len(content), content


def read_tar(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    spark.dataSource.register(TarMembers)
    return spark.read.format("tar_members").option("suffix", suffix).load(path)


def repeated_stems(members: DataFrame) -> DataFrame:
    """Stems of more than one member."""
    return members.groupBy("stem").agg(F.count("*").alias("members")).filter("members > 1")


def paired_members(audio: DataFrame, metadata: DataFrame, fatal: bool = False) -> tuple[DataFrame, DataFrame]:
    """Audio with its metadata by stem, and audio without any; metadata alone is ignored.

    If ``fatal``, audio without metadata is an error.
    """
    meta = metadata.select("stem", F.col("content").alias("metadata"))
    lone = audio.join(meta, "stem", "left_anti")
    if fatal:
        some = [r[0] for r in lone.select("stem").limit(5).collect()]
        if some:
            raise ValueError(f"audio without metadata: {some}")
    return audio.join(meta, "stem"), lone


def wav_header(content: bytes) -> tuple[int, int, int, int]:
    """Channels, bytes a sample, rate and frames of a WAV file."""
    with wave.open(io.BytesIO(content)) as w:
        return w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()


def read_wav(members: DataFrame) -> DataFrame:
    """``stem``, header fields, ``chunk_count`` (of 160 ms, in frames), ``pcm`` and ``error`` of WAV members.

    A file that can't be read has its error and nulls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for stem, content in pdf.itertuples(index=False):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        channels, width, rate, frames = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
                        chunk = rate * 160 // 1000
                        out.append((stem, channels, width, rate, frames, -(-frames // chunk), w.readframes(frames), None))
                except (wave.Error, EOFError, TypeError) as e:
                    out.append((stem, None, None, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["stem", "channels", "width", "rate", "frames", "chunk_count", "pcm", "error"]).astype({c: "Int64" for c in ("channels", "width", "rate", "frames", "chunk_count")})

    return members.select("stem", "content").mapInPandas(run, "stem string, channels int, width int, rate int, frames long, chunk_count long, pcm binary, error string")


def mono_float(content: bytes, rate: int = 16_000) -> np.ndarray:
    """Samples of a mono 16-bit WAV file as 32-bit floats in [-1, 1); any other format is an error."""
    with wave.open(io.BytesIO(content)) as w:
        if (w.getnchannels(), w.getsampwidth(), w.getframerate()) != (1, 2, rate):
            raise ValueError(f"not mono 16-bit at {rate} Hz")
        return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / np.float32(32_768)


def pcm16_wav(samples: bytes, rate: int = 16_000) -> bytes:
    """Mono 16-bit PCM as the bytes of a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()
