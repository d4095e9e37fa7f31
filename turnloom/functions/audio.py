"""PCM arithmetic in numpy, for use inside pandas UDFs and ``mapInPandas``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.hashing import signature

RATE, SOURCE_RATE, CHUNK_MS = 16_000, 48_000, 160


def channel(pcm: bytes, channels: int, index: int) -> np.ndarray:
    """One channel of interleaved little-endian 16-bit samples."""
    return np.frombuffer(pcm, "<i2").reshape(-1, channels)[:, index]


def third_rate(samples: np.ndarray, beta: float = 5.0, reach: int = 10) -> np.ndarray:
    """48 kHz to 16 kHz: a Kaiser-windowed low pass, every third sample, rounded and clipped to 16 bits.

    The result has ``ceil(n / 3)`` samples; no samples give none.
    """
    if not len(samples):
        return np.empty(0, np.int16)
    half = reach * 3
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / 3) / 3 * np.kaiser(2 * half + 1, beta)
    smooth = np.convolve(samples.astype(np.float64), taps / taps.sum(), "full")[half : half + len(samples)]
    return np.clip(np.rint(smooth[::3]), -32_768, 32_767).astype(np.int16)


def pad_to_chunk(samples: np.ndarray, size: int = RATE * CHUNK_MS // 1000) -> tuple[np.ndarray, int]:
    """Zeros appended up to a whole number of chunks, and how many."""
    padding = -len(samples) % size
    return np.pad(samples, (0, padding)), padding


def segments(samples: np.ndarray, size: int = 30 * RATE) -> list[np.ndarray]:
    """Consecutive parts of at most ``size`` samples; joined they are the input."""
    return [samples[i : i + size] for i in range(0, len(samples), size)]


#: What audio was made by: part of its signature, so that a change of method makes other signatures.
PROFILE = "kaiser-5-third-rate-pad-160ms"


def audio_manifest(made: DataFrame) -> DataFrame:
    """What :func:`target_audio` made of each view, without the samples: hash, lengths, chunks, and a signature."""
    padded = F.col("frames") + F.col("padding")
    rows = made.select(
        "view_id", "frames", F.col("padding").alias("padding_samples"), padded.alias("padded_frames"), F.floor(padded * 1000 / (RATE * CHUNK_MS)).alias("chunk_count"),
        F.sha2("audio", 256).alias("audio_sha256"), F.lit(RATE).alias("sample_rate"), (F.col("frames") * 1000.0 / RATE).alias("duration_ms"),
    )
    return rows.withColumn("signature", signature(audio=F.col("audio_sha256"), profile=F.lit(PROFILE), rate=F.col("sample_rate"), view=F.col("view_id")))


def target_audio(rows: DataFrame) -> DataFrame:
    """Per row of ``view_id``, ``pcm`` (interleaved, 48 kHz), ``channels``, ``target``: the track at 16 kHz.

    Returns ``view_id``, ``audio`` (16-bit PCM, padded to chunks), ``frames``
    and ``padding``. A null ``pcm`` gives null audio and zero frames.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for view, pcm, channels, target in pdf.itertuples(index=False):
                if pcm is None:
                    out.append((view, None, 0, 0))
                    continue
                low = third_rate(channel(pcm, channels, target))
                padded, padding = pad_to_chunk(low)
                out.append((view, padded.astype("<i2").tobytes(), len(low), padding))
            yield pd.DataFrame(out, columns=["view_id", "audio", "frames", "padding"])

    return rows.select("view_id", "pcm", "channels", "target").mapInPandas(run, "view_id string, audio binary, frames long, padding long")
