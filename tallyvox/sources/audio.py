"""Audio files: listing, pairing with tickets, probing and decoding of PCM and float WAV."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyvox.sources.tickets import stem, suffix

RATE = 16_000
#: Suffixes of audio files.
SUFFIXES = [".wav", ".mp3", ".m4a", ".flac", ".ogg", ".aac", ".wma", ".opus"]


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files of a folder, or of one file.

    Listed through the file system of the path, since Spark's readers leave out names that begin with an underscore; decoded()
    takes files from such a reader, so those have to be renamed first.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return spark.createDataFrame([(f.getPath().toString(), f.getLen()) for f in found if f.isFile()], "path string, length bigint")


def clips(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """path, seq of audio files: from the manifest (name, seq), else the first number in the name; sort by path."""
    found = files.filter(suffix(F.col("path")).isin(SUFFIXES)).withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    number = F.regexp_extract(stem(F.col("path")), "(\\d+)", 1).try_cast("int")
    if manifest is None:
        return found.select("path", "name", number.alias("seq"))
    listed = found.join(manifest.select("name", F.col("seq").alias("listed")), "name", "left")
    return listed.select("path", "name", F.coalesce("listed", number).alias("seq"))


def recordings(files: DataFrame, include_full: bool = False) -> DataFrame:
    """Audio files but, unless wanted, those whose name begins with an underscore."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.filter(suffix(F.col("path")).isin(SUFFIXES) & (F.lit(include_full) | ~name.startswith("_")))


def pairs(tickets: DataFrame, audio: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tickets (name, ticket_path) with their audio (name, audio_path, rank; the lowest rank wins), and the names that lack one of both."""
    best = audio.groupBy("name").agg(F.min_by("audio_path", "rank").alias("audio_path"))
    both = tickets.join(best, "name", "full")
    whole = F.col("ticket_path").isNotNull() & F.col("audio_path").isNotNull()
    return both.filter(whole), both.filter(~whole).select("name", F.when(F.col("ticket_path").isNull(), "ticket").otherwise("audio").alias("missing"))


def resampled(samples: np.ndarray, rate: int, target: int = RATE) -> np.ndarray:
    if rate == target or not len(samples):
        return samples.astype(np.float32)
    n = int(round(len(samples) * target / rate))
    return np.interp(np.arange(n) * rate / target, np.arange(len(samples)), samples).astype(np.float32)


#: Format tags of WAV files, and how many bytes at a file's start must hold its header.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
HEAD = 65_536


def wav_header(content: bytes) -> tuple[int, int, int, int, int, int]:
    """Format tag, channels, rate, bytes a sample, and the data's place and stated size. ValueError if that can't be told."""
    import struct

    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, kind = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        if name == b"fmt ":
            if len(content) < at + 24:
                break
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            if tag == EXTENSIBLE and len(content) >= at + 34:
                tag = int.from_bytes(content[at + 32 : at + 34], "little")
            kind = (tag, channels, rate, bits // 8)
        elif name == b"data" and kind:
            if kind[0] not in (PCM, FLOAT) or not kind[1] or kind[3] not in ((4, 8) if kind[0] == FLOAT else (1, 2, 3, 4)):
                raise ValueError(f"format {kind[0]} of {8 * kind[3]} bits in {kind[1]} channels")
            return *kind, at + 8, size
        at += 8 + size + size % 2
    raise ValueError("no data chunk in the first bytes")


def probed(files: DataFrame) -> DataFrame:
    """path, rate, channels, seconds, status of binary files (path, length, content) by their headers; only the first bytes go to Python.

    A header that can't be read gives nulls, 0 seconds and the error as its status.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, length, head in zip(batch["path"], batch["length"], batch["head"]):
                try:
                    _, channels, rate, width, at, size = wav_header(bytes(head))
                    frames = min(size, max(int(length) - at, 0)) // (width * channels)
                    rows.append((path, rate, channels, frames / rate if rate else 0.0, "ok"))
                except Exception as e:  # noqa: BLE001  any broken file is reported, not fatal
                    rows.append((path, None, None, 0.0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "seconds", "status"]).astype({"rate": "Int64", "channels": "Int64"})

    return files.select("path", "length", F.substring("content", 1, HEAD).alias("head")).mapInPandas(run, "path string, rate bigint, channels bigint, seconds double, status string")


def decoded_wav(content: bytes, target: int = RATE) -> tuple[np.ndarray, float]:
    """Mono samples in [-1, 1] at the target rate, and the duration in seconds."""
    tag, channels, rate, width, at, size = wav_header(content)
    whole = min(size, len(content) - at) // (width * channels) * width * channels
    data = content[at : at + whole]
    if tag == FLOAT:
        x = np.frombuffer(data, dtype=f"<f{width}").astype(np.float64)
    elif width == 1:
        x = (np.frombuffer(data, dtype=np.uint8).astype(np.float64) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000) / float(1 << 23)
    else:
        x = np.frombuffer(data, dtype=f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(axis=1) if channels else x
    return resampled(x, rate, target), (len(x) / rate if rate else 0.0)


def decoded(files: DataFrame, target: int = RATE) -> DataFrame:
    """path, wave (array<float>), seconds, status of binary files (path, content); a file that can't be decoded has no wave, 0 seconds and the error as its status."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    wave, seconds = decoded_wav(content, target)
                    rows.append((path, wave, seconds, "ok"))
                except Exception as e:  # noqa: BLE001  any broken file is reported, not fatal
                    rows.append((path, None, 0.0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "wave", "seconds", "status"])

    return files.select("path", "content").mapInPandas(run, "path string, wave array<float>, seconds double, status string")
