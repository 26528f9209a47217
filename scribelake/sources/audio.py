"""Recordings in and out: WAV files to runs of samples, runs of samples to WAV."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions import text as X
from scribelake.operators.signal import RATE
from scribelake.sources.wav_source import HEADER, RUN, can_read, header, mounted, read_samples, read_track, read_wav, write_wav

# What counts as a recording. Only WAV is decoded here; other kinds need a decoder of your own.
EXTENSIONS = (".wav", ".mp3", ".m4a", ".flac", ".aac", ".ogg", ".opus", ".wma", ".mp4")


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the audio files below a path, whatever the case of their suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(X.extension(F.col("path")).isin(*EXTENSIONS)).select("path", "content")


def decode(content: bytes) -> np.ndarray:
    """16 kHz mono 16-bit samples of a whole WAV; channels are averaged, other rates filtered. No sound is a ValueError."""
    track = read_track("the file", content)
    return read_samples(track, 0, track.length, content)


def read_recordings(spark: SparkSession, path: str, decoders: dict[str, Callable[[bytes], np.ndarray]] | None = None) -> DataFrame:
    """(path, offset, samples) of one recording: a WAV is read in parts by many tasks, unless ``decoders`` has a way of its own
    or its file system is known to Spark alone; any other kind as a whole."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".wav" and suffix not in (decoders or {}) and can_read(path):
        return read_wav(spark, path)
    return decode_recordings(recordings(spark, path), decoders=decoders)


def decode_recordings(files: DataFrame, run: int = RUN, decoders: dict[str, Callable[[bytes], np.ndarray]] | None = None) -> DataFrame:
    """(path, offset, samples) in runs of a second.

    WAV is decoded here. Another kind needs an entry in ``decoders``, by suffix: a function from a file's bytes to 16 kHz
    mono 16-bit samples. A file of a kind without one, or without sound, is a ValueError that names it.
    """
    known = {".wav": decode} | (decoders or {})

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                made = known.get(os.path.splitext(path)[1].lower())
                if made is None:
                    raise ValueError(f"no decoder for {path}")
                try:
                    sound = made(content)
                except ValueError as error:
                    raise ValueError(f"no sound in {path}: {error}") from error
                at = range(0, len(sound), run)
                yield pd.DataFrame({"path": path, "offset": list(at), "samples": [sound[i : i + run] for i in at]})

    return files.select("path", "content").mapInPandas(decoded, "path string, offset long, samples array<smallint>")


def samples_between(runs: DataFrame, start: int, end: int) -> DataFrame:
    """Runs cut to [start, end); the range reaches the scan."""
    low = F.greatest(F.lit(start) - F.col("offset"), F.lit(0))
    high = F.least(F.lit(end) - F.col("offset"), F.size("samples"))
    rows = runs.where((F.col("offset") < end) & (F.col("offset") > start - RUN)).where(high > low)
    return rows.withColumn("samples", F.slice("samples", (low + 1).cast("int"), (high - low).cast("int"))).withColumn("offset", F.col("offset") + low)


def wav_bytes(samples: np.ndarray) -> bytes:
    """A small WAV as a whole."""
    return header(len(samples)) + np.asarray(samples, "<i2").tobytes()


class AudioFolder:
    """A library's audio files, in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._conf, self.path = spark._jvm, spark._jsc.hadoopConfiguration(), path

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def has_sound(self, path: str) -> bool:
        """A file of more than a WAV header."""
        system, at = self._at(path)
        return bool(system.exists(at)) and system.getFileStatus(at).isFile() and system.getFileStatus(at).getLen() > HEADER

    def keep(self, path: str, name: str) -> str:
        """Copies a file in under this name; one of the same name is replaced."""
        system, at = self._at(path)
        to_system, to = self._at(f"{self.path}/{name}")
        to_system.mkdirs(to.getParent())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(system, at, to_system, to, False, True, self._conf)
        return f"{self.path}/{name}"

    def remove(self, name: str, whole: bool = False) -> None:
        """A file or, if ``whole``, a folder with all in it."""
        system, at = self._at(f"{self.path}/{name}")
        system.delete(at, whole)

    def keep_runs(self, name: str, runs: DataFrame) -> str:
        """A WAV of runs (offset, samples): by the tasks that have them where the folder is mounted on all machines, else run by
        run, in order, through the driver, as such a store takes a file from one writer only."""
        path = f"{self.path}/{name}"
        if mounted(path):
            write_wav(runs, path, overwrite=True)
            return path
        total = runs.agg(F.max(F.col("offset") + F.size("samples"))).first()[0] or 0
        system, at = self._at(path)
        out, come = system.create(at, True), 0
        try:
            out.write(bytearray(header(total)))
            for run in runs.orderBy("offset").toLocalIterator(prefetchPartitions=False):
                out.write(bytearray(2 * max(0, run["offset"] - come)))
                out.write(bytearray(np.asarray(run["samples"], "<i2").tobytes()))
                come = run["offset"] + len(run["samples"])
        finally:
            out.close()
        return path


def accept_drop(paths: list[str], folder_id: int | None) -> tuple[list[dict], bool]:
    """(queue items in order, whether any path was refused); each item keeps the folder that was open."""
    kept = [p for p in paths if os.path.splitext(p)[1].lower() in EXTENSIONS]
    return [{"seq": i, "path": p, "folder_id": folder_id} for i, p in enumerate(kept)], len(kept) < len(paths)
