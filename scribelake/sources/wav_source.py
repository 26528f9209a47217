"""WAV files as a data source: a recording is read, and written, by as many tasks as it has parts, each its own bytes.

``spark.read.format("wav")`` gives rows (path, offset, samples): runs of a second of 16 kHz mono 16-bit samples. The driver
reads headers only. Conditions on ``path`` and ``offset`` choose files and bytes before anything is read. Paths may be of any
file system that pyarrow opens (a plain path is a file on all machines).

``rows.write.format("wav")`` writes one file from rows (offset, samples): every task puts its runs where they belong in a file
beside the target, which gets its header and its name when all have. That needs a file system that is mounted on all
machines and can be written anywhere in a file.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from scribelake.operators.signal import RATE, TILE
from scribelake.sources.resample import resample, resampled_length, source_range

RUN = 100 * TILE
HEADER = 44
#: Seconds of sound that one partition reads, by default.
PART_SECONDS = 300
SCHEMA = "path string, offset long, samples array<smallint>"
#: Sample formats of the header; the last stands for one that is named further on.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Track:
    """Where a file's samples are and what they are like."""

    path: str
    data: int
    size: int
    rate: int
    channels: int
    width: int
    kind: int

    @property
    def frames(self) -> int:
        return self.size // (self.channels * self.width)

    @property
    def length(self) -> int:
        """Samples at 16 kHz."""
        return resampled_length(self.frames, self.rate, RATE)


def locate(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what comes before that in the path)."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    system, at = fs.FileSystem.from_uri(path)
    return system, at, path[: len(path) - len(at)] if path.endswith(at) else ""


def mounted(path: str) -> bool:
    """A plain path or a ``file:`` one."""
    return "://" not in path or path.startswith("file:")


def can_read(path: str) -> bool:
    """A path of a file system that pyarrow knows."""
    try:
        locate(path)
    except (pa.ArrowException, OSError):
        return False
    return True


def open_file(path: str) -> pa.NativeFile:
    system, at, _ = locate(path)
    return system.open_input_file(at)


def read_track(path: str, content: bytes | None = None) -> Track:
    """From the header, of a file or of its ``content``; one that is no WAV, or has no sound in a known format, is a
    ValueError that names it."""
    with open_file(path) if content is None else pa.BufferReader(content) as f:
        end = f.size()
        if end < 12 or f.read_at(4, 0) != b"RIFF" or f.read_at(4, 8) != b"WAVE":
            raise ValueError(f"no sound in {path}: not a WAV")
        at, found = 12, None
        while at + 8 <= end:
            name, size = struct.unpack("<4sI", f.read_at(8, at))
            if name == b"fmt ":
                if size < 16:
                    raise ValueError(f"no sound in {path}: a short header")
                raw = f.read_at(min(size, 40), at + 8)
                kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
                kind = struct.unpack("<H", raw[24:26])[0] if kind == EXTENSIBLE and len(raw) >= 26 else kind
                found = (rate, channels, bits // 8, kind)
            elif name == b"data":
                # A recorder that was cut off leaves a size of zero, or one beyond the file: what is there counts.
                size = end - at - 8 if at + 8 + size > end or size in (0, 0xFFFFFFFF) else size
                if not found:
                    break
                rate, channels, width, kind = found
                if not rate or not channels or (kind, width) not in ((PCM, 1), (PCM, 2), (PCM, 3), (PCM, 4), (FLOAT, 4), (FLOAT, 8)):
                    raise ValueError(f"no sound in {path}: unknown sample format")
                track = Track(path, at + 8, size, rate, channels, width, kind)
                if not track.frames:
                    break
                return track
            at += 8 + size + size % 2
    raise ValueError(f"no sound in {path}")


def as_mono(raw: bytes, track: Track) -> np.ndarray:
    """The mean of the channels, on the scale of 16 bits."""
    if track.kind == FLOAT:
        sound = np.frombuffer(raw, f"<f{track.width}").astype(np.float64) * 32768
    elif track.width == 1:
        sound = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) * 256
    elif track.width == 2:
        sound = np.frombuffer(raw, "<i2").astype(np.float64)
    else:
        wide = np.frombuffer(raw, np.uint8).reshape(-1, track.width)[:, -2:]
        sound = np.ascontiguousarray(wide).view("<i2").reshape(-1).astype(np.float64)
    return sound.reshape(-1, track.channels).mean(axis=1)


def read_samples(track: Track, start: int, end: int, content: bytes | None = None) -> np.ndarray:
    """Samples ``start`` to ``end`` at 16 kHz; no other bytes are read than those they depend on."""
    low, high = source_range(start, end, track.rate, RATE)
    low, high = max(low, 0), min(high, track.frames)
    frame = track.channels * track.width
    with open_file(track.path) if content is None else pa.BufferReader(content) as f:
        raw = f.read_at((high - low) * frame, track.data + low * frame)
    sound = resample(as_mono(raw[: len(raw) // frame * frame], track), low, start, end, track.rate, RATE)
    return np.clip(np.rint(sound), -32768, 32767).astype(np.int16)


@dataclass
class Part(InputPartition):
    track: Track
    start: int
    end: int


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, Any]) -> None:
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path = options["path"]
        self.seconds = int(options.get("partSeconds", PART_SECONDS))
        self.low, self.high, self.paths = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what it can decide for whole runs; Spark checks the rest."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if column == "offset" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = f.value + (not isinstance(f, LessThan))
                    self.high = high if self.high is None else min(self.high, high)
            elif column == "path" and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = own if self.paths is None else self.paths & own
            else:
                yield f

    def _files(self) -> list[str]:
        system, at, prefix = locate(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".wav"))

    def partitions(self) -> list[Part]:
        """Runs in [low, high) by their offset, in parts of ``partSeconds``."""
        out = []
        for path in self._files():
            if self.paths is not None and path not in self.paths:
                continue
            track = read_track(path)
            first = -(-max(self.low, 0) // RUN) * RUN
            last = track.length if self.high is None else min(track.length, max(0, -(-self.high // RUN) * RUN))
            out += [Part(track, at, min(last, at + self.seconds * RATE)) for at in range(first, last, self.seconds * RATE)]
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        """Ten runs at a time, however long the part is. Where nothing is left to read, Spark asks for no part in particular."""
        if not isinstance(partition, Part):
            return
        for at in range(partition.start, partition.end, 10 * RUN):
            end = min(partition.end, at + 10 * RUN)
            sound = read_samples(partition.track, at, end)
            offsets = list(range(at, end, RUN))
            samples = [sound[i - at : i - at + RUN] for i in offsets]
            yield pa.RecordBatch.from_arrays([pa.array([partition.track.path] * len(offsets)), pa.array(offsets, pa.int64()), pa.array(samples, pa.list_(pa.int16()))], names=["path", "offset", "samples"])


def header(n: int) -> bytes:
    """Of a file with so many samples at 16 kHz; more than its sizes can name are a ValueError."""
    if 2 * n + HEADER - 8 > 0xFFFFFFFF:
        raise ValueError("more sound than a WAV can hold")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", HEADER - 8 + 2 * n, b"WAVE", b"fmt ", 16, PCM, 1, RATE, 2 * RATE, 2, 16, b"data", 2 * n)


@dataclass
class Written(WriterCommitMessage):
    samples: int
    end: int


class WavWriter(DataSourceArrowWriter):
    """Two phases: tasks write the samples they have, in any order and again if they are run again; the commit closes the
    file. What no run covers is silent."""

    def __init__(self, options: dict[str, Any], overwrite: bool) -> None:
        if not options.get("path"):
            raise ValueError("a path is needed")
        if not mounted(options["path"]):
            raise ValueError(f"{options['path']} isn't on a mounted file system")
        self.path = locate(options["path"])[1]
        if not overwrite and os.path.exists(self.path):
            raise FileExistsError(self.path)
        self.part = f"{self.path}.{uuid.uuid4()}.part"
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        samples = end = 0
        with os.fdopen(os.open(self.part, os.O_RDWR | os.O_CREAT, 0o644), "r+b") as f:
            for batch in iterator:
                offsets, lists = batch.column("offset").to_pylist(), batch.column("samples")
                flat, edges = np.asarray(lists.flatten(), "<i2"), lists.offsets.to_numpy()
                for offset, a, b in zip(offsets, edges[:-1] - edges[0], edges[1:] - edges[0], strict=True):
                    if b > a:
                        f.seek(HEADER + 2 * offset)
                        f.write(flat[a:b].tobytes())
                        samples, end = samples + int(b - a), max(end, offset + int(b - a))
        return Written(samples, end)

    def commit(self, messages: list[Written | None]) -> None:
        n = max((m.end for m in messages if m), default=0)
        head = header(n)
        with os.fdopen(os.open(self.part, os.O_RDWR | os.O_CREAT, 0o644), "r+b") as f:
            f.write(head)
            f.truncate(HEADER + 2 * n)
            f.flush()
            os.fsync(f.fileno())
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.unlink(self.part)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, overwrite)


def read_wav(spark: SparkSession, path: str, part_seconds: int = PART_SECONDS) -> DataFrame:
    """(path, offset, samples) of a WAV file or of all below a folder. Registers the source in this session, and lets sources
    written in Python see conditions (``spark.sql.python.filterPushdown.enabled``)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").option("partSeconds", part_seconds).load(path)


def write_wav(runs: DataFrame, path: str, overwrite: bool = False) -> None:
    """One WAV from runs (offset, samples) at 16 kHz, written by the tasks that have them."""
    runs.sparkSession.dataSource.register(WavSource)
    runs.select(F.col("offset").cast("long"), F.col("samples").cast("array<smallint>")).write.format("wav").mode("overwrite" if overwrite else "append").save(path)
