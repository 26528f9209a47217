"""A folder of growing captures as a stream: each byte that a recorder appends is read exactly once.

A recorder writes raw 16 kHz mono 16-bit samples to ``<id>.pcm``, what it says to ``<id>.log``, and makes ``<id>.end`` when it
has stopped. ``spark.readStream.format("capture")`` gives rows (recording_id, seq, samples, stop, said); how far each file has
been read is in the query's checkpoint, so a query that was killed goes on at the byte where it stopped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from scribelake.operators.signal import RATE

SCHEMA = "recording_id string, seq long, samples array<smallint>, stop boolean, said string"
#: A row holds at most half a second; a micro-batch, of each recording, at most so many seconds.
ROW, MOST_SECONDS = RATE // 2, 60
#: ``seq`` of a recording's stop, and of what its recorder says: by byte, after and among its samples.
LAST = 2**62


@dataclass
class Stretch(InputPartition):
    """Bytes of one recording: samples, words, and whether it ends here."""

    name: str
    start: int
    end: int
    said: int
    told: int
    stop: bool


class CaptureReader(DataSourceStreamReader):
    """Offsets are, by recording, [bytes of samples, bytes of words, whether its end was seen]."""

    def __init__(self, options: dict[str, Any]) -> None:
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.folder, self.most = options["path"], int(options.get("mostSeconds", MOST_SECONDS)) * RATE * 2
        self.reached: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """How far the files have come. An end is looked for before the sizes, so nothing comes after it."""
        names = sorted(os.listdir(self.folder)) if os.path.isdir(self.folder) else []
        ended = {n.removesuffix(".end") for n in names if n.endswith(".end")}
        size = lambda path: os.path.getsize(path) if os.path.exists(path) else 0
        out = {}
        for name in sorted({n.rpartition(".")[0] for n in names if n.endswith((".pcm", ".end", ".log"))}):
            whole, said = size(f"{self.folder}/{name}.pcm") // 2 * 2, size(f"{self.folder}/{name}.log")
            out[name] = [whole, said, name in ended]
        return out

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        """A stretch for each recording that has come further, cut into parts of ``mostSeconds``."""
        out = []
        for name, (size, said, stop) in end.items():
            size_0, said_0, stop_0 = start.get(name, (0, 0, False))
            cuts = [*range(size_0, size, self.most), size] if size > size_0 else [size_0]
            if size > size_0:
                out += [Stretch(name, a, b, said, said, False) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if said > said_0 or stop and not stop_0:
                out.append(Stretch(name, size, size, said_0, said, stop and not stop_0))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition.end > partition.start:
            with open(f"{self.folder}/{partition.name}.pcm", "rb") as f:
                f.seek(partition.start)
                for at in range(partition.start, partition.end, 2 * ROW):
                    samples = np.frombuffer(f.read(min(2 * ROW, partition.end - at)), "<i2")
                    yield partition.name, at // 2, samples.tolist(), False, None
        if partition.told > partition.said:
            with open(f"{self.folder}/{partition.name}.log", "rb") as f:
                f.seek(partition.said)
                yield partition.name, partition.end // 2, [], False, f.read(partition.told - partition.said).decode("utf-8", "replace")
        if partition.stop:
            yield partition.name, LAST, [], True, None

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> CaptureReader:
        return CaptureReader(self.options)


def read_capture(spark: SparkSession, folder: str) -> DataFrame:
    """The stream (recording_id, seq, samples, stop, said) of a folder that recorders write to, mounted on all machines."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("capture").load(folder)
