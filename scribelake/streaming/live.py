"""Live recordings as streams: segments cut at pauses, pause sessions, job states."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from scribelake.operators.jobs import DEFAULT_ERROR
from scribelake.operators.signal import BLOCK, PAD_SLACK, RATE, averaged, fold_padding, split_point

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Samples between two questions whether to cut.
STEP = RATE // 2
SEGMENTS = "{key}, start long, end long, n long, sum_sq double, samples array<smallint>"


class Cutter:
    """A recording's samples since the last cut, and the segments that leave it. Whether to cut is asked after each half
    second, so the segments depend neither on how long rows are nor on how they fall into batches."""

    def __init__(self, start: int = 0, asked: int = 0, held: bytes = b"") -> None:
        self.start, self.asked, self.buffer = start, asked, np.frombuffer(held, "<i2")

    @property
    def state(self) -> tuple[int, int, bytes]:
        return self.start, self.asked, self.buffer.astype("<i2").tobytes()

    def _emit(self, n: int) -> tuple:
        part = self.buffer[:n].astype(np.float64)
        out = (self.start, self.start + n, n, float(part @ part), self.buffer[:n].tolist())
        self.start, self.buffer = self.start + n, self.buffer[n:]
        return out

    def _ask(self) -> Iterator[tuple]:
        while True:
            blocks = (self.buffer[: len(self.buffer) // BLOCK * BLOCK].astype(np.float64).reshape(-1, BLOCK) ** 2).mean(axis=1)
            if not (cut := split_point(blocks, len(self.buffer))):
                return
            yield self._emit(cut)

    def take(self, samples: Any) -> Iterator[tuple]:
        """(start, end, n, sum_sq, samples) of the segments that these samples close."""
        left = np.asarray(samples if samples is not None else [], "<i2")
        while len(left):  # asked: samples of the recording that the last question covered
            step = self.asked + STEP - self.start - len(self.buffer)
            self.buffer, left = np.concatenate([self.buffer, left[:step]]), left[step:]
            if self.start + len(self.buffer) == self.asked + STEP:
                self.asked += STEP
                yield from self._ask()

    def flush(self) -> Iterator[tuple]:
        """The rest, as nothing more comes."""
        yield from self._ask()
        if len(self.buffer):
            yield self._emit(len(self.buffer))


def live_segments(stream: DataFrame, key: str = "recording_id") -> DataFrame:
    """(key, start, end, n, sum_sq, samples) of a stream (key, seq, samples, stop): the segments of each recording.

    A stateful operator holds the samples since the last cut, half a second over 20 s at most, in order of ``seq`` within a
    micro-batch; rows should arrive in order. A row with ``stop`` flushes the tail and ends the recording: its state goes,
    and a later row with the key begins a new one. One that is never stopped keeps its state: ``watched_segments`` ends it.
    """
    kind = stream.schema[key].dataType.simpleString()

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cutter, out, live = Cutter(*state.get) if state.exists else Cutter(), [], True
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for samples, stop in zip(rows["samples"], rows["stop"], strict=True):
            if not live:
                cutter, live = Cutter(), True
            out += [(*group, *s) for s in cutter.take(samples)]
            if stop:
                out += [(*group, *s) for s in cutter.flush()]
                live = False
        if live:
            state.update(cutter.state)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "start", "end", "n", "sum_sq", "samples"])

    own = stream.select(key, "seq", "samples", "stop").groupBy(key)
    return own.applyInPandasWithState(run, SEGMENTS.format(key=f"{key} {kind}"), "start long, asked long, held binary", "append", GroupStateTimeout.NoTimeout)


WATCHED = "{key}, kind string, start long, end long, n long, sum_sq double, samples array<smallint>, said string"
#: So much of a lost source's last words is kept.
LAST_WORDS = 1500


class _Watch(StatefulProcessor):
    """The state of a recording whose source may fall silent: a cutter, when a row last came, and what the source last said."""

    def __init__(self, key: str, silence: float) -> None:
        self.key, self.silence = key, int(silence * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "start long, asked long, held binary, said string")
        self.prefix = handle.getValueState("prefix", "text string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        self.prefix.update((str(initialState["prefix"].iloc[0]),))

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=[self.key, "kind", "start", "end", "n", "sum_sq", "samples", "said"])

    def _watch(self, now: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if now is not None:
            self.handle.registerTimer(now + self.silence)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        start, asked, held, said = self.held.get() if self.held.exists() else (0, 0, b"", "")
        cutter, out, live = Cutter(start, asked, bytes(held)), [], True
        if self.prefix.exists():
            text = self.prefix.get()[0]
            self.prefix.clear()
            out += [("prefix", -1, 0, 0, 0.0, [], text.rstrip())] if text.strip() else []
        for samples, stop, words in pd.concat(list(rows)).sort_values("seq", kind="stable")[["samples", "stop", "said"]].itertuples(index=False):
            if not live:
                cutter, said, live = Cutter(), "", True
            said = (said + (words or ""))[-LAST_WORDS:]
            out += [("segment", *s, None) for s in cutter.take(samples)]
            if stop:
                out += [("segment", *s, None) for s in cutter.flush()]
                out.append(("ended", cutter.start, cutter.start, 0, 0.0, [], None))
                live = False
        if live:
            self.held.update((*cutter.state, said))
        elif self.held.exists():
            self.held.clear()
        self._watch(timerValues.getCurrentProcessingTimeInMs() if live else None)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.held.exists():
            start, asked, held, said = self.held.get()
            cutter = Cutter(start, asked, bytes(held))
            out = [("segment", *s, None) for s in cutter.flush()]
            out.append(("lost", cutter.start, cutter.start, 0, 0.0, [], said))
            self.held.clear()
        yield self._rows(key, out)


def watched_segments(stream: DataFrame, key: str = "recording_id", silence: float = 30.0, prefixes: DataFrame | None = None) -> DataFrame:
    """(key, kind, start, end, n, sum_sq, samples, said) of a stream (key, seq, samples, stop, said): the segments of each
    recording (``segment``), and how it ended: ``ended`` after its stop, or ``lost``, with what its source last said, when no row
    came for ``silence`` seconds. Either way its state goes, and a later row begins a new recording.

    ``prefixes`` (key, prefix) is text that was there before a recording goes on: the first row to come gives it out, as a
    ``prefix``. State is kept in RocksDB, which this sets for queries started from now on; the timer goes by the clock of
    the machine and needs no rows to fire.
    """
    kind = stream.schema[key].dataType.simpleString()
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    said = F.col("said") if "said" in stream.columns else F.lit(None).cast("string")
    own = stream.select(key, "seq", "samples", "stop", said.alias("said")).groupBy(key)
    first = None if prefixes is None else prefixes.select(key, "prefix").groupBy(key)
    return own.transformWithStateInPandas(_Watch(key, silence), WATCHED.format(key=f"{key} {kind}"), "append", "ProcessingTime", first)


class _Pace(StatefulProcessor):
    """A stream's place, and the clock that it has to keep up with."""

    def __init__(self, key: str, slack: int, every: int) -> None:
        self.key, self.slack, self.every = key, slack, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pace", "produced long, expected long, seen long")

    def _due(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        produced, expected, _ = self.state.get() if self.state.exists() else (0, 0, now)
        out, over = [], False
        for samples, due, stop in pd.concat(list(rows)).sort_values("seq", kind="stable")[["samples", "expected", "stop"]].itertuples(index=False):
            sound = np.asarray(samples if samples is not None else [], "<i2")
            expected, over = max(expected, int(due)), over or bool(stop)
            silence = fold_padding(produced, len(sound), int(due), self.slack)
            if len(sound) + silence:
                out.append((*key, produced, np.concatenate([sound, np.zeros(silence, "<i2")]).tolist()))
            produced += len(sound) + silence
        if over:
            if self.state.exists():
                self.state.clear()
        else:
            self.state.update((produced, expected, now))
        self._due(None if over else now + self.every)
        yield pd.DataFrame(out, columns=[self.key, "offset", "samples"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            now = timerValues.getCurrentProcessingTimeInMs()
            produced, expected, seen = self.state.get()
            expected += (now - seen) * RATE // 1000
            if silence := fold_padding(produced, 0, expected, self.slack):
                out.append((*key, produced, [0] * silence))
            self.state.update((produced + silence, expected, now))
            self._due(now + self.every)
        yield pd.DataFrame(out, columns=[self.key, "offset", "samples"])


def paced(stream: DataFrame, key: str = "recording_id", slack: int = PAD_SLACK, every: float | None = 0.25) -> DataFrame:
    """(key, offset, samples) of a stream (key, seq, expected, samples, stop), filled with silence as ``pad_chunks`` fills a table.

    A source that sends nothing while nothing sounds still has to keep pace with the clock: after ``every`` seconds without a
    row a timer adds the silence that is missing, from what was expected of the last row and the time since then; None adds it
    with the next row only. A row with ``stop`` ends the recording, and its state goes.
    """
    kind = stream.schema[key].dataType.simpleString()
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own = stream.select(key, "seq", "expected", "samples", "stop").groupBy(key)
    return own.transformWithStateInPandas(_Pace(key, slack, int(1000 * every) if every is not None else 2**40), f"{key} {kind}, offset long, samples array<smallint>", "append", "ProcessingTime")


def mix_live(left: DataFrame, right: DataFrame, key: str = "recording_id") -> DataFrame:
    """(key, offset, samples): the average, rounded down, of two streams (key, seq, samples, stop), as far as both have come.

    What one stream has ahead of the other is kept in the state; it goes, with the state, when both have stopped.
    """
    kind = left.schema[key].dataType.simpleString()
    both = left.select(key, "seq", "samples", "stop", F.lit(0).alias("side")).unionByName(right.select(key, "seq", "samples", "stop", F.lit(1).alias("side")))

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        offset, *held, stopped = state.get if state.exists else (0, b"", b"", 0)
        tails = [np.frombuffer(t, "<i2") for t in held]
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for side in (0, 1):
            own = rows[rows["side"] == side]
            tails[side] = np.concatenate([tails[side], *(np.asarray(s, "<i2") for s in own["samples"] if s is not None)])
            stopped |= int(own["stop"].fillna(False).any()) << side
        n = min(map(len, tails))
        mixed = ((tails[0][:n].astype(np.int32) + tails[1][:n]) >> 1).astype(np.int16)
        if stopped == 3:
            if state.exists:
                state.remove()
        else:
            state.update((offset + n, *(t[n:].astype("<i2").tobytes() for t in tails), stopped))
        yield pd.DataFrame({key: [group[0]] * (n > 0), "offset": [offset] * (n > 0), "samples": [mixed.tolist()] * (n > 0)})

    return both.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, offset long, samples array<smallint>", "offset long, a binary, b binary, stopped int", "append", GroupStateTimeout.NoTimeout)


def mix_tiles(left: DataFrame, right: DataFrame, key: str = "recording_id", late: str = "10 seconds", apart: str = "2 seconds") -> DataFrame:
    """(key, tile_idx, ts, samples): the average, rounded down, of two streams of tiles (key, tile_idx, ts, samples), by a join of
    streams on the tile.

    ``ts`` is when a tile was captured. The two of a pair lie at most ``apart``, and rows come at most ``late``, so a watermark
    lets go of tiles that have no partner, and state is bounded by what comes in that time.
    """
    a = left.select(F.col(key).alias("key_a"), F.col("tile_idx").alias("tile_a"), F.col("ts").alias("ts_a"), F.col("samples").alias("x")).withWatermark("ts_a", late)
    b = right.select(F.col(key).alias("key_b"), F.col("tile_idx").alias("tile_b"), F.col("ts").alias("ts_b"), F.col("samples").alias("y")).withWatermark("ts_b", late)
    near = F.expr(f"ts_a >= ts_b - INTERVAL {apart} AND ts_a <= ts_b + INTERVAL {apart}")
    both = a.join(b, (F.col("key_a") == F.col("key_b")) & (F.col("tile_a") == F.col("tile_b")) & near)
    return both.select(F.col("key_a").alias(key), F.col("tile_a").alias("tile_idx"), F.greatest("ts_a", "ts_b").alias("ts"), averaged(F.col("x"), F.col("y")).alias("samples"))


def pause_sessions(voiced: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, last, voiced): voiced blocks (keys, ts: when a block begins) with at most two quiet ones between.

    Blocks that begin 600 ms apart belong together and 800 ms don't; a gap as long as the session's merges, so 700 ms.
    Works on a stream with a watermark as on a table.
    """
    return voiced.groupBy(*keys, F.session_window("ts", "700 milliseconds")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("voiced")).drop("session_window")


JOB = {"seq": -1, "state": "running", "phase": "loading", "stage": "준비 중", "percent": 0.0, "text": "", "saved": "", "error": None, "code": None, "file": "", "ready": "", "step": "", "size": None, "duration": None}


def job_states(stream: DataFrame) -> DataFrame:
    """(job_id, seq, state, phase, stage, percent, text, saved, error, code, file, ready, step, size, duration): each job's state
    after the micro-batch, from a stream of job events. A job that has ended needs no state, and none is kept of it."""
    kind = stream.schema["job_id"].dataType.simpleString()

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job: dict[str, Any] = json.loads(state.get[0]) if state.exists else JOB
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            job = step(job, row.kind, row.value) | {"seq": int(row.seq)}
        if job["state"] == "running":
            state.update((json.dumps(job),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*group, *job.values())], columns=["job_id", *job])

    types = ("long", "string", "string", "string", "double", "string", "string", "string", "string", "string", "string", "string", "string", "double")
    schema = f"job_id {kind}, " + ", ".join(f"{n} {t}" for n, t in zip(JOB, types, strict=True))
    return stream.groupBy("job_id").applyInPandasWithState(run, schema, "job string", "update", GroupStateTimeout.NoTimeout)


def step(job: dict[str, Any], kind: str, value: str | None) -> dict[str, Any]:
    """One event applied to a job."""
    if kind == "phase":
        return job if job["phase"] == "finishing" else job | {"phase": value}
    changes = {
        "stage": {"stage": value}, "file": {"phase": "downloading", "stage": f"{value} 내려받는 중", "file": value}, "ready": {"phase": "checking", "ready": ",".join(filter(None, (job["ready"], value)))}, "step": {"step": value}, "size": {"size": value}, "text": {"text": value, "saved": value}, "preview": {"text": value},
        "done": {"state": "done", "text": value, "percent": 100.0}, "error": {"state": "error", "error": value or DEFAULT_ERROR, "code": "failed"}, "cancelled": {"state": "error", "error": value or DEFAULT_ERROR, "code": "cancelled"},
    }
    if kind in ("progress", "duration"):
        return job | {"percent" if kind == "progress" else "duration": float(value)}
    return job | changes.get(kind, {})


def with_prefix(prefix: str, segments: list[str]) -> str:
    """A live transcript: earlier text, if not blank, is the first paragraph."""
    return "\n\n".join(([prefix.rstrip()] if prefix.strip() else []) + segments)


def tile_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Rows (recording_id, seq, samples, stop) that a capturing process drops as Parquet files into a folder."""
    schema = "recording_id string, seq long, samples array<smallint>, stop boolean"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def record(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps every row of a live stream, each micro-batch exactly once."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def with_offsets(recorded: DataFrame, key: str = "recording_id") -> DataFrame:
    """(key, offset, samples) of recorded rows (key, seq, samples): where each begins in its recording. Only the rows' lengths,
    a number for each half second or so, are added up in one place."""
    rows = recorded.where(F.size("samples") > 0).select(key, "seq", "samples")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.select(key, "seq", F.size("samples").cast("long").alias("n")).select(key, "seq", before.alias("offset"))
    return rows.join(at, [key, "seq"]).select(key, "offset", "samples")


def status(query: StreamingQuery) -> dict[str, Any]:
    """What a poll of a live query shows."""
    progress = query.lastProgress
    return {"active": query.isActive, "batch": progress["batchId"] if progress else None, "rows": progress["numInputRows"] if progress else 0, "error": str(query.exception()) if query.exception() else None}
