"""The public surface: a library of notes kept as event logs, transcription jobs, request validation, the one job slot."""

from __future__ import annotations

import os
import re
import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scribelake.functions import text as X
from scribelake.operators import jobs, library, mutations
from scribelake.operators.models import finish_write
from scribelake.operators.signal import RATE
from scribelake.operators.speakers import Embedder
from scribelake.operators.text import keywords
from scribelake.operators.transcribe import Transcriber, live_text, plan_chunks, transcribe_watched
from scribelake.sources.audio import EXTENSIONS, AudioFolder, read_recordings
from scribelake.sources.event_log import EventLog
from scribelake.sources.shared import durable, shared_folder
from scribelake.sources.sinks import export_txt
from scribelake.streaming.file_job import FileSteps
from scribelake.streaming.live import LAST_WORDS, watched_segments, with_offsets

# Sources of live audio and device labels, in order of preference.
LIVE_SOURCES = ("mic", "system", "both")
SEGMENT_TEXTS = "recording_id string, kind string, start long, end long, text string"
DEVICE_LABELS = {"npu": "NPU", "gpu": "GPU", "intel-gpu": "Intel GPU", "intel-npu": "Intel NPU", "cpu": "CPU"}


class RequestError(Exception):
    """A refused request: status and, for some, a code."""

    def __init__(self, status: int, message: str, code: str | None = None) -> None:
        super().__init__(message)
        self.status, self.code = status, code


class Library:
    """Notes and folders below a path, as append-only event logs that are folded when read.

    One writer: sequence numbers come from a counter that starts after the largest in the logs, and so do note ids. Readers
    need no lock. After ``compact_after`` appends, counted over all openings, a log is written anew, compacted; the log before
    stays in force until that is done. Audio files are kept beside the logs.
    """

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time, compact_after: int = 1000) -> None:
        self.spark, self.path, self.clock, self.compact_after = spark, path, clock, compact_after
        self.audio, self.slot, self.job = AudioFolder(spark, f"{path}/audio"), JobSlot(), None
        self._lock = threading.RLock()
        self._logs = {"note_events": EventLog(spark, f"{path}/note_events", mutations.NOTE_EVENTS, "note_id"), "folder_events": EventLog(spark, f"{path}/folder_events", mutations.FOLDER_EVENTS, "folder_id")}
        tops = [self._events(n).agg(F.max("seq")).first()[0] for n in self._logs]
        self._seq = max([-1, *(t for t in tops if t is not None)])
        self._next_note = self._after_notes()

    def _after_notes(self) -> int:
        """One more than the largest id in use; only ids and sequence numbers are read."""
        events = self._events("note_events")
        lives = events.groupBy("note_id").agg(F.max_by("op", F.when(F.col("op").isin("create", "delete"), F.col("seq"))).alias("last"))
        return (lives.where("last = 'create'").agg(F.max("note_id")).first()[0] or 0) + 1

    def _events(self, name: str, key: int | None = None) -> DataFrame:
        return self._logs[name].read(key)

    def _append(self, name: str, rows: list[tuple]) -> None:
        numbered = [(self._seq + i + 1, *row) for i, row in enumerate(rows)]
        self._seq += len(rows)
        self._logs[name].append(numbered)
        if self._logs[name].appended >= self.compact_after:
            self.compact()

    def compact(self) -> None:
        """Writes both logs anew: of each note a create and at most one update, of each folder its last event and deletion.
        Notes come first, as they are folded against the whole log of folders."""
        with self._lock:
            notes, folders = self._logs["note_events"], self._logs["folder_events"]
            notes.rewrite(mutations.compact(notes.read(), folders.read()))
            folders.rewrite(mutations.compact_folders(folders.read()))

    def notes(self) -> DataFrame:
        return mutations.current_notes(self._events("note_events"), self._events("folder_events"))

    def folders(self) -> DataFrame:
        return mutations.current_folders(self._events("folder_events")).orderBy("name")

    def get(self, note_id: int) -> dict | None:
        """One note: only its own events are read, and folded."""
        row = self.note(note_id).first()
        return row.asDict() if row else None

    def note(self, note_id: int) -> DataFrame:
        return mutations.current_notes(self._events("note_events", note_id), self._events("folder_events"))

    def list(self, view: str = "all", query: str = "") -> DataFrame:
        return library.list_notes(self.notes(), self.folders(), view, query)

    def list_with_keywords(self, view: str = "all", query: str = "") -> DataFrame:
        return library.list_with_keywords(self.notes(), self.folders(), view, query)

    def keywords(self, note_id: int, limit: int = 3) -> list[str]:
        return keywords(self.note(note_id), "id", "transcript", limit).first()["keywords"]

    def create(self, title: str, source: str, transcript: str = "", audio: str | None = None, folder_id: int | None = None) -> int:
        """The new note's id, one more than the largest in use. A folder that isn't there leaves the note unfiled; an audio
        file is copied into the library."""
        with self._lock:
            now = self.clock()
            if folder_id is not None and self.folders().where(F.col("id") == folder_id).isEmpty():
                folder_id = None
            name = f"{int(now)}-{os.path.basename(audio)}" if audio else None
            if audio:
                self.audio.keep(audio, name)
            note_id = self._next_note
            fields = {"title": title.strip() or X.DEFAULT_TITLE, "source": source, "transcript": transcript, "audio": name, "folder_id": None if folder_id is None else str(folder_id)}
            self._append("note_events", [("create", note_id, fields, now)])
            self._next_note += 1
            return note_id

    def update(self, note_id: int, **fields: Any) -> None:
        """Unknown fields are a ValueError; no fields change nothing; an unknown note is ignored."""
        self.update_many([note_id], **fields)

    def update_many(self, note_ids: list[int], **fields: Any) -> None:
        with self._lock:
            now = self.clock()
            if changes := mutations.update_fields(now, **fields):
                if changes.get("folder_id") is not None and self.folders().where(F.col("id") == int(changes["folder_id"])).isEmpty():
                    raise RequestError(500, "no such folder")
                self._append("note_events", [("update", i, changes, now) for i in note_ids])

    def toggle_star(self, note_ids: list[int]) -> bool:
        ids = self.spark.createDataFrame([(i,) for i in note_ids], "id long")
        target = library.star_target(self.notes(), ids).first()["target"]
        self.update_many(note_ids, starred=target)
        return target

    def attach_audio(self, note_id: int, path: str) -> str | None:
        """Copies a recording in and gives its name, or None if the note isn't there or has audio already, or if the file is
        no more than a header."""
        with self._lock:
            if not self.audio.has_sound(path):
                return None
            found = mutations.attach_audio(self.note(note_id), self.spark.createDataFrame([(note_id, path)], "note_id long, path string"), self.clock()).first()
            if found is None:
                return None
            self.audio.keep(path, found["fields"]["audio"])
            self._append("note_events", [("update", note_id, dict(found["fields"]), found["at"])])
            return found["fields"]["audio"]

    def delete(self, note_id: int, running_note: int | None = None) -> None:
        """For good, with the note's audio file. The note of the running job stays."""
        if note_id == running_note or (self.slot.running is not None and note_id == self.slot.running):
            raise RequestError(409, "the note's job is running", "busy")
        with self._lock:
            note = self.get(note_id)
            self._append("note_events", [("delete", note_id, {}, self.clock())])
            if note and note["audio"]:
                self.audio.remove(note["audio"])
            if note_id == self._next_note - 1:
                self._next_note = self._after_notes()

    def create_folder(self, name: str) -> int:
        name = mutations.folder_name(name)
        with self._lock:
            folder_id = (self.folders().agg(F.max("id")).first()[0] or 0) + 1
            self._append("folder_events", [("create", folder_id, name)])
            return folder_id

    def delete_folder(self, folder_id: int) -> None:
        with self._lock:
            self._append("folder_events", [("delete", folder_id, None)])

    def export(self, note_id: int, path: str) -> None:
        note = self.get(note_id)
        if note is None:
            raise RequestError(404, "no such note")
        if not path.lower().endswith(".txt"):
            raise RequestError(400, "not a .txt path", "invalid_file")
        export_txt(note["transcript"], path)


    # ---- jobs ----
    def job_state(self) -> dict:
        """The last job as a poll shows it: the fold of its events, the seconds recorded, its note; idle before the first."""
        return {"state": "idle"} if self.job is None else self.job.state(self.spark)

    def _begin(self, operation: str, note_id: int) -> Job:
        self.slot.start(note_id)
        job = Job(operation, note_id, self.clock)
        job.emit("phase", "loading")
        self.job = job
        return job

    def _end(self, job: Job, kind: str, value: str | None, duration: float | None = None) -> None:
        """Writes the transcript (of a failed job, the text that was complete), then frees the slot."""
        try:
            if kind == "done":
                wrong = finish_write(self.update, job.note_id, value or "", duration)
                kind, value = ("error", wrong) if wrong else (kind, value)
            elif job.saved:
                finish_write(self.update, job.note_id, job.saved, None)
        finally:
            job.emit(kind, value)
            self.slot.release()

    def transcribe(self, path: str, body: dict, devices: list[str], make: Callable[[str], Callable[[], Transcriber]], speakers: Callable[[], Embedder] | None = None, decoders: dict[str, Callable] | None = None) -> int:
        """Transcribes a recording into a new note, waits for it, and gives the note's id; ``job_state`` shows how it ended."""
        return self.start_transcribe(path, body, devices, make, speakers, decoders).wait()

    def start_transcribe(self, path: str, body: dict, devices: list[str], make: Callable[[str], Callable[[], Transcriber]], speakers: Callable[[], Embedder] | None = None, decoders: dict[str, Callable] | None = None) -> Transcribing:
        """Begins to transcribe a recording into a new note. ``job_state`` shows how far it has come and its text so far.

        ``make`` gives the factory of a device's model; ``speakers`` a speaker model's, used unless the body says
        ``speakers: false``. The body is checked, and the slot must be free, before a note is made.
        """
        if not self.audio.has_sound(path) or os.path.splitext(path)[1].lower() not in EXTENSIONS:
            raise RequestError(400, "not a recording", "invalid_file")
        validate_transcribe(body, devices)
        self.slot.check()
        note_id = self.create(os.path.splitext(os.path.basename(path))[0], "audio", audio=path, folder_id=body.get("folder_id"))
        job = self._begin("transcribe", note_id)
        return Transcribing(self, job, make(body["device"]), speakers if body.get("speakers", True) else None, decoders)

    def cancel_job(self) -> None:
        """Cancels the file job that runs, if any; a live one has its own ways to end."""
        if self.job and self.job.operation == "transcribe" and self.job.running:
            self.job.running.cancel()

    def listen(self, stream: DataFrame, body: dict, devices: list[str], make: Callable[[str], Callable[[], Transcriber]], trigger: dict | None = None, silence: float = 30.0) -> Listening:
        """Transcribes a live stream (recording_id, seq, samples, stop) of one recording into a new note. It may also have
        ``said``, what the source says of itself.

        Two queries read the stream: one keeps every row, one cuts segments and transcribes those that aren't silent. Both
        write files, each micro-batch exactly once, so a restart goes on where it was. A source that sends no row for
        ``silence`` seconds is lost: the job ends as an error, with what was transcribed and the source's last words.
        """
        validate_live(body, devices)
        self.slot.check()
        now = self.clock()
        title = self.spark.range(1).select(X.live_title(F.lit(now))).first()[0]
        note_id = self.create(title, "live", folder_id=body.get("folder_id"))
        job = self._begin("listen", note_id)
        job.emit("phase", "recording")
        return Listening(self, job, f"{self.path}/live/{note_id}-{int(now * 1000)}", stream, make(body["device"]), trigger or {"processingTime": "1 second"}, silence)


class Job:
    """One job's events, folded when asked."""

    def __init__(self, operation: str, note_id: int, clock: Callable[[], float]) -> None:
        self.operation, self.note_id, self.clock, self._events, self.saved = operation, note_id, clock, [], ""
        self.running: Transcribing | None = None

    def emit(self, kind: str, value: Any) -> None:
        if kind == "text":
            self.saved = value
        self._events.append((0, len(self._events), kind, None if value is None else str(value), self.clock()))

    def state(self, spark: SparkSession) -> dict:
        events = spark.createDataFrame(list(self._events), "job_id int, seq long, kind string, value string, ts double")
        row = jobs.fold(events, self.operation).join(jobs.clock(events, self.clock()), "job_id").drop("job_id").first()
        return row.asDict() | {"op": self.operation, "note_id": self.note_id}


class Transcribing:
    """A file job, on a thread of its own: what it has transcribed so far shows, is kept if it fails, and it can be cancelled."""

    def __init__(self, library_: Library, job: Job, make: Callable[[], Transcriber], speakers: Callable[[], Embedder] | None, decoders: dict[str, Callable] | None) -> None:
        self.library, self.job, self._stop = library_, job, threading.Event()
        self.folder = f"{shared_folder(library_.spark)}/job-{uuid.uuid4()}"
        self.tag = os.path.basename(self.folder)
        self._thread = threading.Thread(target=self._run, args=(make, speakers, decoders), daemon=True)
        job.running = self
        self._thread.start()

    def wait(self, timeout: float | None = None) -> int:
        """The note's id, once the job has ended, however it did."""
        self._thread.join(timeout)
        return self.job.note_id

    def cancel(self) -> None:
        """At once: the step that runs is given up, the text of those before stays."""
        self._stop.set()
        self.library.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _go_on(self) -> None:
        if self._stop.is_set():
            raise InterruptedError

    def _run(self, make: Callable[[], Transcriber], speakers: Callable[[], Embedder] | None, decoders: dict[str, Callable] | None) -> None:
        library_, job = self.library, self.job
        spark = library_.spark
        spark.sparkContext.addJobTag(self.tag)
        try:
            text, duration = self._steps(make, speakers, decoders)
        except Exception as error:
            library_._end(job, *(("cancelled", None) if self._stop.is_set() else ("error", reason(error))))
        else:
            library_._end(job, *(("cancelled", None) if self._stop.is_set() else ("done", text, duration)))
        finally:
            job.running = None
            AudioFolder(spark, os.path.dirname(self.folder)).remove(self.tag, whole=True)

    def _steps(self, make: Callable[[], Transcriber], speakers: Callable[[], Embedder] | None, decoders: dict[str, Callable] | None) -> tuple[str, float]:
        job, spark = self.job, self.library.spark
        job.emit("phase", "decoding")
        job.emit("stage", "오디오를 16 kHz 모노로 변환하는 중…")
        runs = durable(read_recordings(spark, f"{self.library.audio.path}/{self.library.get(job.note_id)['audio']}", decoders))
        self._go_on()
        if speakers:
            job.emit("phase", "diarizing")
            job.emit("stage", "화자 분석 중…")
        totals, chunks = plan_chunks(runs, "path", speakers)
        total, duration = totals.select("total", "duration").first()
        job.emit("duration", duration)
        self._go_on()
        steps = FileSteps(spark, self.folder, "path")
        count = steps.lay_out(runs, chunks)
        reach = {r["step"]: r for r in steps.chunks().groupBy("step").agg(F.min("start").alias("start"), F.max("end").alias("end")).collect()}  # a row a step
        job.emit("phase", "transcribing")

        def begun(step: int) -> None:
            at = reach[step]
            job.emit("progress", at["start"] / total * 100)
            job.emit("stage", f"{at['start'] / RATE:.1f}–{at['end'] / RATE:.1f}초 구간 전사 중")

        def done(step: int) -> None:
            job.emit("text", steps.text())
            job.emit("progress", reach[step]["end"] / total * 100)

        steps.run(count, make, begun, done, self._stop)
        self._go_on()
        return job.saved, duration


def reason(error: BaseException) -> str:
    """What went wrong, in the words of the error that began it, without the traces of those who passed it on."""
    text = str(error)
    lines = re.findall(r"^(?:\w+\.)*\w*(?:Error|Exception|Interrupt|Exit)(?:: (.*))?$", text, re.MULTILINE)
    found = next((x for x in reversed(lines) if x), None)
    return (found or text.strip().partition("\n")[0] or type(error).__name__)[-3000:]


class Listening:
    """A live job: its queries, and the ways it ends. Its folder goes with it."""

    def __init__(self, library_: Library, job: Job, folder: str, stream: DataFrame, make: Callable[[], Transcriber], trigger: dict, silence: float) -> None:
        self.library, self.job, self.folder = library_, job, folder
        self._lock, self._over, self._last_words = threading.Lock(), threading.Event(), None
        log = lambda name: {"checkpointLocation": f"{folder}/{name}-log"}
        self.recorded = stream.writeStream.format("parquet").options(path=f"{folder}/recorded", **log("recorded")).outputMode("append").trigger(**trigger).start()
        texts = transcribe_watched(watched_segments(stream, silence=silence), make, "recording_id")
        self.segments = texts.writeStream.foreachBatch(self._keep).options(**log("segments")).outputMode("append").trigger(**trigger).start()
        self._watcher = threading.Thread(target=self._watch, daemon=True)
        self._watcher.start()

    def _keep(self, batch: DataFrame, number: int) -> None:
        """A micro-batch's texts into a file of its own, in place of what is there; then how the recording ended, if it did."""
        batch.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/segments/batch-{number:09d}")
        kept = self.library.spark.read.schema(SEGMENT_TEXTS).parquet(f"{self.folder}/segments/batch-{number:09d}")
        if lost := kept.where("kind = 'lost'").select("text").first():
            self._last_words = lost["text"]

    def _watch(self) -> None:
        """Ends the job when its source is lost or one of its queries has failed."""
        while not self._over.wait(0.25):
            broken = next((q.exception() for q in (self.recorded, self.segments) if not q.isActive and q.exception()), None)
            if self._last_words is not None or broken:
                try:
                    self.cancel(lost=self._last_words if self._last_words is not None else reason(broken))
                except RequestError:
                    pass  # it has been ended by then
                return

    def _end_once(self) -> None:
        with self._lock:
            if self._over.is_set():
                raise RequestError(409, "the job has ended", "ended")
            self._over.set()

    def _clear(self) -> None:
        AudioFolder(self.library.spark, os.path.dirname(self.folder)).remove(os.path.basename(self.folder), whole=True)

    def wait(self, timeout: float | None = None) -> None:
        """Until the job is over, for a source that ends by itself."""
        self._watcher.join(timeout)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.library.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")

    def text(self, prefix: str = "") -> str:
        """What has been transcribed so far."""
        try:
            rows = self._read("segments", SEGMENT_TEXTS).where("kind = 'segment'")
            found = live_text(rows, "recording_id", prefix).first()
        except AnalysisException:  # nothing has been written yet
            found = None
        return found["transcript"] if found else prefix.rstrip()

    def finish(self, prefix: str = "") -> str:
        """After all that has arrived: the recording is kept with the note, then the text and its duration are written. Samples
        since the last cut are transcribed if the source has sent its stop."""
        self._end_once()
        self.job.emit("phase", "finishing")
        try:
            finish(self.recorded)
            drain(self.segments)
            text = self.text(prefix)
            self.job.emit("text", text)
            duration = self._keep_sound()
        except Exception as error:
            self.library._end(self.job, "error", reason(error))
            raise
        self.library._end(self.job, "done", text, duration)
        self._clear()
        return text

    def _keep_sound(self) -> float | None:
        """The recording with its note, and how long it is; None where there is none, or the note has one."""
        runs = with_offsets(self._read("recorded", "recording_id string, seq long, samples array<smallint>, stop boolean"))
        total = runs.agg(F.max(F.col("offset") + F.size("samples"))).first()[0]
        if not total:
            return None
        name = f"{self.job.note_id}-live.wav"
        path = self.library.audio.keep_runs(name, runs)
        kept = self.library.attach_audio(self.job.note_id, path)
        self.library.audio.remove(name)
        return total / RATE if kept else None

    def cancel(self, note: str | None = None, lost: str | None = None) -> None:
        """At once; what was transcribed stays. With ``lost``, the source's last words, it is an error: the input broke off."""
        self._end_once()
        for query in (self.recorded, self.segments):
            cancel(query)
        self.job.emit("text", self.text())
        if lost is None:
            self.library._end(self.job, "cancelled", note)
        else:
            self.library._end(self.job, "error", "입력이 끊겼습니다.\n" + lost[-LAST_WORDS:])
        self._clear()


def validate_transcribe(body: dict, devices: list[str]) -> None:
    if body.get("device") not in devices:
        raise RequestError(400, "unknown device")
    if not isinstance(body.get("speakers", False), bool):
        raise RequestError(400, "speakers is true or false")
    folder = body.get("folder_id")
    if folder is not None and (isinstance(folder, bool) or not isinstance(folder, int)):
        raise RequestError(400, "folder_id is an integer or null")


def validate_live(body: dict, devices: list[str]) -> None:
    validate_transcribe(body, devices)
    if body.get("source") not in LIVE_SOURCES:
        raise RequestError(400, "unknown source")
    if body["source"] != "system" and not body.get("mic"):
        raise RequestError(400, "a microphone is needed", "no_mic")


def device_list(probed: list[str], models_ready: bool) -> list[dict]:
    """Devices that were found, in order of preference; cpu is always there."""
    order = [d for d in DEVICE_LABELS if d in probed or d == "cpu"]
    return [{"id": d, "label": DEVICE_LABELS[d], "ready": models_ready} for d in order]


class JobSlot:
    """One running job at a time: a second one is refused, and so is any during shutdown."""

    def __init__(self) -> None:
        self._lock, self.running, self.closing = threading.Lock(), None, False

    def check(self) -> None:
        """A job could start now."""
        if self.running is not None:
            raise RequestError(409, "another job is running", "busy")
        if self.closing:
            raise RequestError(503, "shutting down", "shutting_down")

    def start(self, job_id: int) -> None:
        with self._lock:
            self.check()
            self.running = job_id

    def release(self) -> None:
        with self._lock:
            self.running = None

    def drain(self, queue: list[dict], run: Callable[[dict], None]) -> list[tuple[dict, Exception]]:
        """Runs queued items in order; a busy slot keeps the rest, another error drops its item. Returns what was dropped."""
        dropped = []
        while queue:
            try:
                run(queue[0])
            except RequestError as error:
                if error.status == 409:
                    break
                dropped.append((queue[0], error))
            except Exception as error:
                dropped.append((queue[0], error))
            queue.pop(0)
        return dropped


def finish(query: StreamingQuery, timeout: float = 30.0) -> None:
    """Stops a live stream after all that has arrived is processed."""
    query.processAllAvailable()
    query.stop()
    query.awaitTermination(int(timeout))


def drain(query: StreamingQuery, timeout: float = 30.0) -> None:
    """``finish`` for a query with timers, which always has another micro-batch: it has come to the end of what arrived once two
    of them in a row have read nothing, or if it has had none yet."""
    quiet, seen, end = 0.0, (query.lastProgress or {}).get("batchId"), time.time() + timeout
    while query.isActive and quiet < 2 and time.time() < end:
        last = query.lastProgress
        if last is None:
            quiet += 0 if query.status["isTriggerActive"] or query.status["isDataAvailable"] else 0.1
        elif last["batchId"] != seen:
            quiet, seen = quiet + 1 if last["numInputRows"] == 0 else 0, last["batchId"]
        time.sleep(0.1)
    query.stop()
    query.awaitTermination(int(timeout))


def cancel(query: StreamingQuery, grace: float = 8.0) -> None:
    """Stops a live stream as it is, one that has failed too."""
    query.stop()
    try:
        query.awaitTermination(int(grace))
    except StreamingQueryException:
        pass
