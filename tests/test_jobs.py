"""Whole jobs on a library: transcription of files, live listening, and how they end."""

import threading
import time

import numpy as np
import pytest

from scribelake.api import Library, RequestError
from scribelake.operators.transcribe import transcribe_recordings
from scribelake.sources.audio import decode, wav_bytes
from tests.test_signal import R, embed, noise, runs, tone

BODY = {"device": "cpu"}


def told(text="{:.0f}초 구간", truncated=False):
    """A model that tells how long its audio is."""
    return lambda device: lambda: lambda x: (text.format(len(x) / R), truncated)


@pytest.fixture
def lib(spark, tmp_path):
    ticks = iter(range(10**6))
    return Library(spark, str(tmp_path / "lib"), clock=lambda: 1.7e9 + next(ticks))


def wav(tmp_path, pcm, name="take.wav"):
    (tmp_path / name).write_bytes(wav_bytes(pcm))
    return str(tmp_path / name)


def test_recordings_are_transcribed_in_chunks(spark):
    pcm, short = np.full(35 * R, 2000, np.int16), np.full(2 * R, 2000, np.int16)

    def make():
        seen = []

        def model(x):
            seen.append(len(x))
            return ("잘림", True) if len(x) > 19 * R else ("수업을 위한 " * 30, True) if len(x) == 2 * R else (f"{len(x)}", False)

        return model

    texts, events = transcribe_recordings(runs(spark, long=pcm, short=short, silent=np.zeros(3 * R, np.int16)), make, "rec")
    got = {r["rec"]: r for r in texts.collect()}
    parts = got["long"]["transcript"].split("\n\n")
    assert "잘림" not in parts and sum(map(int, parts)) == 35 * R and got["long"]["duration"] == 35
    assert got["short"]["transcript"] == "수업을 위한" and got["silent"]["transcript"] == ""
    rows = events.where("rec = 'long'").orderBy("seq").collect()
    percent = [float(r["value"]) for r in rows if r["kind"] == "progress"]
    assert rows[0]["kind"] == "duration" and rows[-1]["kind"] == "done" and percent == sorted(percent) and percent[-1] == 100


def test_chunks_never_cross_a_speaker_and_paragraphs_are_named(spark):
    pcm = np.concatenate([tone(8, 200), tone(8, 3000), tone(30, 200)])
    texts, _ = transcribe_recordings(runs(spark, a=pcm), lambda: lambda x: (f"[{len(x)}]", False), "rec", lambda: embed)
    paragraphs = texts.first()["transcript"].split("\n\n")
    assert [p[:6] for p in paragraphs] == ["화자 1: ", "화자 2: ", "화자 1: "]
    lengths = [int(n) for p in paragraphs for n in p.replace("]", "").split("[")[1:]]
    assert sum(lengths) == len(pcm) and max(lengths) <= 20 * R


def test_a_file_job_writes_its_note(lib, tmp_path):
    assert lib.job_state() == {"state": "idle"}
    note = lib.transcribe(wav(tmp_path, noise(9), "회의.WAV"), BODY, ["cpu"], told())
    found, job = lib.get(note), lib.job_state()
    assert found["title"] == "회의" and found["source"] == "audio" and found["transcript"] == "9초 구간" and found["duration"] == 9
    assert job["state"] == "done" and job["percent"] == 100 and job["text"] == "9초 구간" and job["note_id"] == note and job["op"] == "transcribe"
    assert lib.slot.running is None and (tmp_path / "lib/audio" / found["audio"]).exists()


def test_refused_requests_leave_no_note(lib, tmp_path):
    good = wav(tmp_path, noise(1))
    (tmp_path / "a.txt").write_text("x" * 100)
    for path, body, code in ((str(tmp_path / "none.wav"), BODY, "invalid_file"), (str(tmp_path / "a.txt"), BODY, "invalid_file"), (wav(tmp_path, np.zeros(0, np.int16), "empty.wav"), BODY, "invalid_file"), (good, {"device": "x"}, None), (good, BODY | {"speakers": 1}, None)):
        with pytest.raises(RequestError) as refused:
            lib.transcribe(path, body, ["cpu"], told())
        assert refused.value.status == 400 and refused.value.code == code
    lib.slot.start(99)
    with pytest.raises(RequestError) as busy:
        lib.transcribe(good, BODY, ["cpu"], told())
    assert busy.value.code == "busy" and lib.notes().isEmpty()


def test_a_failed_job_frees_the_slot(lib, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"x" * 100)
    note = lib.transcribe(str(tmp_path / "a.mp3"), BODY, ["cpu"], told())
    job = lib.job_state()
    assert job["state"] == "error" and job["code"] == "failed" and "no decoder" in job["error"] and lib.slot.running is None and lib.get(note)["transcript"] == ""
    given = lib.transcribe(str(tmp_path / "a.mp3"), BODY, ["cpu"], told(), decoders={".mp3": lambda content: noise(7)})
    assert lib.get(given)["transcript"] == "7초 구간"


def rising(seconds=50):
    """Louder every ten seconds, with a pause after each, so chunks differ in loudness."""
    return np.concatenate([np.concatenate([noise(seconds / 5 - 0.6, k) * ((k + 1) / 8), np.zeros(int(0.6 * R), np.int16)]) for k in range(5)]).astype(np.int16)


def loud_ones(act, level):
    """A model that tells how long its audio is, unless it is loud: then it acts."""

    def model(x):
        if float(np.abs(x).max()) > level:
            act()
        return f"{len(x) / R:.0f}초", False

    return lambda device: lambda: model


def stop_at(pcm, chunks):
    """The chunks of a recording, and a level that only the last of them passes."""
    peaks = [float(np.abs(pcm[a:b] / 32768.0).max()) for a, b in chunks]
    assert max(peaks[:-1]) < peaks[-1]
    return (max(peaks[:-1]) + peaks[-1]) / 2


def chunks_of(spark, pcm):
    from scribelake.operators.transcribe import plan_chunks

    _, chunks = plan_chunks(runs(spark, a=pcm), "rec")
    return sorted((r["start"], r["end"]) for r in chunks.collect())


def broken():
    raise RuntimeError("the model ran out of memory")


def test_a_broken_job_keeps_the_chunks_before(spark, lib, tmp_path):
    pcm = rising()
    cut = chunks_of(spark, pcm)
    assert len(cut) >= 3
    note = lib.transcribe(wav(tmp_path, pcm), BODY, ["cpu"], loud_ones(broken, stop_at(pcm, cut)))
    job, kept = lib.job_state(), " ".join(f"{(b - a) / R:.0f}초" for a, b in cut[:-1])
    assert lib.get(note)["transcript"].split() == kept.split()
    assert job["state"] == "error" and job["code"] == "failed" and job["error"] == "the model ran out of memory"
    assert 0 < job["percent"] < 100 and job["saved"].split() == kept.split() and lib.slot.running is None


def test_a_cancelled_job_keeps_the_chunks_before_and_ends_soon(spark, lib, tmp_path):
    pcm = rising()
    cut = chunks_of(spark, pcm)

    def slow():
        import time

        time.sleep(120)

    job = lib.start_transcribe(wav(tmp_path, pcm), BODY, ["cpu"], loud_ones(slow, stop_at(pcm, cut)))
    seen = []
    for _ in range(1200):
        state = lib.job_state()
        seen.append((state["percent"], state["text"]))
        if len(state["saved"].split()) == len(cut) - 1:
            break
        time.sleep(0.1)
    assert state["state"] == "running" and state["phase"] == "transcribing" and state["duration"] == len(pcm) / R
    with pytest.raises(RequestError):
        lib.transcribe(wav(tmp_path, noise(1), "other.wav"), BODY, ["cpu"], told())
    began = time.time()
    lib.cancel_job()
    note = job.wait(60)
    assert time.time() - began < 30
    percents = [p for p, _ in seen]
    assert percents == sorted(percents) and len(set(percents)) > 1
    end = lib.job_state()
    assert end["state"] == "error" and end["code"] == "cancelled" and end["error"] == "취소됐습니다." and lib.slot.running is None
    assert len(lib.get(note)["transcript"].split()) == len(cut) - 1
    lib.cancel_job()  # nothing runs any more
    assert lib.job_state() == end


def test_a_step_that_is_run_again_writes_its_text_once(spark, tmp_path):
    from scribelake.operators.transcribe import plan_chunks
    from scribelake.streaming.file_job import FileSteps

    pcm = np.full(90 * R, 2000, np.int16)
    rows = runs(spark, a=pcm)
    _, chunks = plan_chunks(rows, "rec")
    steps = FileSteps(spark, str(tmp_path / "job"), "rec")
    count = steps.lay_out(rows, chunks, steps=3)
    assert count == 3 and steps.chunks().count() == chunks.count()
    make, told_of, stop = told("{:.1f}")("cpu"), [], threading.Event()

    def first_only(step):
        told_of.append(step)
        if step == 1:
            raise OSError("the driver fails after a step has been written, before the stream knows")

    with pytest.raises(Exception, match="before the stream knows"):
        steps.run(count, make, lambda step: None, first_only, stop)
    again = FileSteps(spark, str(tmp_path / "job"), "rec")
    again.run(count, make, lambda step: None, told_of.append, stop)
    assert told_of == [0, 1, 1, 2]
    assert sum(map(float, again.text().split())) == pytest.approx(90, abs=0.5)


def test_reasons_are_short():
    from scribelake.api import reason

    trace = "An exception was thrown from the Python worker.\nTraceback (most recent call last):\n  File \"x.py\", line 3, in run\nValueError: no decoder for a.mp3\n\nJVM stacktrace:\norg.apache.spark.SparkException: Job aborted\n\tat a.b"
    assert reason(Exception(trace.split("\n\nJVM")[0])) == "no decoder for a.mp3"
    assert reason(ValueError("plain")) == "plain" and reason(ValueError()) == "ValueError"


ROWS = "recording_id string, seq long, samples array<smallint>, stop boolean"
LIVE = BODY | {"source": "mic", "mic": "m"}


def stream_of(spark, tmp_path, pcm, stop=True):
    rows = [("live", i, pcm[at : at + R // 2].tolist(), False) for i, at in enumerate(range(0, len(pcm), R // 2))]
    if stop:
        rows.append(("live", len(rows), [], True))
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))


def test_live_listening_keeps_text_and_recording(spark, lib, tmp_path):
    pcm = np.concatenate([noise(7), np.zeros(int(0.6 * R), np.int16), noise(4, 1)])
    live = lib.listen(stream_of(spark, tmp_path, pcm), LIVE, ["cpu"], told())
    assert lib.job_state()["phase"] == "recording"
    with pytest.raises(RequestError):
        lib.delete(live.job.note_id)
    assert live.finish("기존 본문. ") == "기존 본문.\n\n7초 구간\n\n4초 구간"
    note, job = lib.get(live.job.note_id), lib.job_state()
    assert note["transcript"].endswith("4초 구간") and note["title"].startswith("실시간 전사 ") and note["source"] == "audio"
    assert note["duration"] == len(pcm) / R and decode((tmp_path / "lib/audio" / note["audio"]).read_bytes()).tolist() == pcm.tolist()
    assert job["state"] == "done" and job["phase"] == "finishing" and job["recorded_seconds"] > 0


def heard(live, text):
    end = time.time() + 60
    while live.text() != text:
        assert time.time() < end
        time.sleep(0.2)


def test_cancelled_and_broken_streams(spark, lib, tmp_path):
    pcm = np.concatenate([noise(7), np.zeros(int(0.6 * R), np.int16), noise(4, 1)])
    live = lib.listen(stream_of(spark, tmp_path, pcm, stop=False), LIVE, ["cpu"], told())
    heard(live, "7초 구간")
    live.cancel()
    job = lib.job_state()
    assert job["state"] == "error" and job["code"] == "cancelled" and lib.get(live.job.note_id)["transcript"] == "7초 구간"
    with pytest.raises(RequestError):
        live.finish()
    (tmp_path / "b").mkdir()
    broken_ = lib.listen(stream_of(spark, tmp_path / "b", noise(7)), LIVE, ["cpu"], lambda device: lambda: lambda x: 1 / 0)
    broken_.wait(60)
    job = lib.job_state()
    assert job["code"] == "failed" and job["error"] == "입력이 끊겼습니다.\ndivision by zero" and lib.slot.running is None
    assert not any((tmp_path / "lib/live").iterdir())


def test_a_lost_source_ends_the_job_by_itself(spark, lib, tmp_path):
    """A recorder writes, says something, and dies without an end: the job notices, and keeps text and tail."""
    from scribelake.sources.capture import read_capture

    pcm = np.concatenate([noise(7), np.zeros(int(0.6 * R), np.int16), noise(4, 1)])
    folder = tmp_path / "captures"
    folder.mkdir()
    (folder / "mic.pcm").write_bytes(pcm.astype("<i2").tobytes())
    (folder / "mic.log").write_text("device unplugged")
    live = lib.listen(read_capture(spark, str(folder)), LIVE, ["cpu"], told(), silence=3)
    live.wait(90)
    job = lib.job_state()
    assert job["state"] == "error" and job["code"] == "failed" and job["error"] == "입력이 끊겼습니다.\ndevice unplugged"
    assert lib.get(live.job.note_id)["transcript"] == "7초 구간\n\n4초 구간" and lib.slot.running is None
