import datetime
import time

import numpy as np
from pyspark.sql import functions as F

from scribelake.operators import jobs, signal
from scribelake.operators.signal import pad_chunks
from scribelake.api import cancel, finish
from scribelake.sources.audio import decode
from scribelake.sources.wav_source import write_wav
from scribelake.streaming.live import JOB, job_states, live_segments, mix_live, mix_tiles, paced, pause_sessions, record, status, step, tile_stream, watched_segments, with_offsets, with_prefix

R = 16_000
FOLDED = ("state", "phase", "stage", "percent", "text", "saved", "error", "code", "file", "ready", "step", "size", "duration")


def drained(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)


def write_steps(spark, rows, schema, path, size):
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(str(path))


def test_live_segments_do_not_depend_on_batches(spark, tmp_path):
    loud = lambda s, seed: (np.random.default_rng(seed).standard_normal(int(s * R)) * 3000).astype(np.int16)
    pcm = np.concatenate([loud(7, 1), np.zeros(int(0.6 * R), np.int16), loud(4, 2)])
    schema = "recording_id string, seq long, samples array<smallint>, stop boolean"
    rows = [("a", i, pcm[at : at + R // 2].tolist(), False) for i, at in enumerate(range(0, len(pcm), R // 2))]
    rows.append(("a", len(rows), [], True))
    found = []
    for size in (5, 100):
        folder = tmp_path / f"in{size}"
        write_steps(spark, rows, schema, folder, size)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = drained(live_segments(stream), f"segments{size}").orderBy("start").collect()
        found.append([(r["start"], r["end"]) for r in out])
        assert np.concatenate([r["samples"] for r in out]).tolist() == pcm.tolist()
    assert found[0] == found[1] and len(found[0]) == 2 and 7 * R <= found[0][0][1] <= 7.6 * R


def test_one_long_row_is_cut_like_many(spark, tmp_path):
    pcm = np.concatenate([(np.random.default_rng(i).standard_normal(9 * R) * 3000).astype(np.int16) if i % 2 == 0 else np.zeros(R // 2, np.int16) for i in range(9)])
    schema, found = "recording_id string, seq long, samples array<smallint>, stop boolean", []
    for name, step_ in (("one", len(pcm)), ("many", 3000)):
        rows = [("a", i, pcm[at : at + step_].tolist(), at + step_ >= len(pcm)) for i, at in enumerate(range(0, len(pcm), step_))]
        rows += [("a", 10_000, pcm[:R].tolist(), True)]  # after the stop: a recording of its own
        write_steps(spark, rows, schema, tmp_path / name, len(rows))
        out = drained(live_segments(spark.readStream.schema(schema).parquet(str(tmp_path / name))), f"long_{name}").collect()
        found.append(sorted((r["start"], r["end"]) for r in out))
    assert found[0] == found[1] and (0, R) in found[0]
    cuts = sorted(set(found[0]) - {(0, R)})
    assert len(cuts) > 3 and cuts[-1][1] == len(pcm) and all(b - a <= 20.5 * R for a, b in cuts) and all(x[1] == y[0] for x, y in zip(cuts, cuts[1:]))


WATCHED = "recording_id string, seq long, samples array<smallint>, stop boolean, said string"


def watched(spark, folder, name, silence, prefixes=None):
    stream = spark.readStream.schema(WATCHED).option("maxFilesPerTrigger", 2).parquet(str(folder))
    return watched_segments(stream, silence=silence, prefixes=prefixes).writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="200 milliseconds").start()


def until(condition, seconds=60):
    end = time.time() + seconds
    while not (found := condition()):
        assert time.time() < end, "waited too long"
        time.sleep(0.2)
    return found


def pieces(name, pcm, stop, said=None):
    rows = [(name, i, pcm[at : at + R // 2].tolist(), False, said[i] if said and i < len(said) else None) for i, at in enumerate(range(0, len(pcm), R // 2))]
    return rows + ([(name, len(rows), [], True, None)] if stop else [])


def test_a_source_that_falls_silent_is_noticed(spark, tmp_path):
    """One recording is stopped, two never are: a timer ends those, with their tails and their sources' last words."""
    loud = lambda s, seed: (np.random.default_rng(seed).standard_normal(int(s * R)) * 3000).astype(np.int16)
    sound = {"stopped": np.concatenate([loud(7, 1), np.zeros(int(0.6 * R), np.int16), loud(4, 2)]), "broken": loud(3, 3), "mute": loud(1, 4)}
    rows = pieces("stopped", sound["stopped"], True) + pieces("broken", sound["broken"], False, ["opened\n", None, "x" * 2000, "device unplugged"]) + pieces("mute", sound["mute"], False)
    write_steps(spark, rows, WATCHED, tmp_path / "in", 9)
    query = watched(spark, tmp_path / "in", "watched", 4, spark.createDataFrame([("stopped", "기존 본문. "), ("broken", " ")], "recording_id string, prefix string"))
    try:
        ends = until(lambda: (lambda e: e if len(e) == 3 else None)([r for r in spark.table("watched").collect() if r["kind"] in ("ended", "lost")]))
        out = spark.table("watched").collect()
        # Another row begins the recording anew, and another timer ends it.
        write_steps(spark, pieces("mute", sound["mute"], False), WATCHED, tmp_path / "in", 9)
        until(lambda: sum(r["kind"] == "lost" and r["recording_id"] == "mute" for r in spark.table("watched").collect()) == 2)
    finally:
        query.stop()
    assert {r["recording_id"]: r["kind"] for r in ends} == {"stopped": "ended", "broken": "lost", "mute": "lost"}
    last = next(r["said"] for r in ends if r["recording_id"] == "broken")
    assert last.endswith("device unplugged") and len(last) == 1500 and next(r["said"] for r in ends if r["recording_id"] == "mute") == ""
    for name, pcm in sound.items():
        own = sorted((r for r in out if r["recording_id"] == name and r["kind"] == "segment"), key=lambda r: r["start"])
        assert np.concatenate([r["samples"] for r in own]).tolist() == pcm.tolist()
        assert next(r["start"] for r in ends if r["recording_id"] == name) == len(pcm)
    assert [(r["recording_id"], r["start"], r["said"]) for r in out if r["kind"] == "prefix"] == [("stopped", -1, "기존 본문.")]
    plain = drained(live_segments(spark.readStream.schema(WATCHED).parquet(str(tmp_path / "in"))), "unwatched").where("recording_id = 'stopped'").collect()
    assert sorted((r["start"], r["end"], r["sum_sq"]) for r in out if r["recording_id"] == "stopped" and r["kind"] == "segment") == sorted((r["start"], r["end"], r["sum_sq"]) for r in plain)


def test_two_streams_are_mixed_and_keep_their_tails(spark, tmp_path):
    schema = "recording_id string, seq long, samples array<smallint>, stop boolean"
    own = np.random.default_rng(3)
    a, b = (own.integers(-30_000, 30_000, n).astype(np.int16) for n in (2000, 2600))
    for name, pcm, sizes in (("a", a, 300), ("b", b, 700)):
        rows = [("r", i, pcm[at : at + sizes].tolist(), at + sizes >= len(pcm)) for i, at in enumerate(range(0, len(pcm), sizes))]
        write_steps(spark, rows, schema, tmp_path / name, 2)
    read = lambda n: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    out = drained(mix_live(read("a"), read("b")), "mixed").orderBy("offset").collect()
    mixed = np.concatenate([r["samples"] for r in out])
    assert mixed.tolist() == ((a.astype(int) + b[:2000].astype(int)) // 2).tolist()
    assert [r["offset"] for r in out] == np.cumsum([0, *(len(r["samples"]) for r in out[:-1])]).tolist()


PACE = "recording_id string, seq long, expected long, samples array<smallint>, stop boolean"


TILES = "recording_id string, tile_idx long, ts timestamp, samples array<smallint>"


def test_joined_streams_of_tiles_mix_like_tables(spark, tmp_path):
    """Tiles that come late or out of order, some without a partner; what no partner can come for leaves the state."""
    rng = np.random.default_rng(8)
    began = datetime.datetime(2024, 5, 1, 12, 0, 0)
    tile = lambda n, i, lag: (n, i, began + datetime.timedelta(milliseconds=10 * i + lag), rng.integers(-30_000, 30_000, int(rng.integers(100, 161))).tolist())
    left = [tile(n, i, int(rng.integers(0, 300))) for i in range(0, 3000, 10) for n in "pq" if i % 70]
    right = [tile(n, i, int(rng.integers(0, 300))) for i in range(0, 3000, 10) for n in "pq" if i % 90]
    for name, rows in (("a", left), ("b", right)):
        order = sorted(rows, key=lambda r: r[2] + datetime.timedelta(milliseconds=int(rng.integers(0, 400))))
        write_steps(spark, order, TILES, tmp_path / name, 100)
    read = lambda n: spark.readStream.schema(TILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    query = mix_tiles(read("a"), read("b")).writeStream.format("memory").queryName("joined").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    want = signal.mix(*(spark.createDataFrame(r, TILES) for r in (left, right)), ["recording_id"])
    key = lambda r: (r["recording_id"], r["tile_idx"], tuple(r["samples"]))
    assert sorted(map(key, spark.table("joined").collect())) == sorted(map(key, want.collect())) and want.count() > 300
    assert held < len(left) + len(right)


def test_a_stream_with_holes_is_filled_like_a_table(spark, tmp_path):
    rng, rows = np.random.default_rng(6), []
    for name in "ab":
        at = 0
        for seq in range(40):
            n = int(rng.integers(0, 900))
            at += n + (int(rng.integers(0, 3000)) if seq % 5 == 0 else 0)
            rows.append((name, seq, at, rng.integers(-99, 99, n).astype(int).tolist() if seq % 7 else None, name == "a" and seq == 39))
    whole = pad_chunks(spark.createDataFrame(rows, PACE), "recording_id").collect()
    want = {n: sum((list(r["samples"]) for r in sorted((r for r in whole if r["recording_id"] == n), key=lambda r: r["seq"])), []) for n in "ab"}
    assert all(r["padding"] == 0 or r["padding"] > 1600 for r in whole) and sum(r["padding"] > 0 for r in whole) > 4
    write_steps(spark, rows, PACE, tmp_path / "in", 7)
    stream = spark.readStream.schema(PACE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = paced(stream, every=None).writeStream.format("memory").queryName("paced").outputMode("append").trigger(processingTime="100 milliseconds").start()
    try:
        until(lambda: spark.table("paced").selectExpr("sum(size(samples))").first()[0] == sum(map(len, want.values())))
    finally:
        query.stop()
    for name in "ab":
        own = sorted((r for r in spark.table("paced").collect() if r["recording_id"] == name), key=lambda r: r["offset"])
        assert sum((list(r["samples"]) for r in own), []) == want[name]
        assert [r["offset"] for r in own] == np.cumsum([0, *(len(r["samples"]) for r in own[:-1])]).tolist()


def test_a_timer_adds_silence_while_no_row_comes(spark, tmp_path):
    write_steps(spark, [("a", 0, 800, [5] * 800, False)], PACE, tmp_path / "in", 1)
    stream = spark.readStream.schema(PACE).parquet(str(tmp_path / "in"))
    began = time.time()
    query = paced(stream).writeStream.format("memory").queryName("ticking").outputMode("append").trigger(processingTime="100 milliseconds").start()
    try:
        until(lambda: (spark.table("ticking").selectExpr("sum(size(samples))").first()[0] or 0) > 800 + 3 * R)
        rows = sorted(spark.table("ticking").collect(), key=lambda r: r["offset"])
    finally:
        query.stop()
    assert list(rows[0]["samples"]) == [5] * 800 and not any(x for r in rows[1:] for x in r["samples"])
    assert [r["offset"] for r in rows] == np.cumsum([0, *(len(r["samples"]) for r in rows[:-1])]).tolist()
    assert sum(len(r["samples"]) for r in rows) <= 800 + (time.time() - began) * R


def test_pause_sessions_stream_like_batch(spark, tmp_path):
    at = [0, 200, 800, 1600, 1800, 5000]
    rows = spark.createDataFrame([("a", t) for t in at], "rec string, ms long").select("rec", F.timestamp_millis("ms").alias("ts"))
    want = sorted((r["rec"], r["start"], r["last"], r["voiced"]) for r in pause_sessions(rows, ["rec"]).collect())
    assert [v for *_, v in want] == [3, 2, 1]
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    got = drained(pause_sessions(stream, ["rec"]), "pauses", "complete")
    assert sorted((r["rec"], r["start"], r["last"], r["voiced"]) for r in got.collect()) == want


def test_job_states_stream_like_fold(spark, tmp_path):
    rng = np.random.default_rng(1)
    kinds, rows = ["phase", "file", "ready", "text", "preview", "stage", "progress", "step", "size", "duration"], []
    for job in range(6):
        for seq in range(20):
            kind = kinds[rng.integers(len(kinds))]
            rows.append((job, seq, kind, ["recording", "transcribing", "finishing"][rng.integers(3)] if kind == "phase" else str(seq) if kind in ("progress", "duration") else f"v{seq}", float(seq)))
        if job % 2:
            rows.append((job, 20, ["done", "error", "cancelled"][job // 2], "end", 20.0))
    schema = "job_id int, seq long, kind string, value string, ts double"
    folded = {r["job_id"]: r for r in jobs.fold(spark.createDataFrame(rows, schema)).collect()}
    for job, row in folded.items():
        state = JOB
        for _, _, kind, value, _ in (r for r in rows if r[0] == job):
            state = step(state, kind, value)
        assert [row[c] for c in FOLDED] == [state[c] for c in FOLDED], job
    write_steps(spark, rows, schema, tmp_path / "in", 13)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}
    for r in drained(job_states(stream), "jobs", "update").collect():
        if r["seq"] >= last.get(r["job_id"], (-1,))[0]:
            last[r["job_id"]] = (r["seq"], *(r[c] for c in FOLDED))
    assert {k: v[1:] for k, v in last.items()} == {k: tuple(r[c] for c in FOLDED) for k, r in folded.items()}


def test_clock_and_salvage(spark):
    rows = [(1, 0, "phase", "recording", 10.0), (1, 1, "text", "부분", 12.0), (1, 2, "preview", "부분 더", 13.0), (1, 3, "phase", "finishing", 15.0), (1, 4, "phase", "recording", 16.0), (1, 5, "cancelled", None, 20.0), (2, 0, "stage", "x", 1.0)]
    events = spark.createDataFrame(rows, "job_id int, seq long, kind string, value string, ts double")
    assert {r["job_id"]: r["recorded_seconds"] for r in jobs.clock(events, 99.0).collect()} == {1: 5.0, 2: 0.0}
    fold = jobs.fold(events)
    first = fold.where("job_id = 1").first()
    assert first["phase"] == "finishing" and first["code"] == "cancelled" and first["error"] == jobs.DEFAULT_ERROR and first["text"] == "부분 더"
    assert [tuple(r) for r in jobs.salvage(fold).collect()] == [(1, "부분")]
    assert with_prefix("기존 본문. ", ["7초 구간", "4초 구간"]) == "기존 본문.\n\n7초 구간\n\n4초 구간" and with_prefix(" ", ["a"]) == "a"


def test_recording_is_kept_and_assembled(spark, tmp_path):
    pcm = (np.random.default_rng(4).standard_normal(20_000) * 3000).astype(np.int16)
    schema = "recording_id string, seq long, samples array<smallint>, stop boolean"
    rows = [("a", i, pcm[at : at + 8000].tolist(), False) for i, at in enumerate(range(0, len(pcm), 8000))]
    write_steps(spark, rows, schema, tmp_path / "in", 1)
    query = record(tile_stream(spark, str(tmp_path / "in")), str(tmp_path / "kept"), str(tmp_path / "check"))
    query.awaitTermination()
    assert status(query)["active"] is False and status(query)["error"] is None
    write_wav(with_offsets(spark.read.parquet(str(tmp_path / "kept")).repartition(4)), str(tmp_path / "take.wav"))
    assert decode((tmp_path / "take.wav").read_bytes()).tolist() == pcm.tolist()
    assert finish(query) is None and cancel(query) is None
