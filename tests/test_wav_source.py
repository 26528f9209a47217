"""WAV files read in parts: which bytes, which samples, and the filter between rates."""

import struct

import numpy as np
import pytest

from scribelake.sources import wav_source
from scribelake.sources.audio import decode, samples_between, wav_bytes
from scribelake.sources.resample import resample, resampled_length, source_range
from scribelake.sources.wav_source import RUN, Part, WavReader, read_samples, read_track, read_wav

R = 16_000


def wav(path, frames, rate=R, width=2, kind=1, channels=1, extra=b""):
    """A file written by hand: any format, and chunks before the samples."""
    raw = frames.tobytes()
    head = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * width, channels * width, 8 * width)
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(raw)) + raw
    path.write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    return str(path)


def noise(n, seed=1):
    return np.random.default_rng(seed).integers(-9000, 9000, n).astype("<i2")


@pytest.mark.parametrize("rate", [44_100, 48_000, 22_050, 32_000, 16_001])
def test_what_is_above_eight_kilohertz_goes(rate):
    t = np.arange(rate) / rate
    n = resampled_length(len(t), rate, R)
    loud = lambda y: 20 * np.log10(np.sqrt((y[1000:-1000] ** 2).mean()) * 2**0.5 + 1e-12)
    for hz in (10_000, 8_300):
        if hz < rate / 2:
            assert loud(resample(np.sin(2 * np.pi * hz * t), 0, 0, n, rate, R)) < -60
    for hz in (300, 3000, 6800):
        y = resample(np.sin(2 * np.pi * hz * t), 0, 0, n, rate, R)
        assert np.abs(y - np.sin(2 * np.pi * hz * np.arange(n) / R))[1000:-1000].max() < 1e-3


@pytest.mark.parametrize("rate", [8000, 11_025, 16_000, 44_100, 48_000])
def test_parts_are_equal_to_the_whole(rate):
    x = noise(rate * 2).astype(float)
    n = resampled_length(len(x), rate, R)
    whole = resample(x, 0, 0, n, rate, R)
    cuts = [0, 1, 159, 5000, 5001, 17_777, n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low, high = source_range(a, b, rate, R)
        own = x[max(low, 0) : high]
        np.testing.assert_array_equal(resample(own, max(low, 0), a, b, rate, R), whole[a:b])


@pytest.mark.parametrize("rate,channels", [(R, 1), (44_100, 2)])
def test_a_file_is_read_by_many_tasks(spark, tmp_path, rate, channels):
    frames = noise(rate * 45 * channels).reshape(-1, channels)
    path = wav(tmp_path / "long.wav", frames, rate, channels=channels, extra=b"LIST" + struct.pack("<I", 3) + b"abc\x00")
    rows = read_wav(spark, path, part_seconds=7)
    assert rows.rdd.getNumPartitions() == 7
    got = rows.orderBy("offset").collect()
    assert [r["offset"] for r in got] == list(range(0, 45 * R, RUN)) and {r["path"] for r in got} == {path}
    sound = np.concatenate([r["samples"] for r in got])
    np.testing.assert_array_equal(sound, decode((tmp_path / "long.wav").read_bytes()))
    if rate == R:
        np.testing.assert_array_equal(sound, frames[:, 0])


def test_a_slice_reads_only_its_bytes(spark, tmp_path, monkeypatch):
    frames = noise(60 * R)
    path = wav(tmp_path / "a.wav", frames)
    read = []
    monkeypatch.setattr(wav_source, "read_samples", lambda track, start, end: read.append((start, end)) or read_samples(track, start, end))
    from pyspark.sql.datasource import GreaterThan, LessThan

    reader = WavReader({"path": path, "partSeconds": "10"})
    assert list(reader.pushFilters([GreaterThan(("offset",), 20 * R - RUN), LessThan(("offset",), 23 * R)])) == []
    parts = reader.partitions()
    assert parts == [Part(parts[0].track, 20 * R, 23 * R)]
    list(reader.read(parts[0]))
    assert read == [(20 * R, 23 * R)]
    rows = samples_between(read_wav(spark, path, 10), 20 * R + 5, 23 * R - 7)
    np.testing.assert_array_equal(np.concatenate([r["samples"] for r in rows.orderBy("offset").collect()]), frames[20 * R + 5 : 23 * R - 7])
    assert rows.rdd.getNumPartitions() == 1
    scan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in scan or "BatchScan" in scan


def test_conditions_choose_files(spark, tmp_path):
    paths = [wav(tmp_path / f"{k}.WAV", noise(3 * R, k)) for k in range(4)]
    (tmp_path / "notes.txt").write_text("no sound")
    rows = read_wav(spark, str(tmp_path))
    assert rows.where("offset = 16000").count() == 4 and rows.where("offset > 16000 and offset < 16001").count() == 0
    own = rows.where(rows["path"] == paths[2])
    assert own.rdd.getNumPartitions() == 1
    np.testing.assert_array_equal(np.concatenate([r["samples"] for r in own.orderBy("offset").collect()]), noise(3 * R, 2))
    assert rows.where("offset >= 16000 and size(samples) > 0").count() == 8


@pytest.mark.parametrize("width,kind", [(1, 1), (2, 1), (3, 1), (4, 1), (4, 3), (8, 3)])
def test_sample_formats(tmp_path, width, kind):
    sound = noise(2000).astype(int)
    raw = {
        (1, 1): lambda: (sound // 256 + 128).astype(np.uint8), (2, 1): lambda: sound.astype("<i2"), (4, 1): lambda: (sound << 16).astype("<i4"),
        (3, 1): lambda: np.stack([(sound << 8 >> s).astype(np.uint8) for s in (0, 8, 16)], axis=1), (4, 3): lambda: (sound / 32768).astype("<f4"), (8, 3): lambda: (sound / 32768).astype("<f8"),
    }[width, kind]()
    track = read_track(wav(tmp_path / "a.wav", raw, width=width, kind=kind))
    want = sound // 256 * 256 if width == 1 else sound
    np.testing.assert_array_equal(read_samples(track, 0, track.length), want)


def test_files_cut_off_and_files_without_sound(tmp_path):
    whole = wav_bytes(noise(R))
    (tmp_path / "cut.wav").write_bytes(whole[: 44 + 2 * 5000])
    assert read_track(str(tmp_path / "cut.wav")).length == 5000
    (tmp_path / "open.wav").write_bytes(whole[:40] + struct.pack("<I", 0) + whole[44:])
    assert read_track(str(tmp_path / "open.wav")).length == R
    for name, content in (("none", wav_bytes(np.zeros(0, np.int16))), ("text", b"hello"), ("empty", b""), ("odd", whole[:20] + struct.pack("<H", 7) + whole[22:])):
        (tmp_path / f"{name}.wav").write_bytes(content)
        with pytest.raises(ValueError, match=f"{name}.wav"):
            read_track(str(tmp_path / f"{name}.wav"))
    with pytest.raises(ValueError):
        decode(b"hello")


def test_paths_of_file_systems(tmp_path):
    path = wav(tmp_path / "a.wav", noise(100))
    assert read_track(f"file://{path}").length == read_track(f"file:{path}").length == 100
    assert wav_source.can_read(path) and not wav_source.can_read("viewfs://store/a.wav")
    with pytest.raises(FileNotFoundError):
        WavReader({"path": str(tmp_path / "gone")}).partitions()
    with pytest.raises(ValueError):
        WavReader({})


def test_tasks_write_one_file(spark, tmp_path):
    """Runs in any order from many tasks, with a hole; the file is there when all have written, and not before."""
    pcm = noise(30 * R)
    rows = [(at, pcm[at : at + 700].tolist()) for at in range(0, len(pcm), 700) if at != 7000]
    runs = spark.createDataFrame(rows, "offset long, samples array<smallint>").repartition(9)
    path = str(tmp_path / "new" / "out.wav")
    wav_source.write_wav(runs, path)
    want = pcm.copy()
    want[7000:7700] = 0
    np.testing.assert_array_equal(decode((tmp_path / "new" / "out.wav").read_bytes()), want)
    assert [f.name for f in (tmp_path / "new").iterdir()] == ["out.wav"]
    with pytest.raises(Exception, match="out.wav"):
        wav_source.write_wav(runs, path)
    wav_source.write_wav(runs.where("offset < 1400"), path, overwrite=True)
    assert read_track(path).length == 1400
    with pytest.raises(Exception, match="mounted"):
        wav_source.write_wav(runs, "s3://bucket/a.wav")


def test_a_write_that_breaks_leaves_the_old_file(spark, tmp_path):
    from pyspark.sql import functions as F

    path = tmp_path / "out.wav"
    path.write_bytes(b"old")
    rows = spark.range(0, 4000, 1, 4).select((F.col("id") * 160).alias("offset"), F.when(F.col("id") < 3500, F.array_repeat(F.lit(1), 160)).otherwise(F.array(F.raise_error(F.lit("no disk")).cast("int"))).cast("array<smallint>").alias("samples"))
    with pytest.raises(Exception, match="no disk"):
        wav_source.write_wav(rows, str(path), overwrite=True)
    assert path.read_bytes() == b"old" and [f.name for f in tmp_path.iterdir()] == ["out.wav"]


def test_a_task_that_writes_again_changes_nothing(tmp_path):
    """Two attempts of a task, and parts in any order: bytes go to their own places."""
    import pyarrow as pa

    writer = wav_source.WavWriter({"path": str(tmp_path / "a.wav")}, False)
    batch = lambda offset, s: pa.RecordBatch.from_arrays([pa.array([offset], pa.int64()), pa.array([s], pa.list_(pa.int16()))], names=["offset", "samples"])
    late = writer.write(iter([batch(5, [6, 7, 8])]))
    writer.write(iter([batch(0, [1, 2, 3, 4, 5])]))
    early = writer.write(iter([batch(0, [1, 2, 3, 4, 5])]))
    writer.commit([late, None, early])
    assert decode((tmp_path / "a.wav").read_bytes()).tolist() == [1, 2, 3, 4, 5, 6, 7, 8]


def test_stores_that_take_one_writer(spark, tmp_path, monkeypatch):
    from scribelake.sources import audio

    monkeypatch.setattr(audio, "mounted", lambda path: False)
    pcm = noise(5000)
    runs = spark.createDataFrame([(at, pcm[at : at + 700].tolist()) for at in range(0, 5000, 700)], "offset long, samples array<smallint>").repartition(3)
    path = audio.AudioFolder(spark, str(tmp_path)).keep_runs("a.wav", runs)
    assert decode(open(path, "rb").read()).tolist() == pcm.tolist()
