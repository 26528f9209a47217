"""Growing captures read as a stream, each byte once, over kills and restarts."""

import numpy as np
import pytest

from scribelake.sources.capture import LAST, CaptureReader, read_capture

R = 16_000


def noise(n, seed):
    return np.random.default_rng(seed).integers(-9000, 9000, n).astype("<i2")


def test_kill_and_restart(spark, tmp_path):
    """Three queries in a row with one checkpoint, the second of them broken amid a micro-batch: every sample comes once."""
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    a, b = noise(3 * R + 77, 1), noise(R, 2)
    broken = []

    def keep(batch, number):
        rows = batch.coalesce(1)
        rows.write.mode("overwrite").parquet(str(out / f"batch-{number:04d}"))
        if broken:
            raise OSError("killed")

    def run():
        query = read_capture(spark, str(folder)).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    (folder / "a.pcm").write_bytes(a[:R].tobytes() + b"x")  # half a sample has come
    run()
    (folder / "a.pcm").write_bytes(a[: 2 * R].tobytes())
    (folder / "b.pcm").write_bytes(b.tobytes())
    (folder / "b.end").touch()
    broken.append(True)
    with pytest.raises(Exception, match="killed"):
        run()
    broken.clear()
    (folder / "a.pcm").write_bytes(a.tobytes())
    (folder / "a.log").write_text("gain lowered")
    run()
    run()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(str(out)).collect()
    for name, pcm in (("a", a), ("b", b)):
        own = sorted((r for r in rows if r["recording_id"] == name and r["samples"]), key=lambda r: r["seq"])
        assert np.concatenate([r["samples"] for r in own]).tolist() == pcm.tolist()
        assert [r["seq"] for r in own] == np.cumsum([0, *(len(r["samples"]) for r in own[:-1])]).tolist()
    assert [(r["recording_id"], r["seq"]) for r in rows if r["stop"]] == [("b", LAST)]
    assert [(r["recording_id"], r["said"]) for r in rows if r["said"]] == [("a", "gain lowered")]


def test_offsets_and_parts(tmp_path):
    reader = CaptureReader({"path": str(tmp_path), "mostSeconds": "1"})
    assert reader.initialOffset() == reader.latestOffset() == {} and reader.partitions({}, {}) == []
    (tmp_path / "a.pcm").write_bytes(noise(2 * R + 10, 3).tobytes())
    end = reader.latestOffset()
    assert end == {"a": [2 * (2 * R + 10), 0, False]}
    assert [(p.start, p.end) for p in reader.partitions({}, end)] == [(0, 2 * R), (2 * R, 4 * R), (4 * R, 4 * R + 20)]
    assert reader.partitions(end, end) == []
    (tmp_path / "a.end").touch()
    (stop,) = reader.partitions(end, reader.latestOffset())
    assert list(reader.read(stop)) == [("a", LAST, [], True, None)]
    with pytest.raises(ValueError):
        CaptureReader({})
