"""Logs that are compacted without a moment in which their events are not there."""

import os

import pytest

from scribelake.api import Library
from scribelake.sources.event_log import EventLog


def opened(spark, tmp_path, **options):
    ticks = iter(range(10**6))
    return Library(spark, str(tmp_path / "lib"), clock=lambda: 1.7e9 + next(ticks), **options)


def filled(lib, n=4):
    folder = lib.create_folder("one")
    ids = [lib.create(f"note {k}", "audio", transcript=f"text {k}", folder_id=folder if k % 2 else None) for k in range(n)]
    lib.update(ids[0], title="changed", starred=True)
    lib.delete(ids[-1])
    return sorted(map(tuple, lib.notes().collect())), ids


def files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


@pytest.mark.parametrize("breaks_at", ["_write", "_mark", "_remove"])
def test_a_compaction_that_breaks_leaves_every_note(spark, tmp_path, monkeypatch, breaks_at):
    lib = opened(spark, tmp_path)
    before, _ = filled(lib)
    lib.compact()
    lib.update(1, title="later")
    before = sorted(map(tuple, lib.notes().collect()))

    def broken(self, *args, **options):
        if breaks_at == "_write":
            spark.range(3).write.parquet(f"{args[1]}/part=0")  # something, but not all
        raise OSError("power cut")

    with monkeypatch.context() as m:
        m.setattr(EventLog, breaks_at, broken)
        with pytest.raises(OSError):
            lib.compact()
    again = opened(spark, tmp_path)
    assert sorted(map(tuple, lib.notes().collect())) == sorted(map(tuple, again.notes().collect())) == before
    again.update(2, title="after")
    again.compact()
    assert {r["id"]: r["title"] for r in opened(spark, tmp_path).notes().collect()}[2] == "after"


def test_appends_are_counted_over_openings_and_both_logs_shrink(spark, tmp_path):
    lib = opened(spark, tmp_path, compact_after=100)
    before, ids = filled(lib)
    for k in range(5):
        lib = opened(spark, tmp_path, compact_after=100)
        lib.update(ids[0], title=f"title {k}")
    gone = lib.create_folder("two")
    lib.delete_folder(gone)
    assert lib._logs["note_events"].appended == 11
    last = opened(spark, tmp_path, compact_after=12)
    last.update(ids[0], title="changed")
    assert last._logs["note_events"].appended == 0
    assert last._events("note_events").count() <= 6 and last._events("folder_events").count() == 2
    assert [r["name"] for r in last.folders().collect()] == ["one"]
    assert [r[:2] for r in sorted(map(tuple, last.notes().collect()))] == [r[:2] for r in before]


def test_opening_writes_nothing(spark, tmp_path):
    lib = opened(spark, tmp_path)
    filled(lib)
    n = len(files(tmp_path / "lib"))
    for _ in range(3):
        opened(spark, tmp_path)
    assert len(files(tmp_path / "lib")) == n


def test_readers_of_the_log_before_can_finish(spark, tmp_path):
    lib = opened(spark, tmp_path)
    before, _ = filled(lib)
    begun = lib.notes()
    lib.compact()
    assert sorted(map(tuple, begun.collect())) == before
    lib.compact()
    assert len([n for n in os.listdir(tmp_path / "lib") if n.startswith("note_events")]) == 2


def test_one_note_reads_its_own_files(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), "seq long, op string, note_id long", "note_id", span=100)
    log.rewrite(spark.range(1000).selectExpr("id AS seq", "'create' AS op", "id AS note_id"))
    log.append([(1000, "update", 250), (1001, "update", 7)])
    rows = log.read(250)
    assert sorted(r["seq"] for r in rows.collect()) == [250, 1000]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(note_id,250)" in plan
    read = {r[0].split("/part=")[1].split("/")[0] for r in rows.select("_metadata.file_path").collect()}
    assert read == {"2"}
    assert log.read().count() == 1002
    footer = [f for f in (tmp_path / "log-1" / "part=2").glob("*.parquet")][0]
    import pyarrow.parquet as pq

    ids = pq.read_table(footer, partitioning=None)["note_id"].to_pylist()
    assert ids == sorted(ids)


def test_a_single_note_folds_like_all(spark, tmp_path):
    lib = opened(spark, tmp_path)
    filled(lib, 6)
    everything = {r["id"]: r.asDict() for r in lib.notes().collect()}
    assert {i: lib.get(i) for i in range(1, 8)} == {i: everything.get(i) for i in range(1, 8)}
