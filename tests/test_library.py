import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribelake.api import JobSlot, Library, RequestError, device_list, validate_live, validate_transcribe
from scribelake.functions import text as X
from scribelake.sources.audio import wav_bytes
from scribelake.operators import library, mutations
from scribelake.operators.text import group_packages, keywords, render


class Clock:
    def __init__(self):
        self.now = 1_700_000_000.0

    def __call__(self):
        self.now += 1
        return self.now


@pytest.fixture()
def lib(spark, tmp_path):
    return Library(spark, str(tmp_path / "library"), Clock())


def ids(frame):
    return [r["id"] for r in frame.collect()]


def test_views_search_trash_and_folders(lib):
    folder = lib.create_folder(" 회의 ")
    a = lib.create("a", "audio", "예산 회의 예산 확정", folder_id=folder)
    b = lib.create("b", "live")
    lib.update(a, starred=True)
    assert ids(lib.list()) == [b, a]
    assert ids(lib.list("starred")) == [a] and ids(lib.list("live")) == [b] and ids(lib.list(f"folder:{folder}")) == [a]
    assert ids(lib.list(query=" 예산 ")) == [a] and ids(lib.list(query="   ")) == [b, a]
    assert lib.list().first()["folder"] is None and lib.list("starred").first()["folder"] == "회의"
    lib.update(b, trashed=True)
    assert ids(lib.list()) == [a] and ids(lib.list("trash")) == [b] and ids(lib.list("live")) == []
    lib.update(b, trashed=False)
    assert ids(lib.list("trash")) == []
    lib.delete_folder(folder)
    assert lib.get(a)["folder_id"] is None and lib.folders().count() == 0
    with pytest.raises(ValueError):
        lib.create_folder("  ")
    with pytest.raises(ValueError):
        lib.list("nothing")
    with pytest.raises(ValueError):
        lib.list("folder:x")


def test_create_update_attach_delete(lib, tmp_path):
    folder = lib.create_folder("f")
    kept, lost = lib.create("  ", "live", folder_id=folder), lib.create("x", "live", folder_id=99)
    assert lib.get(kept)["title"] == "제목 없음" and lib.get(kept)["folder_id"] == folder and lib.get(lost)["folder_id"] is None
    with pytest.raises(ValueError):
        lib.update(kept, summary="no")
    before = lib.get(kept)["updated"]
    lib.update(kept)
    assert lib.get(kept)["updated"] == before
    lib.update(kept, title="", duration=2.5)
    note = lib.get(kept)
    assert note["title"] == "" and note["duration"] == 2.5 and note["updated"] > before
    lib.update(kept, duration=None)
    assert lib.get(kept)["duration"] is None
    take, header = tmp_path / "take.wav", tmp_path / "header.wav"
    take.write_bytes(wav_bytes(np.ones(100, np.int16)))
    header.write_bytes(wav_bytes(np.zeros(0, np.int16)))
    assert lib.attach_audio(kept, str(header)) is None and lib.attach_audio(kept, str(tmp_path / "none.wav")) is None
    name = lib.attach_audio(kept, str(take))
    assert name.endswith("-take.wav") and lib.get(kept)["source"] == "audio" and Path(lib.path, "audio", name).read_bytes() == take.read_bytes()
    assert lib.attach_audio(kept, str(take)) is None and lib.attach_audio(12345, str(take)) is None
    with pytest.raises(RequestError):
        lib.delete(kept, running_note=kept)
    lib.delete(lost)
    assert lib.get(lost) is None
    assert lib.create("again", "audio") == lost  # the largest id is free again
    lib.export(kept, str(tmp_path / "out.TXT"))
    assert (tmp_path / "out.TXT").read_bytes().startswith(b"\xef\xbb\xbf")
    with pytest.raises(RequestError):
        lib.export(kept, str(tmp_path / "out.doc"))


def test_folder_id_reuse_does_not_refile(spark):
    notes = [(1, "create", 1, {"title": "n", "folder_id": "1"}, 1.0), (4, "create", 2, {"title": "m", "folder_id": "1"}, 4.0)]
    folders = [(0, "create", 1, "old"), (2, "delete", 1, None), (3, "create", 1, "new")]
    now = mutations.current_notes(spark.createDataFrame(notes, mutations.NOTE_EVENTS), spark.createDataFrame(folders, mutations.FOLDER_EVENTS))
    assert {r["id"]: r["folder_id"] for r in now.collect()} == {1: None, 2: 1}


def test_audio_comes_and_goes_with_its_note(spark, tmp_path):
    take = tmp_path / "회의.wav"
    take.write_bytes(wav_bytes(np.ones(100, np.int16)))
    lib = Library(spark, str(tmp_path / "lib"), clock=lambda: 1_700_000_000.5)
    note = lib.create("n", "audio", audio=str(take))
    kept = tmp_path / "lib/audio/1700000000-회의.wav"
    assert lib.get(note)["audio"] == kept.name and kept.read_bytes() == take.read_bytes()
    lib.delete(note)
    assert not kept.exists() and take.exists()


def test_the_log_is_compacted_as_it_grows(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), clock=map(float, range(1, 1000)).__next__, compact_after=6)
    folder = lib.create_folder("f")
    ids_ = [lib.create(f"n{i}", "audio", folder_id=folder) for i in range(3)]
    lib.update_many(ids_[:2], title="new", trashed=True)
    before = sorted(map(tuple, lib.notes().collect()))
    lib.compact()
    assert sorted(map(tuple, lib.notes().collect())) == before and lib._events("note_events").count() == 5
    again = Library(spark, str(tmp_path / "lib"))
    assert again.create("next", "audio") == ids_[-1] + 1
    again.delete_folder(folder)
    assert again.get(ids_[0])["folder_id"] is None


def test_compacted_history_folds_alike(spark):
    notes = spark.createDataFrame([(0, "create", 1, {"title": "a"}, 0.0), (1, "update", 1, {"title": "b", "starred": "true"}, 1.0), (2, "create", 2, {"title": "z"}, 2.0), (3, "delete", 2, {}, 3.0)], mutations.NOTE_EVENTS)
    none = spark.createDataFrame([], mutations.FOLDER_EVENTS)
    short = mutations.compact(notes, none)
    assert short.columns == notes.columns and mutations.current_notes(short, none).collect() == mutations.current_notes(notes, none).collect()


def test_random_histories_compact_alike(spark):
    own = random.Random(2)
    notes, folders = [], []
    for seq in range(400):
        note, folder, kind = own.randrange(12), str(own.randrange(3)), own.random()
        if kind < 0.2:
            notes.append((seq, "create", note, {"title": f"t{seq}", "folder_id": folder}, float(seq)))
        elif kind < 0.3:
            notes.append((seq, "delete", note, {}, float(seq)))
        elif kind < 0.8:
            notes.append((seq, "update", note, own.choice([{"title": f"u{seq}"}, {"folder_id": folder}, {"folder_id": None}, {"trashed": str(float(seq))}, {}]), float(seq)))
        else:
            folders.append((seq, own.choice(["create", "delete"]), int(folder), "f"))
    log, later = spark.createDataFrame(notes, mutations.NOTE_EVENTS), spark.createDataFrame([*folders, (500, "delete", 1, None)], mutations.FOLDER_EVENTS)
    folder_log = spark.createDataFrame(folders, mutations.FOLDER_EVENTS)
    short = mutations.compact(log, folder_log)
    for f in (folder_log, later):
        assert sorted(map(tuple, mutations.current_notes(short, f).collect())) == sorted(map(tuple, mutations.current_notes(log, f).collect()))


def test_keywords_golden(spark):
    text = "화자 1: 예산 회의에서 예산을 확정했습니다. 그리고 회의가 길었습니다. 예산"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "학교에서는 학교에서는 나")], "id long, t string")
    two = {r["id"]: r["keywords"] for r in keywords(rows, "id", "t", 2).collect()}
    assert two == {1: ["예산", "회의"], 2: [], 3: [], 4: ["학교에서"]}
    ten = keywords(rows, "id", "t", 10).where("id = 1").first()["keywords"]
    assert "그리고" not in ten and "화자" not in ten


def test_like_folds_ascii_only_and_has_no_escape(spark):
    cases = [("É", "é", False), ("aBc", "AbC", True), ("a\\b", "a\\b", True), ("100%", "1_0%", True), ("x", "%\\%", False)]
    rows = spark.createDataFrame([(t, f"%{p}%" if "%" not in p else p, w) for t, p, w in cases], "t string, p string, w boolean")
    assert rows.where(X.like(F.col("t"), F.col("p")) != F.col("w")).count() == 0
    own, alphabet = random.Random(1), ["a", "A", "é", "É", "%", "_", "\\", "\\E", "\n", ".", "🙂", "("]
    texts = spark.createDataFrame([("".join(own.choices(alphabet, k=own.randint(0, 8))),) for _ in range(60)], "t string")
    for _ in range(25):
        p = "".join(own.choices(alphabet + ["%"] * 4, k=own.randint(0, 5)))
        both = texts.select("t", X.like(F.col("t"), p).alias("a"), X.like(F.col("t"), F.lit(p)).alias("b")).collect()
        folded = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
        want = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in folded(p)), re.S)
        assert all(r["a"] == r["b"] == bool(want.fullmatch(folded(r["t"]))) for r in both), p


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    loop = "오늘은 " + "수업을 위한 " * 30 + "수"
    assert value(X.collapse_repeats(F.lit(loop))) == "오늘은 수업을 위한 수"
    assert value(X.collapse_repeats(F.lit("네 네 좋아요"))) == "네 네 좋아요"
    assert value(X.collapse_repeats(F.lit("ab\u00a0" * 6))) == "ab"
    assert [value(X.format_duration(F.lit(x).cast("double"))) for x in (None, 0.4, 59.5, 3600.0)] == ["—", "0:00", "1:00", "1:00:00"]
    assert [value(X.format_mib(F.lit(x))) for x in (512, 1640)] == ["512 MB", "1.6 GB"]
    assert value(X.count_occurrences(F.lit("aaaa"), "aa")) == 2 and value(X.count_occurrences(F.lit("a"), "")) == 0
    assert [value(X.find_next(F.lit("abcabc"), F.lit("b"), F.lit(i))) for i in (1, 3, 6)] == [2, 5, 2]
    assert value(X.replace_one(F.lit("abc"), F.lit("b"), F.lit("XY"), F.lit(2))) == "aXYc" and value(X.replace_one(F.lit("abc"), F.lit("b"), F.lit("X"), F.lit(1))) == "abc"
    assert value(X.fill_template(F.lit("{a}-{b}"), {"a": F.lit(1), "b": F.lit(None)})) == "1-"
    assert value(X.parse_query(F.lit("?view=all&q=a+b&q=c"), "q")) == "a b" and value(X.parse_query(F.lit("q="), "q")) is None
    assert value(X.file_stem(F.lit("C:\\x\\회의.v2.WAV"))) == "회의.v2" and value(X.extension(F.lit("a.WAV"))) == ".wav"
    assert value(X.strip(F.lit("\u3000 x \u2028"))) == "x"


def test_render_golden(spark):
    def text(*parts):
        rows = [(1, i, label, t) for i, (label, t) in enumerate(parts)]
        return render(spark.createDataFrame(rows, "k int, seq int, label int, text string"), ["k"]).first()["transcript"]

    assert text((0, "안녕하세요."), (0, "반갑습니다.")) == "안녕하세요.\n\n반갑습니다."
    assert text((None, "a"), (None, "b")) == "a\n\nb"
    assert text((0, "안녕하세요."), (0, "반갑습니다."), (1, "네."), (0, "그럼 시작하죠.")) == "화자 1: 안녕하세요. 반갑습니다.\n\n화자 2: 네.\n\n화자 1: 그럼 시작하죠."


def test_sort_has_nulls_last_both_ways(spark):
    rows = spark.createDataFrame([(1, "가", None, None, 1.0), (2, "b", 5.0, "z", 2.0), (3, "a", 5.0, "가", 3.0)], "id long, title string, duration double, folder string, created double")
    order = lambda *a: ids(library.sort_notes(rows, *a))
    assert order("duration", False) == [3, 2, 1] and order("duration", True) == [3, 2, 1]
    assert order("folder", False) == [3, 2, 1] and order("title", False) == [1, 3, 2] and order("created", True) == [3, 2, 1]
    assert library.toggle_sort(("created", True), "created") == ("created", False) and library.toggle_sort(("created", True), "title") == ("title", False)


def test_bulk_and_packages(spark):
    outcomes = spark.createDataFrame([(2, "late"), (1, "first"), (0, None)], "seq int, error string")
    assert library.bulk_result(outcomes).first().asDict() == {"settled": 3, "failed": 2, "first_error": "first"}
    packages = spark.createDataFrame([(1, "B", "1", "MIT", "y"), (0, "B", "1", "BSD", "x"), (2, "a", "2", "MIT", "z")], "seq int, name string, version string, license string, place string")
    packages = packages.union(packages.where("seq = 1").withColumn("seq", F.lit(9)))
    assert [tuple(r) for r in group_packages(packages).collect()] == [("a", "2", "MIT", "z"), ("B", "1", "BSD", "x, y")]


def test_requests_and_job_slot():
    validate_transcribe({"device": "cpu", "speakers": True, "folder_id": None}, ["cpu"])
    for body in ({"device": "x"}, {"device": "cpu", "speakers": 1}, {"device": "cpu", "folder_id": True}):
        with pytest.raises(RequestError):
            validate_transcribe(body, ["cpu"])
    with pytest.raises(RequestError) as refused:
        validate_live({"device": "cpu", "source": "mic"}, ["cpu"])
    assert refused.value.code == "no_mic"
    assert [d["id"] for d in device_list(["npu"], True)] == ["npu", "cpu"]
    slot = JobSlot()
    slot.start(1)
    with pytest.raises(RequestError) as busy:
        slot.start(2)
    assert busy.value.status == 409 and busy.value.code == "busy"
    slot.release()
    slot.closing = True
    with pytest.raises(RequestError) as closing:
        slot.start(2)
    assert closing.value.code == "shutting_down"

    def run(item):
        if item["n"] == 1:
            raise ValueError
        if item["n"] == 3:
            raise RequestError(409, "busy", "busy")

    queue = [{"n": n} for n in range(5)]
    assert [i["n"] for i, _ in slot.drain(queue, run)] == [1] and [i["n"] for i in queue] == [3, 4]
