import numpy as np
import pytest

from scribelake.operators import models, text
from scribelake.operators.text import keywords
from scribelake.sources import sinks


def test_registry_and_masks():
    registry = models.Registry()
    registry.add("cpu", lambda: "engine")
    assert registry.make("cpu") == "engine"
    with pytest.raises(ValueError):
        registry.make("npu")
    masked = models.mask_logits(np.zeros(6), 4, [1], True, [2])
    assert np.isneginf(masked).tolist() == [False, True, True, False, False, True]
    assert np.isneginf(models.mask_logits(np.zeros(6), 4, [1], False, [2])).tolist() == [False, True, False, False, False, True]


def test_final_write_and_autosave():
    calls = []

    def update(note_id, **fields):
        calls.append(fields)
        if "duration" in fields:
            raise OSError("no")

    assert models.finish_write(update, 1, "text", 2.0) is None and calls == [{"transcript": "text", "duration": 2.0}, {"transcript": "text"}]
    assert models.finish_write(lambda *a, **f: 1 / 0, 1, "text", None) == "division by zero"
    assert models.changed_fields({"title": "a", "transcript": "x"}, {"title": "b", "transcript": "y"}, True) == {"title": "b"}


def test_table_function_like_the_operator(spark):
    rows = spark.createDataFrame([(1, "예산 회의에서 예산을 확정했습니다. 그리고 budget Budget budget"), (2, "")], "id long, t string")
    spark.udtf.register("keywords", models.Keywords)
    rows.createOrReplaceTempView("texts")
    got = spark.sql("select id, keyword from texts, lateral keywords(t, 3) order by id, rank").collect()
    assert [r["keyword"] for r in got if r["id"] == 1] == keywords(rows, "id", "t", 3).where("id = 1").first()["keywords"]


def test_embedding_windows(spark):
    windows = spark.createDataFrame([("a", 0, np.arange(160, dtype=float).tolist())], "rec string, window long, features array<double>")
    v = models.embed_windows(windows, lambda: lambda f: f.sum(axis=1)[:4] + [3, 0, 4, 0], "rec").first()["v"]
    assert abs(np.linalg.norm(v) - 1) < 1e-9


def test_text_sinks(spark, tmp_path):
    path = str(tmp_path / "a.txt")
    sinks.export_txt("본문", path)
    assert open(path, "rb").read() == b"\xef\xbb\xbf" + "본문".encode()
    with pytest.raises(FileExistsError):
        sinks.write_new("x", path)
    with pytest.raises(ValueError):
        sinks.export_txt("x", str(tmp_path / "a.md"))
    notes = spark.createDataFrame([(1, "one"), (2, "two")], "id long, transcript string")
    sinks.export_many(notes, str(tmp_path / "all"))
    back = spark.read.text(str(tmp_path / "all")).collect()
    assert {(r["id"], r["value"].lstrip("\ufeff")) for r in back} == {(1, "one"), (2, "two")}
    packages = spark.createDataFrame([("n", "1", "MIT", "x, y")], "name string, version string, license string, places string")
    assert sinks.notices(packages).first()["value"] == "| n | 1 | MIT | x, y |"
    texts = spark.createDataFrame([("b", "MIT text "), ("a", "MIT text"), ("c", "other")], "owner string, text string")
    assert {r["first_owner"]: r["value"] for r in sinks.notice_blocks(texts).collect()} == {"a": "### a, b\n\n```\nMIT text\n```", "c": "### c\n\n```\nother\n```"}
    sinks.profile(texts.where("owner = 'a'"), str(tmp_path / "plan.txt"))
    assert "== Physical Plan ==" in (tmp_path / "plan.txt").read_text(encoding="utf-8-sig")


def test_assets_are_verified(spark):
    wanted = spark.createDataFrame([("a", 3, None), ("b", 4, None), ("c", None, "0"), ("d", 3, None), ("e", 3, "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD")], "path string, size long, sha256 string")
    files = spark.createDataFrame([(p, 3, b"abc") for p in "abce"], "path string, length long, content binary")
    assert {r["path"]: r["state"] for r in text.verify_assets(wanted, files).collect()} == {"a": "ok", "b": "size", "c": "digest", "d": "missing", "e": "ok"}
