"""Figures of a run from its event log."""

import json
import subprocess
import sys

from scribelake.sources.run_profile import FIGURES, stage_figures, write_profile

RUN = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", sys.argv[1]).config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "false").getOrCreate()
spark.range(0, 50000, 1, 4).select((F.col("id") % 1000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")).write.parquet(sys.argv[2])
spark.read.parquet(sys.argv[2]).groupBy("k").agg(F.count("*").alias("n")).write.parquet(sys.argv[2] + "-grouped")
spark.stop()
"""


def test_stages_of_a_run(spark, tmp_path):
    (tmp_path / "log").mkdir()
    subprocess.run([sys.executable, "-c", RUN, str(tmp_path / "log"), str(tmp_path / "rows")], check=True, timeout=240, capture_output=True)
    rows = stage_figures(spark, str(tmp_path / "log")).collect()
    assert all(r["tasks"] > 0 and r["failed"] == 0 and r["seconds"] >= r["longest"] > 0 and r["cpu_seconds"] > 0 for r in rows)
    wrote = [r for r in rows if r["rows_written"]]
    assert sorted(r["rows_written"] for r in wrote) == [1000, 50_000] and all(r["mb_written"] > 0 for r in wrote)
    (read,) = [r for r in rows if r["rows_read"] == 50_000 and r["shuffle_rows_written"]]
    (last,) = [r for r in rows if r["shuffle_rows_read"]]
    assert last["shuffle_rows_read"] == read["shuffle_rows_written"] and last["tasks"] == 3 and last["peak_mb"] > 0
    assert abs(last["shuffle_mb_read"] - read["shuffle_mb_written"]) < 0.01 and "Exchange" in read["operators"]
    write_profile(spark, str(tmp_path / "log"), str(tmp_path / "profile.txt"))
    head, *lines = (tmp_path / "profile.txt").read_text(encoding="utf-8-sig").splitlines()
    assert head.split("\t")[4:] == list(FIGURES) and len(lines) == len(rows)
    seconds = [float(x.split("\t")[4 + FIGURES.index("seconds")]) for x in lines]
    assert seconds == sorted(seconds, reverse=True)


def test_a_log_that_was_cut_off(spark, tmp_path):
    task = {"Event": "SparkListenerTaskEnd", "Stage ID": 7, "Stage Attempt ID": 1, "Task Info": {"Launch Time": 1000, "Finish Time": 3500, "Failed": True}}
    (tmp_path / "log").write_text("\n".join(['{"Event":"SparkListenerApplicationStart"}', json.dumps(task), json.dumps(task)[:90]]))
    (r,) = stage_figures(spark, str(tmp_path / "log")).collect()
    assert (r["stage"], r["attempt"], r["tasks"], r["failed"], r["seconds"], r["rows_read"], r["name"]) == (7, 1, 1, 1, 2.5, 0, None)
