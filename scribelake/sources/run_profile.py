"""What a run cost, by stage: time, rows, bytes and memory, from Spark's event log.

The log is a table of events in JSON, one a line, that Spark writes where ``spark.eventLog.enabled`` is set, so figures of a run
of any length are an aggregation like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.sources.sinks import write_new

#: The fields of a finished task's event that are read, as the log names them.
TASK = """`Event` string, `Stage ID` long, `Stage Attempt ID` long, `Task Info` struct<`Launch Time`: long, `Finish Time`: long, `Failed`: boolean>,
`Task Metrics` struct<`Executor Run Time`: long, `Executor CPU Time`: long, `JVM GC Time`: long, `Peak Execution Memory`: long, `Memory Bytes Spilled`: long, `Disk Bytes Spilled`: long,
  `Input Metrics`: struct<`Bytes Read`: long, `Records Read`: long>, `Output Metrics`: struct<`Bytes Written`: long, `Records Written`: long>,
  `Shuffle Read Metrics`: struct<`Remote Bytes Read`: long, `Local Bytes Read`: long, `Total Records Read`: long>, `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: long, `Shuffle Records Written`: long>>,
`Stage Info` struct<`Stage ID`: long, `Stage Attempt ID`: long, `Stage Name`: string, `RDD Info`: array<struct<`Scope`: string>>>"""
FIGURES = ("tasks", "failed", "seconds", "longest", "cpu_seconds", "gc_seconds", "peak_mb", "spilled_mb", "rows_read", "rows_written", "shuffle_rows_read", "shuffle_rows_written", "mb_read", "mb_written", "shuffle_mb_read", "shuffle_mb_written")


def stage_figures(spark: SparkSession, log: str) -> DataFrame:
    """(stage, attempt, name, operators, and ``FIGURES``) of each stage in a log, or in all logs below a folder; a stage that ran no
    task isn't there. Lines that are no JSON, as a log that was cut off ends with, are left out."""
    events = spark.read.text(log, recursiveFileLookup=True).where(F.col("value").contains('"SparkListenerTaskEnd"') | F.col("value").contains('"SparkListenerStageCompleted"'))
    events = events.select(F.from_json("value", TASK).alias("e")).select("e.*")
    m, t = "`Task Metrics`.", "`Task Info`."
    of = lambda path: F.coalesce(F.col(m + path), F.lit(0))
    wall = (F.col(t + "`Finish Time`") - F.col(t + "`Launch Time`")) / 1000
    mb, seconds = lambda c: F.round(F.sum(c) / 1e6, 3), lambda c, unit: F.round(F.sum(c) / unit, 3)
    shuffled = of("`Shuffle Read Metrics`.`Remote Bytes Read`") + of("`Shuffle Read Metrics`.`Local Bytes Read`")
    tasks = events.where("Event = 'SparkListenerTaskEnd'").groupBy(F.col("Stage ID").alias("stage"), F.col("Stage Attempt ID").alias("attempt")).agg(
        F.count("*").alias("tasks"), F.count_if(F.col(t + "`Failed`")).alias("failed"), F.round(F.sum(wall), 3).alias("seconds"), F.max(wall).alias("longest"),
        seconds(of("`Executor CPU Time`"), 1e9).alias("cpu_seconds"), seconds(of("`JVM GC Time`"), 1e3).alias("gc_seconds"), F.round(F.max(of("`Peak Execution Memory`")) / 1e6, 3).alias("peak_mb"), mb(of("`Disk Bytes Spilled`")).alias("spilled_mb"),
        F.sum(of("`Input Metrics`.`Records Read`")).alias("rows_read"), F.sum(of("`Output Metrics`.`Records Written`")).alias("rows_written"),
        F.sum(of("`Shuffle Read Metrics`.`Total Records Read`")).alias("shuffle_rows_read"), F.sum(of("`Shuffle Write Metrics`.`Shuffle Records Written`")).alias("shuffle_rows_written"),
        mb(of("`Input Metrics`.`Bytes Read`")).alias("mb_read"), mb(of("`Output Metrics`.`Bytes Written`")).alias("mb_written"), mb(shuffled).alias("shuffle_mb_read"), mb(of("`Shuffle Write Metrics`.`Shuffle Bytes Written`")).alias("shuffle_mb_written"),
    )
    scopes = F.array_sort(F.array_distinct(F.array_compact(F.transform("`Stage Info`.`RDD Info`", lambda r: F.get_json_object(r["Scope"], "$.name")))))
    names = events.where("Event = 'SparkListenerStageCompleted'").select(F.col("`Stage Info`.`Stage ID`").alias("stage"), F.col("`Stage Info`.`Stage Attempt ID`").alias("attempt"), F.col("`Stage Info`.`Stage Name`").alias("name"), F.array_join(scopes, ", ").alias("operators"))
    return tasks.join(names, ["stage", "attempt"], "left").select("stage", "attempt", "name", "operators", *FIGURES)


def write_profile(spark: SparkSession, log: str, path: str) -> None:
    """The figures of a run as a local text file, a line a stage, dearest first; stages of a run are few."""
    rows = stage_figures(spark, log).orderBy(F.desc("seconds"), "stage", "attempt").collect()
    lines = ["\t".join(("stage", "attempt", "name", "operators", *FIGURES)), *("\t".join("" if v is None else str(v) for v in r) for r in rows)]
    write_new("\n".join(lines) + "\n", path)
