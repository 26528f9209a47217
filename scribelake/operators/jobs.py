"""Jobs: folding append-only events (job_id, seq, kind, value, ts) into the state of each job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events after which a job's result is final.
TERMINAL = ("done", "error", "cancelled")
DEFAULT_ERROR = "취소됐습니다."


def _last(kind: str | tuple[str, ...], value: Column | None = None) -> Column:
    kinds = (kind,) if isinstance(kind, str) else kind
    return F.max_by(F.col("value") if value is None else value, F.when(F.col("kind").isin(*kinds), F.col("seq")))


def fold(events: DataFrame, operation: str = "transcribe") -> DataFrame:
    """One row for each job: state, phase, stage, percent, text, saved (completed text only), duration, file, ready, step,
    size, error, code. ``value`` is text; a progress event's is its percentage, a preview's its text.

    ``finishing`` is final for phase events until a file or ready event sets the phase past it. Everything is a
    conditional maximum by sequence number, combined before the shuffle; only ``ready`` gathers, a few names for each job.
    """
    kind, seq, value = F.col("kind"), F.col("seq"), F.col("value")
    forced = kind.isin("file", "ready")
    end = F.max_by(F.struct("kind", "value"), F.when(kind.isin(*TERMINAL), seq))
    out = events.groupBy("job_id").agg(
        F.max_by(F.struct("seq", "value"), F.when(kind == "phase", seq)).alias("own"), F.max(F.when((kind == "phase") & (value == "finishing"), seq)).alias("finishing"),
        F.max_by(F.struct("seq", F.when(kind == "file", "downloading").otherwise("checking").alias("value")), F.when(forced, seq)).alias("forced"),
        F.max_by(F.when(kind == "file", F.concat(value, F.lit(" 내려받는 중"))).otherwise(value), F.when(kind.isin("stage", "file"), seq)).alias("stage"),
        _last("progress").cast("double").alias("percent"), _last(("text", "preview", "done")).alias("text"), _last("text").alias("saved"), _last("duration").cast("double").alias("duration"),
        _last("file").alias("file"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kind == "ready", F.struct("seq", "value")))), lambda x: x["value"]), ",").alias("ready"),
        _last("step").alias("step"), _last("size").alias("size"), end.alias("end"),
    )
    since = F.coalesce("forced.seq", F.lit(-1))
    phase = F.when(F.col("finishing") > since, "finishing").when(F.col("own.seq") > since, F.col("own.value")).otherwise(F.coalesce("forced.value", F.lit("loading")))
    failed = F.col("end.kind").isin("error", "cancelled")
    state = F.when(F.col("end").isNull(), "running").when(F.col("end.kind") == "done", "done").otherwise("error")
    code = F.when(F.col("end.kind") == "cancelled", "cancelled").when(failed, "setup_failed" if operation == "setup" else "failed")
    return out.select(
        "job_id", state.alias("state"), phase.alias("phase"), F.coalesce("stage", F.lit("준비 중")).alias("stage"), F.when(state == "done", 100.0).otherwise(F.coalesce("percent", F.lit(0.0))).alias("percent"),
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("saved", F.lit("")).alias("saved"), "duration", F.coalesce("file", F.lit("")).alias("file"), "ready", F.coalesce("step", F.lit("")).alias("step"), "size",
        F.when(failed, F.coalesce("end.value", F.lit(DEFAULT_ERROR))).alias("error"), code.alias("code"),
    )


def clock(events: DataFrame, now: float) -> DataFrame:
    """(job_id, recorded_seconds): from the first recording to finishing or the end, else to ``now``; 0 before it."""
    phase = lambda v: (F.col("kind") == "phase") & (F.col("value") == v)
    out = events.groupBy("job_id").agg(F.min(F.when(phase("recording"), F.col("ts"))).alias("since"), F.min(F.when(phase("finishing") | F.col("kind").isin(*TERMINAL), F.col("ts"))).alias("until"))
    seconds = F.greatest(F.lit(0.0), F.coalesce(F.col("until"), F.lit(now)) - F.col("since"))
    return out.select("job_id", F.coalesce(seconds, F.lit(0.0)).alias("recorded_seconds"))


def salvage(folded: DataFrame) -> DataFrame:
    """(job_id, transcript) that a failed job leaves: its completed text, never a preview, and only if there is any."""
    return folded.where((F.col("state") == "error") & (F.col("saved") != "")).select("job_id", F.col("saved").alias("transcript"))
