"""The relations of a transcript library, derived from star-schema tables so that every operator has data at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEFT_OUT_FOLDER = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` and their ``labels``; a tenth are live recordings."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left")
    created = F.lit(1.7e9) + F.col("doc_id") * 60.0
    return rows.select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"), created.alias("created"), (created + 30.0).alias("updated"),
        F.when(F.col("doc_id") % 10 == 0, "live").otherwise("audio").alias("source"), F.lit(None).cast("string").alias("audio"), F.col("text").alias("transcript"),
        (F.col("n_chars") / 10.0).alias("duration"), F.regexp_replace("source", "[^0-9]", "").try_cast("long").alias("folder_id"),
        (F.coalesce(F.col("quality"), F.lit(0)) == 1).alias("starred"), F.when(F.col("toxic") == 1, created + 3600.0).alias("trashed"),
    )


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of ``documents`` but one, so that some notes have a folder that isn't there."""
    ids = table(spark, sf_dir, "documents").select(F.regexp_replace("source", "[^0-9]", "").try_cast("long").alias("id")).distinct()
    return ids.where(F.col("id") != LEFT_OUT_FOLDER).select("id", F.concat(F.lit("folder "), F.col("id").cast("string")).alias("name"))


NOTES_SQL = f"""notes AS (SELECT d.doc_id AS id, substr(d.text, 1, 40) AS title, 1.7e9::DOUBLE + d.doc_id * 60.0::DOUBLE AS created, 1.7e9::DOUBLE + d.doc_id * 60.0::DOUBLE + 30.0::DOUBLE AS updated,
  CASE WHEN d.doc_id % 10 = 0 THEN 'live' ELSE 'audio' END AS source, d.text AS transcript, d.n_chars / 10.0::DOUBLE AS duration, regexp_replace(d.source, '[^0-9]', '', 'g')::BIGINT AS folder_id,
  coalesce(l.quality, 0) = 1 AS starred, CASE WHEN l.toxic = 1 THEN 1.7e9::DOUBLE + d.doc_id * 60.0::DOUBLE + 3600.0::DOUBLE END AS trashed
  FROM documents d LEFT JOIN labels l USING (doc_id)),
folders AS (SELECT DISTINCT regexp_replace(source, '[^0-9]', '', 'g')::BIGINT AS id, 'folder ' || regexp_replace(source, '[^0-9]', '', 'g') AS name FROM documents
  WHERE regexp_replace(source, '[^0-9]', '', 'g')::BIGINT <> {LEFT_OUT_FOLDER})"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as (conv_id, seq, label, text), labels by first appearance of a role."""
    from scribelake.operators.text import first_appearance

    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("role").alias("label"), "text")
    out = first_appearance(rows, ["conv_id"], "label", "seq")
    return out.withColumn("label", F.col("label").cast("int"))


PARTS_SQL = """firsts AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) AS first FROM conversations),
parts AS (SELECT conv_id, turn AS seq, (dense_rank() OVER (PARTITION BY conv_id ORDER BY first) - 1)::INTEGER AS label, text FROM firsts)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` of a user as the energy blocks of a recording."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), (F.col("value") * F.col("value")).alias("energy"))


BLOCKS_SQL = "blocks AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value * value AS energy FROM events)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` of a user as spans (recording_id, start, label): samples into the recording, five speakers."""
    rows = table(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 4).when(F.col("event_type") == "signup", 2).otherwise(0)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    # Spans last value x 400 samples, so some are below a second.
    start = F.coalesce(F.sum(F.floor(F.col("value") * 400)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(F.col("user_id").alias("recording_id"), start.cast("long").alias("start"), label.alias("label"), "event_id", F.floor(F.col("value") * 400).cast("long").alias("n"))


SPANS_SQL = """spans AS (SELECT user_id AS recording_id, coalesce(sum(floor(value * 400)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  CASE event_type WHEN 'click' THEN 3 WHEN 'error' THEN 1 WHEN 'view' THEN 4 WHEN 'signup' THEN 2 ELSE 0 END AS label, event_id, floor(value * 400)::BIGINT AS n FROM events)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` of a user as the events of a job, by kind."""
    kind = F.when(F.col("event_type") == "click", "text").when(F.col("event_type") == "view", "preview").when(F.col("event_type") == "signup", "phase").when(F.col("event_type") == "purchase", "progress").when(F.col("event_id") % 3 == 0, "file").when(F.col("event_id") % 3 == 1, "ready").otherwise("stage")
    phases = F.element_at(F.array(*map(F.lit, ("recording", "transcribing", "recording", "finishing"))), (F.col("event_id") % 4 + 1).cast("int"))
    value = F.when(kind == "phase", phases).when(kind == "progress", (F.col("event_id") % 101).cast("string")).otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string")))
    kind = F.when(F.col("event_id") % 97 == 96, F.element_at(F.array(*map(F.lit, ("done", "error", "cancelled"))), (F.col("event_id") % 3 + 1).cast("int"))).otherwise(kind)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"), value.alias("value"), F.unix_timestamp("ts").cast("double").alias("ts"))


JOB_EVENTS_SQL = """raw AS (SELECT user_id AS job_id, event_id AS seq, event_type, epoch(date_trunc('second', ts))::DOUBLE AS ts,
  CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'preview' WHEN 'signup' THEN 'phase' WHEN 'purchase' THEN 'progress' ELSE ['file', 'ready', 'stage'][(event_id % 3 + 1)::INTEGER] END AS k FROM events),
job_events AS (SELECT job_id, seq, ts, CASE WHEN seq % 97 = 96 THEN ['done', 'error', 'cancelled'][(seq % 3 + 1)::INTEGER] ELSE k END AS kind,
  CASE k WHEN 'phase' THEN ['recording', 'transcribing', 'recording', 'finishing'][(seq % 4 + 1)::INTEGER] WHEN 'progress' THEN (seq % 101)::VARCHAR ELSE 'v' || seq END AS value FROM raw)"""


def note_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a history of notes: each user a note id that is created, changed, deleted and used again."""
    n, kind = F.col("event_id"), F.col("event_type")
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) == 1
    op = F.when(first | (n % 11 == 0), "create").when(n % 13 == 0, "delete").otherwise("update")
    title, folder = F.concat(F.lit("t"), n.cast("string")), (n % 5).cast("string")
    both = F.create_map(F.lit("title"), title, F.lit("folder_id"), folder)
    fields = (
        F.when(op == "create", both).when(op == "delete", F.create_map().cast("map<string,string>")).when(kind == "click", F.create_map(F.lit("title"), title))
        .when(kind == "view", F.create_map(F.lit("folder_id"), folder)).when(kind == "signup", F.create_map(F.lit("folder_id"), F.lit(None).cast("string")))
        .when(kind == "purchase", F.create_map(F.lit("starred"), F.when(n % 2 == 0, "true").otherwise("false")))
        .when((kind == "error") & (n % 5 != 0), F.create_map(F.lit("trashed"), F.when(n % 2 == 0, n.cast("double").cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    )
    return table(spark, sf_dir, "events").select(n.alias("seq"), op.alias("op"), F.col("user_id").alias("note_id"), fields.alias("fields"), n.cast("double").alias("at"))


def folder_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folders; every 200th event deletes one, and the next one makes it again."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").where((n % 200 == 0) | (n % 200 == 1) | (n < 5))
    folder = F.when(n < 5, n % 5).otherwise(F.floor(n / 200) % 5)
    return rows.select(n.alias("seq"), F.when((n % 200 == 0) & (n >= 5), "delete").otherwise("create").alias("op"), folder.cast("long").alias("folder_id"), F.concat(F.lit("f"), n.cast("string")).alias("name"))
