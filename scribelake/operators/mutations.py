"""Changes to notes and folders as append-only events, folded into current rows.

note_events: (seq, op, note_id, fields map<string, string>, at); op is create, update or delete. folder_events: (seq, op,
folder_id, name). Sequence numbers are unique and give the order; ids may be used again after a delete.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.functions import text as X

UPDATABLE = ("title", "transcript", "duration", "folder_id", "starred", "trashed")
_TYPES = {"title": "string", "source": "string", "audio": "string", "transcript": "string", "duration": "double", "folder_id": "long", "starred": "boolean", "trashed": "double"}
NOTE_EVENTS = "seq long, op string, note_id long, fields map<string,string>, at double"
FOLDER_EVENTS = "seq long, op string, folder_id long, name string"


def update_fields(now: float, **fields: Any) -> dict[str, str | None]:
    """An update's map: a known field or a ValueError; a truthy ``trashed`` is now, ``starred`` is a truth value."""
    if unknown := set(fields) - set(UPDATABLE):
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    if "trashed" in fields:
        fields["trashed"] = now if fields["trashed"] else None
    if "starred" in fields:
        fields["starred"] = "true" if fields["starred"] else "false"
    return {k: None if v is None else str(v) for k, v in fields.items()}


def folder_name(name: str) -> str:
    if not name.strip():
        raise ValueError("폴더 이름을 입력해 주세요.")
    return name.strip()


def _value(name: str) -> Column:
    """The field's latest value; an event that sets it to null counts."""
    has = F.map_contains_key("fields", name)
    return F.max_by(F.struct(F.element_at("fields", name).alias("v"), F.col("seq").alias("at")), F.when(has, F.col("seq"))).alias(f"f_{name}")


def current_notes(note_events: DataFrame, folder_events: DataFrame) -> DataFrame:
    """Notes as they are now.

    A note is there if its last create is later than its last delete, and what came before that create is forgotten. A
    folder that was deleted after it was set unfiles the note, though its id may be in use again. ``updated`` is the last
    create or update that set anything. Two shuffles by note id, which share a partitioning, and one by folder id.
    """
    last = lambda op: F.max(F.when(F.col("op") == op, F.col("seq")))
    lives = note_events.groupBy("note_id").agg(last("create").alias("born"), last("delete").alias("gone")).where("born is not null and (gone is null or born > gone)")
    rows = note_events.join(lives.select("note_id", "born"), "note_id").where("seq >= born and op in ('create', 'update')")
    sets = (F.col("op") == "create") | (F.size("fields") > 0)
    notes = rows.groupBy("note_id").agg(F.min_by("at", "seq").alias("created"), F.max_by("at", F.when(sets, F.col("seq"))).alias("updated"), *map(_value, _TYPES))
    field = lambda n: F.col(f"f_{n}.v").cast(_TYPES[n]).alias(n)
    notes = notes.select(F.col("note_id").alias("id"), "created", "updated", *map(field, _TYPES), F.col("f_folder_id.at").alias("filed_at"))
    deleted = folder_events.where("op = 'delete'").groupBy(F.col("folder_id").alias("folder_id")).agg(F.max("seq").alias("deleted_at"))
    notes = notes.join(deleted, "folder_id", "left").withColumn("folder_id", F.when(F.col("deleted_at").isNull() | (F.col("deleted_at") < F.col("filed_at")), F.col("folder_id")))
    return notes.select("id", F.coalesce("title", F.lit(X.DEFAULT_TITLE)).alias("title"), "created", "updated", "source", "audio", F.coalesce("transcript", F.lit("")).alias("transcript"), "duration", "folder_id", F.coalesce("starred", F.lit(False)).alias("starred"), "trashed")


def current_folders(folder_events: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("op", "name"), "seq").alias("e")
    return folder_events.groupBy("folder_id").agg(last).where("e.op = 'create'").select(F.col("folder_id").alias("id"), F.col("e.name").alias("name"))


def attach_audio(notes: DataFrame, recordings: DataFrame, now: float) -> DataFrame:
    """Update events (note_id, fields, at) for recordings (note_id, path) whose note is there and has no audio yet."""
    free = notes.where(F.col("audio").isNull()).select(F.col("id").alias("note_id"))
    fields = F.create_map(F.lit("audio"), X.audio_name(F.lit(now), F.col("path")), F.lit("source"), F.lit("audio"))
    return recordings.join(free, "note_id").select("note_id", fields.alias("fields"), F.lit(now).alias("at"))


def compact(note_events: DataFrame, folder_events: DataFrame) -> DataFrame:
    """A log of the same columns that folds to the same notes, ``updated`` included: for each a create with all its fields
    and, where anything came after its creation, one update that files it. They keep the numbers of the creation and of the
    last event, so a folder's deletion still comes after or before them as it did."""
    notes = current_notes(note_events, folder_events)
    ends = note_events.groupBy(F.col("note_id").alias("id")).agg(F.max(F.when(F.col("op") == "create", F.col("seq"))).alias("born"), F.max("seq").alias("last"))
    every = F.map_from_arrays(F.array(*map(F.lit, _TYPES)), F.array(*(F.col(c).cast("string") for c in _TYPES)))
    filed = F.create_map(F.lit("folder_id"), F.col("folder_id").cast("string"))
    event = lambda seq, op, fields, at: F.struct(F.col(seq).alias("seq"), F.lit(op).alias("op"), F.col("id").alias("note_id"), fields.alias("fields"), F.col(at).alias("at"))
    create, update = event("born", "create", every, "created"), event("last", "update", filed, "updated")
    return notes.join(ends, "id").select(F.inline(F.when(F.col("last") > F.col("born"), F.array(create, update)).otherwise(F.array(create))))


def compact_folders(folder_events: DataFrame) -> DataFrame:
    """A log of folders that folds alike, now and for notes: each folder's last event, and its last deletion."""
    whole = F.struct("seq", "op", "folder_id", "name")
    ends = folder_events.groupBy("folder_id").agg(F.max_by(whole, "seq").alias("last"), F.max_by(whole, F.when(F.col("op") == "delete", F.col("seq"))).alias("gone"))
    return ends.select(F.inline(F.array_distinct(F.array_compact(F.array("gone", "last")))))
