"""The transcript library: views, search, joins and sorting of notes. Everything is one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.functions import text as X
from scribelake.operators.text import keywords_of

NOTES = T.StructType(
    [
        T.StructField("id", T.LongType(), False), T.StructField("title", T.StringType(), False), T.StructField("created", T.DoubleType(), False), T.StructField("updated", T.DoubleType(), False),
        T.StructField("source", T.StringType(), False), T.StructField("audio", T.StringType()), T.StructField("transcript", T.StringType(), False), T.StructField("duration", T.DoubleType()),
        T.StructField("folder_id", T.LongType()), T.StructField("starred", T.BooleanType(), False), T.StructField("trashed", T.DoubleType()),
    ]
)
FOLDERS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), False)])
#: More folders than this are joined by shuffle; up to it, by broadcast.
BROADCAST_FOLDERS = 100_000
SORT_KEYS = ("title", "duration", "folder", "created")
LISTED = ("id", "title", "created", "updated", "source", "duration", "starred", "trashed", "folder_id", "folder", "transcript")


def in_view(view: str) -> Column:
    """The filter of a view: all, starred, live, trash or folder:<id>; anything else is a ValueError."""
    live = F.col("trashed").isNull()
    if view == "trash":
        return ~live
    if view == "all":
        return live
    if view == "starred":
        return live & F.col("starred")
    if view == "live":
        return live & (F.col("source") == "live")
    if view.startswith("folder:"):
        return live & (F.col("folder_id") == int(view.removeprefix("folder:")))
    raise ValueError(f"unknown view: {view}")


def matches(query: str) -> Column:
    """Title or transcript contains the query, which may have wildcards; a blank query matches everything."""
    q = query.strip()
    return X.like(F.col("title"), f"%{q}%") | X.like(F.col("transcript"), f"%{q}%") if q else F.lit(True)


def with_folder(notes: DataFrame, folders: DataFrame) -> DataFrame:
    """Left join of the folder's name; the folder table is broadcast only after its size has been looked at."""
    names = folders.select(F.col("id").alias("folder_id"), F.col("name").alias("folder"))
    few = names.limit(BROADCAST_FOLDERS + 1).count() <= BROADCAST_FOLDERS
    return notes.join(F.broadcast(names) if few else names, "folder_id", "left")


def list_notes(notes: DataFrame, folders: DataFrame, view: str = "all", query: str = "") -> DataFrame:
    """A view, newest first. Filters are below the join, and unread columns are pruned from the scan."""
    rows = notes.where(in_view(view)).where(matches(query))
    return with_folder(rows, folders).select(*LISTED).orderBy(F.desc("created"), F.desc("id"))


def list_with_keywords(notes: DataFrame, folders: DataFrame, view: str = "all", query: str = "", limit: int = 3) -> DataFrame:
    """The main screen: a listing with keywords in place of transcripts.

    The order samples its input before it sorts. So that texts are searched and counted once, their narrow rows are
    shuffled first, and both passes of the order read that shuffle.
    """
    rows = notes.where(in_view(view)).where(matches(query)).withColumn("keywords", keywords_of("transcript", limit)).drop("transcript").repartition("id")
    return with_folder(rows, folders).select(*[c for c in LISTED if c != "transcript"], "keywords").orderBy(F.desc("created"), F.desc("id"))


def sort_columns(key: str = "created", descending: bool = True) -> list[Column]:
    """A listing's order: by a column, nulls last either way; strings in Korean collation; ties newest first."""
    if key not in SORT_KEYS:
        raise ValueError(f"unknown sort key: {key}")
    column = F.col(key) if key in ("duration", "created") else F.collate(F.col(key), "ko")
    first = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return [first, F.desc("created"), F.desc("id")]


def sort_notes(listed: DataFrame, key: str = "created", descending: bool = True) -> DataFrame:
    return listed.orderBy(*sort_columns(key, descending))


def toggle_sort(current: tuple[str, bool], key: str) -> tuple[str, bool]:
    """(key, descending) after a click on a column: the same key flips, a new one starts ascending."""
    return (key, not current[1]) if key == current[0] else (key, False)


def checked_folder(notes: DataFrame, folders: DataFrame) -> DataFrame:
    """Notes whose folder doesn't exist become unfiled."""
    known = folders.select(F.col("id").alias("known"))
    rows = notes.join(known, notes["folder_id"] == known["known"], "left")
    return rows.withColumn("folder_id", F.when(F.col("known").isNotNull(), F.col("folder_id"))).drop("known")


def without_folders(notes: DataFrame, deleted: DataFrame) -> DataFrame:
    """After folders (column ``id``) are deleted, their notes are unfiled; ``updated`` stays."""
    gone = deleted.select(F.col("id").alias("gone")).distinct()
    rows = notes.join(gone, notes["folder_id"] == gone["gone"], "left")
    return rows.withColumn("folder_id", F.when(F.col("gone").isNull(), F.col("folder_id"))).drop("gone")


def interrupted(notes: DataFrame, running_note: int | None) -> DataFrame:
    """Adds whether a live note has no running job."""
    running = F.col("id") == running_note if running_note is not None else F.lit(False)
    return notes.withColumn("interrupted", (F.col("source") == "live") & ~running)


def live_count(notes: DataFrame) -> DataFrame:
    return notes.where(in_view("live")).agg(F.count("*").alias("live"))


def star_target(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """What a star click sets on the chosen notes: false only if there are any and all have a star."""
    return notes.join(ids, "id", "left_semi").agg((~F.coalesce(F.bool_and("starred"), F.lit(False))).alias("target"))


def missing(required: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    return required.join(present, key, "left_anti")


def bulk_result(outcomes: DataFrame) -> DataFrame:
    """Of (seq, error): how many there were, how many failed and the first failure."""
    failed = F.col("error").isNotNull()
    return outcomes.agg(F.count("*").alias("settled"), F.count_if(failed).alias("failed"), F.min_by("error", F.when(failed, F.col("seq"))).alias("first_error"))
