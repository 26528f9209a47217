"""Text analytics: keywords, paragraphs by speaker, grouping by content."""

from __future__ import annotations

import re
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.functions import text as X


_find = re.compile(X.WORD).findall
_strip = partial(re.compile(f"(?:{'|'.join(X.PARTICLES)})$").sub, "")
_STOPWORDS, _ENDINGS = frozenset(X.STOPWORDS), tuple(X.ENDINGS)


def top_stems(text: str | None, limit: int) -> list[tuple[str, int]]:
    """(stem, count) of the most frequent content stems, ties by first occurrence; Words of over two
    letters lose one particle, the longest that fits; neither short stems, stopwords nor inflected endings count."""
    words = _find(text or "")
    if any(w[-1] >= "가" for w in words):
        stems = (_strip(w) if len(w) > 2 and w[-1] >= "가" else w for w in words)
        words = [s for s in stems if len(s) >= 2 and s not in _STOPWORDS and not s.endswith(_ENDINGS)]
    return Counter(words).most_common(limit)


def keywords_of(text_col: str, limit: int = 3) -> Column:
    """The stems of ``top_stems`` as an array; none for an empty or null text.

    Words never leave their row: nothing is shuffled, and the size of a task doesn't depend on how common a word is. An
    Arrow batch with a hash count is measured at a tenth of the time of sorted arrays in built-in functions, and of
    exploding words and grouping them by row.
    """

    @F.arrow_udf("array<string>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([[s for s, _ in top_stems(t, limit)] for t in texts.to_pylist()], pa.list_(pa.string()))

    return of(F.col(text_col))


def keywords(rows: DataFrame, id_col: str, text_col: str, limit: int = 3) -> DataFrame:
    """(id, keywords) of each text."""
    return rows.select(F.col(id_col).alias("id"), keywords_of(text_col, limit).alias("keywords"))


def render(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, transcript) from parts (keys, seq, label or null, text).

    With two labels or more, runs of one label are one paragraph that names the speaker; else each part is a paragraph.
    """
    order = Window.partitionBy(*keys).orderBy("seq")
    rows = parts.withColumn("starts", F.when((F.row_number().over(order) > 1) & F.lag("label").over(order).eqNullSafe(F.col("label")), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("starts").over(order))
    labels = parts.groupBy(*keys).agg(F.count_distinct("label").alias("speakers"))
    rows = rows.join(labels, keys).withColumn("run", F.when(F.col("speakers") < 2, F.col("seq")).otherwise(F.col("run")))
    ordered = lambda value, by: F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda x: x[value])
    runs = rows.groupBy(*keys, "run").agg(F.first("speakers").alias("speakers"), F.first("label").alias("label"), F.array_join(ordered("text", "seq"), " ").alias("text"))
    named = F.when(F.col("speakers") < 2, F.col("text")).otherwise(F.concat(F.lit("화자 "), F.coalesce((F.col("label") + 1).cast("string"), F.lit("?")), F.lit(": "), F.col("text")))
    return runs.withColumn("text", named).groupBy(*keys).agg(F.array_join(ordered("text", "run"), "\n\n").alias("transcript"))


def first_appearance(rows: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """Replaces labels by 0, 1, ... in the order in which they first come."""
    first = F.min(order).over(Window.partitionBy(*keys, label))
    return rows.withColumn("__first", first).withColumn(label, F.dense_rank().over(Window.partitionBy(*keys).orderBy("__first")) - 1).drop("__first")


def group_packages(rows: DataFrame) -> DataFrame:
    """(name, version, license, places) of rows (seq, name, version, license, place): first license, distinct places as they
    first came. Repeats are combined before the shuffle, so what is gathered are a package's places, not its rows."""
    each = rows.groupBy("name", "version", "place").agg(F.min("seq").alias("seq"), F.min_by("license", "seq").alias("license"))
    places = F.transform(F.array_sort(F.collect_list(F.struct("seq", "place"))), lambda x: x["place"])
    return each.groupBy("name", "version").agg(F.min_by("license", "seq").alias("license"), F.array_join(places, ", ").alias("places")).orderBy(F.lower("name"), "name", "version")


def _digest(text_col: str) -> Column:
    return F.sha2(X.strip(F.coalesce(F.col(text_col), F.lit(""))), 256)


def group_by_content(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sha256, copies, first_owner) of stripped texts. Only digests are shuffled; counts and the first owner combine
    before it."""
    return rows.select(_digest(text_col).alias("sha256"), F.col(id_col).alias("owner")).groupBy("sha256").agg(F.count("*").alias("copies"), F.min("owner").alias("first_owner")).orderBy("first_owner")


def content_owners(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(first_owner, owner, sha256, copies): the owners of each content as rows, so that one content may have any number.
    Digests are joined to their groups; a frequent one is a skewed join that adaptive execution splits."""
    own = rows.select(_digest(text_col).alias("sha256"), F.col(id_col).alias("owner"))
    groups = own.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("owner").alias("first_owner"))
    return own.join(groups, "sha256").select("first_owner", "owner", "sha256", "copies")


def first_with_phrase(rows: DataFrame, phrases: dict[str, str], id_col: str, text_col: str) -> DataFrame:
    """(name, example): the first id whose text has the phrase, or ``?``. One pass over the texts, one row out of each task."""
    found = [F.min(F.when(F.contains(F.col(text_col), F.lit(p)), F.col(id_col))).cast("string").alias(f"c{i}") for i, p in enumerate(phrases.values())]
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(F.col(f"c{i}"), F.lit("?")).alias("example")) for i, n in enumerate(phrases)))
    return rows.agg(*found).select(F.inline(pairs))


def verify_digests(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, ok) for each manifest row (path, sha256), from files (path, content); a missing file isn't ok."""
    have = files.select("path", F.sha2("content", 256).alias("have"))
    return manifest.join(have, "path", "left").select("path", F.coalesce(F.col("have") == F.col("sha256"), F.lit(False)).alias("ok"))


def verify_assets(required: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state) of required assets (path, size or null, sha256 or null): missing, size, digest or ok, from files (path,
    length, content) as Spark's binary source reads them. All is ready if nothing is left but ok."""
    have = files.select("path", "length", F.sha2("content", 256).alias("have"))
    rows = required.join(have, "path", "left")
    wrong_size, wrong_digest = F.col("length") != F.col("size"), F.col("have") != F.lower("sha256")
    state = F.when(F.col("have").isNull(), "missing").when(F.coalesce(wrong_size, F.lit(False)), "size").when(F.coalesce(wrong_digest, F.lit(False)), "digest").otherwise("ok")
    return rows.select("path", state.alias("state"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that has the highest sequence number."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def changed(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value isn't that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__before", before).where(~F.col("__before").eqNullSafe(F.col(value))).drop("__before")
