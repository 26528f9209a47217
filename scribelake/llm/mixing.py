"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

A source's documents are wanted target / size times each. The whole part of that ratio is copied for certain. For the rest,
a document's inclusion odds are in proportion to the whole part of the square root of its words, at most 1 (then it is
certain), and such that the words expected are those that remain. Documents are ranked by random odds divided by inclusion
odds, and the first are taken until the source's remaining words are reached. Two more documents at most fill the gap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.llm.common import WORD, draw, draw_sql, durable

#: Up to so many sources are broadcast; more are joined over salted copies.
BROADCAST_SOURCES = 10_000
SALTS = 64
#: Rows that are alike are written one by one in runs of at most so many.
RUN = 1 << 16


def _settled(table: DataFrame, few: bool) -> DataFrame:
    """A table of a row per source, computed now: few rows are kept in the plan, more are written down.

    Few rows come back by Arrow: Python rows would be read by Python workers of another kind than those of the Arrow
    functions, which every executor would start and keep beside those.
    """
    return table.sparkSession.createDataFrame(table.toArrow(), table.schema) if few else durable(table)


def _before(rows: DataFrame, key: Column, sums: dict[str, Column], few: bool) -> DataFrame:
    """Adds for each row the sums over all rows whose key is smaller. Keys are distinct.

    Of more rows than one task should sort, each is sorted in a part between two of a thousand bounds, taken from the rows
    themselves by a hash, and the sums of the parts before are added.
    """
    running = lambda window: {n: F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n, c in sums.items()}
    if few:
        return rows.withColumns(running(Window.orderBy(key)))
    cuts = [tuple(r["k"]) for r in rows.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(1000).orderBy("k").collect()]
    bounds = F.array(*(F.struct(*map(F.lit, c)) for c in cuts))
    rows = durable(rows.withColumn("part", F.size(F.filter(bounds, lambda c: c < key))))
    parts = rows.groupBy("part").agg(*(F.sum(c).alias(f"{n}_part") for n, c in sums.items()))
    parts = parts.select("part", *(F.coalesce(F.sum(f"{n}_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{n}_parts") for n in sums))
    rows = rows.withColumns(running(Window.partitionBy("part").orderBy(key))).join(F.broadcast(parts), "part")
    return rows.withColumns({n: F.col(n) + F.col(f"{n}_parts") for n in sums}).drop("part", *(f"{n}_parts" for n in sums))


def targets(sources: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source, which should be a written table.

    Sources in code-point order, null last, get the weights in turn. Targets share all words by weight but stop at
    ``most`` times the source's own words; what is over is shared again by weight. With the caps sorted by cap / weight,
    the level that each prefix of full sources leaves to the others is highest at the solution, so no iteration is
    needed.
    """
    few = sources.count() <= BROADCAST_SOURCES
    place = lambda: (F.col("source").isNull(), F.coalesce("source", F.lit("")))
    rows = _before(sources, F.struct(*place()), {"nth": F.lit(1)}, few)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    rows = _settled(rows, few)
    total = rows.agg(F.sum(F.col("source_size").cast("double")).alias("words"), F.sum("w").alias("w")).first()
    rows = _before(rows, F.struct("ratio", *place()), {"full": F.col("cap"), "weight": F.col("w")}, few)
    rows = _settled(rows.withColumn("level", (F.lit(total["words"]) - F.col("full")) / (F.lit(total["w"]) - F.col("weight"))), few)
    level = rows.agg(F.max("level")).first()[0]
    return rows.withColumn("target", F.least("cap", F.lit(level) * F.col("w"))).select("source", "source_size", "target")


def _by_source(rows: DataFrame, table: DataFrame, count: int) -> DataFrame:
    """``table`` has one row per source. A hot source neither shuffles (few sources) nor lands in one task (many)."""
    if count <= BROADCAST_SOURCES:
        return _with(rows, F.broadcast(table.withColumnRenamed("source", "of")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "order"), F.lit(SALTS)))
    table = table.withColumnRenamed("source", "of").withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return _with(rows, table, F.col("salt") == F.col("salt_of")).drop("salt", "salt_of")


def _with(rows: DataFrame, table: DataFrame, also: Column | None = None) -> DataFrame:
    """Left join by source, where ``table`` calls it ``of``; null is a source."""
    same = F.col("source").eqNullSafe(F.col("of"))
    return rows.join(table, same if also is None else same & also, "left").drop("of")


def _order(id_: Column, mark: Column, nth: Column, seed: int) -> Column:
    """Random odds of a row, by its id, its text's digest and how many rows like it come before."""
    u = draw(F.lit(seed), id_, mark, nth)
    return u / (1 - u)


def measure(size: Column) -> Column:
    """What a document's inclusion odds are in proportion to: a long, so that sums of it are exact."""
    return F.floor(F.sqrt(size)).cast("long")


def _levels(rows: DataFrame) -> DataFrame:
    """(of, level) of each source from (source, size, rest): odds are min(1, level x measure), and the words expected are
    ``rest``. That sum rises with the level and bends where a measure reaches 1, so of the levels that each number of
    certain measures would give, the highest is right. A source has as many measures as the root of its longest text."""
    steps = rows.where("size > 0").groupBy("source", measure(F.col("size")).alias("g")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy(F.desc("g"))
    certain = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("g") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    steps = steps.select(F.col("source").alias("of"), ((F.col("rest") - certain) / open_).alias("level"))
    return steps.groupBy("of").agg(F.max("level").alias("level"))


def _ranked(rows: DataFrame, buckets: int) -> DataFrame:
    """Random odds over inclusion odds, pressed into 0..1; none for a document without words, or in a source that needs no
    part of a copy. What is certain comes before all else."""
    p = F.least(F.lit(1.0), F.col("level") * measure(F.col("size")))
    q = F.when(p >= 1, F.col("order") / (1 + F.col("order")) * 1e-15).when(p > 0, F.col("order") / (p / (1 - p)))
    return rows.withColumn("rank", F.when(F.col("odds") > 0, q / (1 + q))).withColumn("bucket", F.floor(F.col("rank") * buckets))


def _plan(base: DataFrame, weights: tuple[float, ...], most: int, buckets: int | None) -> tuple[DataFrame, int, int]:
    """For each source what decides a row's copies, how many sources there are, and into how many buckets the order is
    cut, from (id, source, size, order)."""
    sources = durable(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    counted = sources.agg(F.count("*").alias("sources"), F.sum("n").alias("rows")).first()
    count, few = counted["sources"], counted["sources"] <= BROADCAST_SOURCES
    # About as many buckets as rows in a bucket, if one source had all.
    buckets = buckets or 2 ** max(12, math.ceil(math.log2(max(1, counted["rows"] or 0)) / 2))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets(sources.drop("n"), weights=weights, most=float(most)).withColumn("whole", F.floor(share)).withColumn("odds", share - F.floor(share)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = _settled(_with(plan, _levels(_by_source(base, plan.select("source", "odds", "rest"), count).where("odds > 0"))), few)
    open_ = _ranked(_by_source(base, plan.select("source", "odds", "rest", "level"), count), buckets).where("rank is not null")

    upto = Window.partitionBy("source").orderBy("bucket")
    steps = open_.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")).withColumn("words_to", F.sum("words").over(upto))
    edge = steps.where("words_to > rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("words_to") - F.col("words")).alias("done"))).alias("e")).select("source", F.col("e.bucket").alias("edge"), F.col("e.done").alias("done")).withColumnRenamed("source", "of")
    plan = _settled(_with(plan, edge), few)

    near = _ranked(_by_source(base, plan, count).where("edge is not null"), buckets).where("bucket = edge").groupBy("source", "rank").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("done").alias("done"))
    near = near.withColumn("to", F.col("done") + F.sum("words").over(Window.partitionBy("source").orderBy("rank")))
    cut = near.where("to <= rest").groupBy("source").agg(F.max("rank").alias("cut"), F.max("to").alias("at")).withColumnRenamed("source", "of")
    plan = _with(plan, cut).withColumn("short", F.col("rest") - F.coalesce("at", "done")).withColumn("cut", F.when(F.col("edge").isNull(), 1.0).otherwise(F.coalesce("cut", F.lit(-1.0))))
    plan = _settled(plan, few)

    # What could fill a gap, by length: the first and the last of the order. First the longest that fits, then what brings the
    # source nearest.
    later = _ranked(_by_source(base, plan, count).where((F.col("size") < 2 * F.col("short")) & F.col("edge").isNotNull()), buckets).where("bucket >= edge and rank > cut")
    later = later.groupBy("source", "size").agg(F.first("short").alias("short"), F.min("rank").alias("rank"), F.max("rank").alias("spare"))
    first = later.where("size <= short").groupBy("source").agg(F.max(F.struct("size", "rank")).alias("f")).select(F.col("source").alias("of"), F.col("f.size").alias("filled"), F.col("f.rank").alias("first_fill"))
    left = F.col("short") - F.coalesce("filled", F.lit(0))
    rank = F.when(F.col("filled").isNull() | (F.col("size") != F.col("filled")), F.col("rank")).when(F.col("spare") > F.col("rank"), F.col("spare"))
    second = _with(later, first).select("source", "size", left.alias("left"), rank.alias("rank")).where((F.col("size") <= 2 * F.col("left") - 1e-9) & F.col("rank").isNotNull())
    second = second.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("miss"), "rank")).alias("s")).select(F.col("source").alias("of"), F.col("s.rank").alias("fill"))
    plan = _with(_with(plan, first), second).select("source", "source_size", "target", "whole", "odds", "level", "cut", "edge", "first_fill", "fill")
    return _settled(plan, few), count, buckets


def _copied(rows: DataFrame, plan: DataFrame, count: int, buckets: int) -> DataFrame:
    """Adds ``copies`` to rows that have id, source, size and order; nothing but the plan is joined."""
    rows = _ranked(_by_source(rows, plan, count), buckets)
    extra = F.col("rank").isNotNull() & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")) | (F.col("rank") <= F.col("cut")) | F.col("rank").isin(F.coalesce("first_fill", F.lit(-1.0)), F.coalesce("fill", F.lit(-1.0))))
    return rows.withColumn("copies", (F.coalesce("whole", F.lit(0)) + F.when(extra, 1).otherwise(0)).cast("int"))


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _marked(docs: DataFrame, id_col: str, text_col: str, source_col: str, *also: Column) -> DataFrame:
    mark = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), mark.alias("mark"), *also)


def _one_by_one(rows: DataFrame, first: Column | int = 1) -> DataFrame:
    """Each row ``n`` times, numbered in ``nth`` from ``first``, in runs, as there may be very many."""
    rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / RUN))))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)))
    return rows.withColumn("nth", F.col("nth") + first).drop("run", "n")


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, source, size, mark, nth, order), one row per row. Rows alike in id, source and text are counted together before the
    shuffle and numbered, so each has a draw of its own whoever is which."""
    rows = _marked(docs, id_col, text_col, source_col).groupBy("id", "source", "size", "mark").agg(F.count("*").alias("n"))
    rows = _one_by_one(rows)
    return durable(rows.withColumn("order", _order(F.col("id"), F.col("mark"), F.col("nth"), seed)))


def _numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, id, source, size, mark, nth) where some rows are alike in id, source and text: numbered among those.

    Rows equal in every column are first counted together. Numbers go by parts of such a group and, in a part, by rows,
    so that no task has a whole group.
    """
    whole = F.md5(F.to_json(F.struct(*docs.columns)))
    rows = _marked(docs, id_col, text_col, source_col, F.struct(*docs.columns).alias("row"), whole.alias("whole"))
    rows = rows.groupBy("whole").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("row", "id", "source", "size", "mark")))
    rows = durable(rows.withColumn("key", F.md5(F.to_json(F.struct("id", "source", "mark")))).withColumn("salt", F.pmod(F.xxhash64("whole"), F.lit(1024))))
    parts = rows.groupBy("key", "salt").agg(F.sum("n").alias("held"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("held").over(earlier(Window.partitionBy("key").orderBy("salt"))), F.lit(0))).drop("held")
    rows = rows.join(parts, ["key", "salt"]).withColumn("first", F.col("before") + 1 + F.coalesce(F.sum("n").over(earlier(Window.partitionBy("key", "salt").orderBy("whole"))), F.lit(0)))
    return _one_by_one(rows, F.col("first")).select("row", "id", "source", "size", "mark", "nth")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, seed: int = 8, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size, source, source_size, target, copies, taken.

    ``taken`` is copies x size, and copies are at most ``most``. The Pareto order of a source is never sorted in one
    task: words are summed by ``buckets`` of the order (by default about the root of the rows), and only the bucket in
    which the target falls is looked at row by row. Where the next in the order is too long, the gap is filled outside the
    order: with the longest unselected document that fits, then with the one that brings the source nearest to its target.
    So the documents that fill, two a source at most, are chosen by their length.

    A null text has size 0; a null source is a source of its own. Documents of size 0 come in whole copies only, as they
    have no odds. Very long texts are counted whole, and where they are certain come first.
    Rows with equal ids (nulls among them) have draws of their own, by text and, of equal ones, one by one. A source without
    words has target 0. An empty table gives an empty result; extra columns are ignored. Reruns agree: draws depend on id,
    text and seed alone.
    """
    base = _base(docs, id_col, text_col, source_col, seed)
    rows = _copied(base, *_plan(base, weights, most, buckets))
    return rows.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_by_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, seed: int = 8, buckets: int | None = None) -> DataFrame:
    """``docs`` with each row as often as ``mix_sources`` takes it; columns are as they were. Texts aren't shuffled, unless rows
    are alike in id, source and text. An empty table stays empty."""
    base = _base(docs, id_col, text_col, source_col, seed)
    plan = _plan(base, weights, most, buckets)
    if base.where("nth > 1").isEmpty():
        rows = _marked(docs, id_col, text_col, source_col, F.struct(*docs.columns).alias("row")).withColumn("nth", F.lit(1).cast("long"))
    else:
        rows = _numbered(docs, id_col, text_col, source_col)
    rows = _copied(rows.withColumn("order", _order(F.col("id"), F.col("mark"), F.col("nth"), seed)), *plan)
    # A filter doesn't move below a column that isn't deterministic: there it would count a text's words for each time its
    # condition needs their number.
    rows = rows.withColumn("at", F.monotonically_increasing_id()).where("copies > 0 and at >= 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_sql(weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, seed: int = 8, documents: str = "documents") -> str:
    """The whole of ``mix_sources`` over table ``documents`` in DuckDB: same draws, same arithmetic, plain windows."""
    u = draw_sql(f"'{seed}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || mark || '|' || nth")
    case = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % %d %s END".replace("%d", str(len(weights))).replace("%s", " ".join(f"WHEN {i} THEN {w!r}::DOUBLE" for i, w in enumerate(weights)))
    return f"""
WITH marked AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS mark FROM {documents}),
alike AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, mark) AS nth FROM marked),
base AS (SELECT doc_id, source, size, {u} AS u FROM alike),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, {case} AS w, {float(most)!r}::DOUBLE * source_size AS cap FROM sums),
levels AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0.0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0::DOUBLE)) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM levels),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS share FROM targets),
plan2 AS (SELECT *, floor(share) AS whole, share - floor(share) AS odds, target - floor(share) * source_size AS rest FROM plan),
sized AS (SELECT b.doc_id, b.size, u, floor(sqrt(b.size))::BIGINT AS g, p.* FROM base b JOIN plan2 p ON b.source IS NOT DISTINCT FROM p.source),
steps AS (SELECT source, g, sum(size) AS words, any_value(rest) AS rest FROM sized WHERE odds > 0 AND size > 0 GROUP BY source, g),
levels2 AS (SELECT source, (rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / sum(g * words) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM steps),
level_of AS (SELECT source, max(level) AS level FROM levels2 GROUP BY source),
odds AS (SELECT s.*, least(1.0::DOUBLE, l.level * g) AS p FROM sized s LEFT JOIN level_of l ON s.source IS NOT DISTINCT FROM l.source),
over AS (SELECT *, CASE WHEN odds > 0 THEN CASE WHEN p >= 1 THEN (u / (1 - u)) / (1 + u / (1 - u)) * 1e-15::DOUBLE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END END AS q FROM odds),
ranked AS (SELECT *, q / (1 + q) AS rank FROM over),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank RANGE UNBOUNDED PRECEDING) AS upto FROM ranked),
short AS (SELECT source, any_value(rest) - coalesce(max(CASE WHEN upto <= rest THEN upto END), 0) AS short FROM run WHERE rank IS NOT NULL GROUP BY source HAVING max(upto) > any_value(rest)),
later AS (SELECT r.source, r.size, min(rank) AS rank, max(rank) AS spare, any_value(s.short) AS short FROM run r JOIN short s ON r.source IS NOT DISTINCT FROM s.source WHERE rank IS NOT NULL AND upto > rest GROUP BY r.source, r.size),
one AS (SELECT source, arg_max(rank, size) AS fill, max(size) AS words FROM later WHERE size <= short GROUP BY source),
left_ AS (SELECT l.source, l.size, CASE WHEN o.fill IS NULL OR l.size <> o.words THEN l.rank WHEN l.spare > l.rank THEN l.spare END AS rank, l.short - coalesce(o.words, 0) AS short FROM later l LEFT JOIN one o ON l.source IS NOT DISTINCT FROM o.source),
two AS (SELECT source, arg_min(rank, (abs(size - short), rank)) AS fill FROM left_ WHERE size <= 2 * short - 1e-9 AND rank IS NOT NULL GROUP BY source),
fill AS (SELECT s.source, o.fill AS one, t.fill AS two FROM short s LEFT JOIN one o ON s.source IS NOT DISTINCT FROM o.source LEFT JOIN two t ON s.source IS NOT DISTINCT FROM t.source)
SELECT r.doc_id, r.size, r.source, r.source_size, r.target, (whole + CASE WHEN rank IS NOT NULL AND (upto <= rest OR rank = f.one OR rank = f.two) THEN 1 ELSE 0 END)::INTEGER AS copies,
  (r.size * (whole + CASE WHEN rank IS NOT NULL AND (upto <= rest OR rank = f.one OR rank = f.two) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run r LEFT JOIN fill f ON r.source IS NOT DISTINCT FROM f.source"""
