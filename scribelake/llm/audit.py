"""How filters interact: what each removes in every order, from counts on the edges of the lattice of applied subsets.

A document's failures are a set of filters. It contributes to each of the 80 edges (subset already applied, next filter): it
is removed there, redundant there, kept there or gone before. Documents are first counted by their failures, so a part's
whole table is at most 32 rows; the edges are counted once and joined to the steps of all orders, which are paths through
the lattice.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.llm.common import WORD, durable

FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")


def failures(text: Column) -> dict[str, Column]:
    """The conditions that look at a text alone; E looks at the whole table."""
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), 0))
    distinct = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), 0)))
    return {
        "A": words < 200,
        "B": distinct * 100 < words * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def edges(spark: SparkSession) -> DataFrame:
    """(before, filter, bit): the 80 edges. A subset is a number with a bit for each filter."""
    rows = [(s, f, 1 << i) for i, f in enumerate(FILTERS) for s in range(1 << len(FILTERS)) if not s >> i & 1]
    return spark.createDataFrame(rows, "before int, filter string, bit int")


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, before, filter): the 600 steps of all 120 orders."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    rows = [("".join(p), k + 1, sum(bit[f] for f in p[:k]), p[k]) for p in permutations(FILTERS) for k in range(len(p))]
    return spark.createDataFrame(rows, "filter_order string, step int, before int, filter string")


def failure_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, fails, n, good, toxic): documents by the set of filters that they fail, and how many are labelled good or toxic.

    Rows alike in id, part and text are first counted together, so neither an id nor a text makes a hot key: the group of a
    text is only reduced to its smallest id, and both joins are by id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in failures(F.col("text")).items()), F.lit(0))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    base = base.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("own"))
    base = durable(base.groupBy("id", "part", "digest", "own").agg(F.count("*").alias("n")))

    # A row fails E unless it has the smallest id of its text. Null ids are neither smaller nor larger than any.
    first = base.where("id is not null").groupBy("digest").agg(F.min("id").alias("first")).select(F.col("first").alias("id"), F.col("digest").alias("of"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    known = base.where("id is not null").join(first, (base["id"] == first["id"]) & (base["digest"] == first["of"]), "left").select(base["id"], "part", "own", "n", F.col("of").isNull().alias("copy"))
    known = known.join(marks, "id", "left").select("part", "own", "n", "copy", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("is_good", "is_toxic")))
    other = base.where("id is null").select("part", "own", "n", *(F.lit(False).alias(c) for c in ("copy", "is_good", "is_toxic")))
    fails = F.col("own") + F.when(F.col("copy"), 1 << FILTERS.index("E")).otherwise(0)
    rows = known.unionByName(other).groupBy("part", fails.cast("int").alias("fails"))
    return rows.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def edge_counts(counts: DataFrame) -> DataFrame:
    """(part, before, filter, bit and ``COUNTS``): every part's 80 edges, zeros included, from ``failure_counts``.

    All edges of a part's at most 32 rows are made, not all pairs of documents.
    """
    spark = counts.sparkSession
    every = F.array(*(F.struct(F.lit(r["before"]).alias("before"), F.lit(r["filter"]).alias("filter"), F.lit(r["bit"]).alias("bit")) for r in edges(spark).collect()))
    met = counts.select("*", F.explode(every).alias("e")).select("*", "e.before", "e.filter", "e.bit")
    earlier, now = F.col("fails").bitwiseAND(F.col("before")) != 0, F.col("fails").bitwiseAND(F.col("bit")) != 0
    total = lambda when, what: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    return met.groupBy("part", "before", "filter", "bit").agg(
        total(~earlier & ~now, "n").alias("kept"), total(~earlier & now, "n").alias("removed"), total(earlier & now, "n").alias("redundant"), total(~earlier & now, "good").alias("good_lost"), total(~earlier & now, "toxic").alias("toxic_lost")
    )


def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    A step is an edge of the lattice, from the filters before it by its own filter. ``unique_fails`` is what the edge from
    all other filters removes. ``shapley`` sums what a filter removes over all orders: each edge counts as often as orders
    pass it.

    A null text is empty, a null part is the part ``''``; so is an empty one. Every whole text is looked at, very long ones too. Rows with
    equal ids and texts count each and are no copies of one another; nor is a row whose id is null, and none is a copy of it. Labels that
    are null or not there mark nothing; of repeated labels any 1 counts. An empty table has no parts and gives an empty
    result; extra columns are ignored.
    """
    counted = durable(edge_counts(failure_counts(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col)))
    others = len(FILTERS) - 1
    passes = F.element_at(F.array(*(F.lit(factorial(k) * factorial(others - k)) for k in range(others + 1))), F.bit_count("before") + 1)
    whole = (1 << len(FILTERS)) - 1
    by_filter = counted.groupBy("part", "filter").agg(F.sum(F.col("removed") * passes).cast("long").alias("shapley"), F.sum(F.when(F.col("before") + F.col("bit") == whole, F.col("removed")).otherwise(0)).cast("long").alias("unique_fails"))
    rows = counted.join(by_filter, ["part", "filter"]).join(F.broadcast(steps(docs.sparkSession)), ["before", "filter"])
    return rows.select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_sql(documents: str = "documents", labels: str = "labels") -> str:
    """The whole of ``audit_filters`` in DuckDB, step by step over all orders instead of over the lattice."""
    words = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM {documents}),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
marks AS (SELECT doc_id, coalesce(max(quality = 1), FALSE) AS good, coalesce(max(toxic = 1), FALSE) AS toxic FROM {labels} WHERE doc_id IS NOT NULL GROUP BY doc_id),
words AS (SELECT doc_id, part, text, len({words}) AS n, len(list_distinct({words})) AS d FROM texts),
fails AS (SELECT w.doc_id, part,
    (CASE WHEN n < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * d < 50 * n THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_extract_all(w.text, '[A-Z]')) > 3 * length(w.text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > f.first THEN 'E' ELSE '' END) AS fails
  FROM words w JOIN firsts f ON w.text = f.text),
counts AS (SELECT part, fails, count(*) AS n, sum(CASE WHEN good THEN 1 ELSE 0 END) AS good, sum(CASE WHEN toxic THEN 1 ELSE 0 END) AS toxic
  FROM fails f LEFT JOIN marks m ON f.doc_id = m.doc_id GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || letter FROM orders JOIN letters ON NOT contains(filter_order, letter) WHERE length(filter_order) < 5),
steps AS (SELECT filter_order, i AS step, substr(filter_order, i, 1) AS filter, substr(filter_order, 1, i - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE length(filter_order) = 5),
met AS (SELECT part, filter_order, step, filter, n, good, toxic, contains(fails, filter) AS now, fails = filter AS alone,
    len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND before <> '' AND fails <> '' AS earlier FROM counts, steps),
summed AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT earlier AND NOT now THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT earlier AND now THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN earlier AND now THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT earlier AND now THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT earlier AND now THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step::INTEGER AS step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM summed"""
