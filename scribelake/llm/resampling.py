"""Resampling a corpus towards a target distribution, by importance over hashed n-grams.

Features are counted in DuckDB, one connection a task: words are unnested, n-grams are windows over them, and a registered
zlib CRC-32 gives each distinct n-gram its bucket. The bucket counts of every document are spilled to Parquet in the shared
folder. From there Spark merges the buckets, makes of each bucket's two shares a gain, sums gains to weights, and draws the
documents of the highest weight plus Gumbel noise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.llm.common import add_columns, durable, spilled

#: A word is a run of ASCII digits, lower-case letters and characters beyond ASCII, after A-Z are lower-cased.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: DuckDB counts texts in blocks of about so many bytes; a longer text is a block of its own.
BLOCK = 4 << 20

SPILL = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])


def grams_sql(least: int, most: int, buckets: int) -> str:
    """Of table ``block`` (r, text): r, n_words, n_features, and the buckets and counts of its n-grams, in the order of r."""
    gram = lambda n: "w" + "".join(f" || ' ' || lead(w, {k}) OVER o" for k in range(1, n))
    runs = " UNION ALL ".join(f"SELECT * FROM (SELECT r, {gram(n)} AS g FROM words {'WINDOW o AS (PARTITION BY r ORDER BY i)' if n > 1 else ''}) WHERE g IS NOT NULL" for n in range(least, most + 1))
    return f"""
WITH lists AS (SELECT r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TOKEN}') AS ws FROM block),
words AS (SELECT r, unnest(ws) AS w{", unnest(range(len(ws))) AS i" if most > 1 else ""} FROM lists),
grams AS ({runs}),
hashed AS (SELECT g, (crc32(g) % {buckets})::INTEGER AS b FROM (SELECT DISTINCT g FROM grams)),
counted AS (SELECT r, b, count(*) AS n FROM grams JOIN hashed USING (g) GROUP BY r, b),
packed AS (SELECT r, sum(n)::BIGINT AS n_features, list(b ORDER BY b) AS buckets, list(n ORDER BY b) AS counts FROM counted GROUP BY r)
SELECT l.r, len(ws)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(buckets, []::INTEGER[]) AS buckets, coalesce(counts, []::BIGINT[]) AS counts
FROM lists l LEFT JOIN packed p ON l.r = p.r ORDER BY l.r"""


def crc32(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(g) for g in grams.cast(pa.binary()).to_pylist()], pa.int64())


def connect() -> duckdb.DuckDBPyConnection:
    """A connection of one thread, in memory, that knows ``crc32``."""
    con = duckdb.connect(":memory:", config={"threads": 1})
    con.create_function("crc32", crc32, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``size`` bytes of text."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if held and held + n > size:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def bucket_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets, counts), one row per row of ``docs``: a map over whole texts."""
    sql = grams_sql(least, most, buckets)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], *SPILL])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for batch in batches:
            for start, end in blocks(batch.column("text")):
                part = batch.slice(start, end - start)
                con.register("block", pa.table({"r": pa.array(range(part.num_rows), pa.int64()), "text": part.column("text")}))
                made = con.sql(sql).to_arrow_table().combine_chunks()
                con.unregister("block")
                columns = [made.column(f.name).combine_chunks().cast(k) for f, k in zip(SPILL, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=schema.names)
        con.close()

    return rows.mapInArrow(run, schema)


def merged(spill: DataFrame, name: str) -> DataFrame:
    """(bucket, ``name``): how often all documents hold the bucket. Counts are added up before the shuffle, which has at
    most one row a bucket and task."""
    return spill.select(F.explode(F.arrays_zip("buckets", "counts")).alias("c")).groupBy(F.col("c.buckets").alias("bucket")).agg(F.sum("c.counts").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: an array with each bucket's gain, floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), from (bucket, s) and (bucket, t).
    It has ``buckets`` numbers whatever the size of the tables."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(F.broadcast(corpus), "bucket", "left").join(F.broadcast(target), "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"))
    rows = both.agg(F.array_sort(F.collect_list(F.struct("bucket", "s", "t"))).alias("all"), F.sum("s").alias("total_s"), F.sum("t").alias("total_t"))
    share = lambda c: ((c["t"] + 1) * (F.col("total_s") + buckets)) / ((c["s"] + 1) * (F.col("total_t") + buckets))
    return rows.select(F.transform("all", lambda c: F.floor(1000 * F.ln(share(c))).cast("long")).alias("gains"))


def weights(held: pa.ListArray, counts: pa.ListArray, gain: np.ndarray) -> pa.Array:
    """Each row's sum of its buckets' gains."""
    ends = held.offsets.to_numpy()
    sums = np.concatenate([[0], np.cumsum(gain[held.flatten().to_numpy()] * counts.flatten().to_numpy())])
    ends = ends - ends[0]
    return pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())


def noise(id_: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) of a uniform draw by the id: Gumbel noise, so that the highest sums are a draw by weight."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def places(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows``, written down in ``order``, with each row's place in ``place``, from 1.

    The sort deals rows to tasks by range, so no task holds them all. A row's number in its task comes with the sort; only
    how many rows each task has is added up in one place.
    """
    within = (1 << 33) - 1
    sorted_ = durable(rows.orderBy(*order).withColumn("nth", F.monotonically_increasing_id()))
    sorted_ = sorted_.withColumn("part", F.shiftright("nth", 33)).withColumn("nth", F.col("nth").bitwiseAND(within))
    tasks = sorted_.groupBy("part").agg(F.count("*").alias("held")).orderBy("part").collect()  # a row a task
    before, so_far = [], 0
    for t in tasks:
        before.append((t["part"], so_far))
        so_far += t["held"]
    offsets = rows.sparkSession.createDataFrame(before, "part long, before long")
    return sorted_.join(F.broadcast(offsets), "part").withColumn("place", F.col("before") + F.col("nth") + 1).drop("part", "nth", "before")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score, rank.

    ``weight`` is the sum of the gains of the text's n-grams of ``least`` to ``most`` words, ``score`` adds the noise of its id.
    Of the documents with at least ``least_words`` words, ``percent`` in a hundred (rounded down) with the highest scores
    are drawn and ranked, ties by the smaller id; the others' rank is null.

    A null text has no words, and weight 0. A null id draws as the text ``null`` and comes last among ties; rows equal in id
    and score are ranked by their place in the input. Repeated rows count each. A very long text is counted whole, in a block of
    its own. An empty table gives an empty result; an empty target makes every t 0. Extra columns are ignored.
    """
    options = {"least": least, "most": most, "buckets": buckets}
    with spilled(bucket_counts(docs, id_col=id_col, text_col=text_col, **options).withColumn("serial", F.monotonically_increasing_id()), "buckets") as spill:
        corpus = durable(merged(spill, "s"))
        wanted = durable(merged(bucket_counts(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), id_col="id", **options), "t"))
        gain = np.array(gains(corpus, wanted, buckets).first()["gains"], np.int64)
        rows = add_columns(spill, T.StructType([T.StructField("weight", T.LongType())]), lambda cols: [weights(cols["buckets"], cols["counts"], gain)], ["buckets", "counts"], rows=10_000)
        rows = durable(rows.select("id", "serial", "n_words", "n_features", "weight").withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("fits", F.col("n_words") >= least_words))
    drawn = rows.where("fits").count() * percent // 100
    rows = places(rows, [F.desc("fits"), F.desc("score"), F.col("id").asc_nulls_last(), F.col("serial")])
    return rows.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when(F.col("fits") & (F.col("place") <= drawn), F.col("place")).alias("rank"))


def resample_sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """The whole of ``resample`` for single words in DuckDB, which has no CRC-32: it is folded over each distinct word's
    bytes, with a table made by its polynomial."""
    words = lambda table, extra: f"SELECT {extra} unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TOKEN}')) AS w FROM {table}"
    return f"""
WITH bits AS (SELECT list(n ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS n FROM range(256) t(i))),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM {documents}),
own AS ({words("docs", "r,")}),
theirs AS ({words(benchmark, "")}),
spelt AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM own UNION SELECT w FROM theirs)),
hashed AS (SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda c, b: xor(tab[xor(c & 255, b) + 1], c >> 8)), 4294967295) % {BUCKETS} AS b
  FROM spelt, bits),
s AS (SELECT b, count(*) AS s FROM own JOIN hashed USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM theirs JOIN hashed USING (w) GROUP BY b),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
gains AS (SELECT i AS b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (ss + {BUCKETS})) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + {BUCKETS}))))::BIGINT AS gain
  FROM range({BUCKETS}) k(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i, totals),
weights AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM own JOIN hashed USING (w) JOIN gains USING (b) GROUP BY r),
rows AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS fit FROM rows)
SELECT doc_id, n_features AS n_words, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= fit * {PERCENT} // 100 THEN place END AS rank FROM ranked"""
