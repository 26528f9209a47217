"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common point within r bits of both. So each distinct fingerprint
emits every variant within half the radius (for radius 2: itself and 64 with one bit flipped), variants are shuffled, and
fingerprints that meet at a variant are linked after their distance is verified. Only distinct fingerprints take part,
so a variant holds at most as many of them as its ball has points (65), however many documents are copies.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.llm.common import add_columns, durable, fresh, join_counted, utf8
from scribelake.llm.components import connected_components

BITS = 64


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the shingles' hashes, counting repeats."""
    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; none of no hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint", words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with the fingerprint as a long (its bits; negative if the top one is set). A null text is empty: zero."""

    def make(cols: dict[str, pa.Array]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, words, seed) for t in utf8(cols[text_col])], np.uint64).view(np.int64))]

    return add_columns(docs, T.StructType([T.StructField(out, T.LongType())]), make, [text_col])


def ball(radius: int) -> list[int]:
    """The masks of up to ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b) between the distinct longs ``fp``, enough to connect all that lie within ``radius``.

    All fingerprints at one variant lie within the radius of it and so, by way of the variant's ball, each pair that is
    within ``radius`` meets at some variant. There each is linked to its neighbour in order if within the radius; for an
    even radius all pairs at a variant are, so the chain connects them. For an odd radius every pair of the ball is tried.
    """
    half = (radius + 1) // 2
    seen = prints.select("fp", F.explode(F.array(*map(F.lit, ball(half)))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    if radius % 2 == 0:
        pairs = seen.select(F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("a"), F.col("fp").alias("b")).where("a is not null")
    else:
        other = seen.select(F.col("fp").alias("b"), "variant")
        pairs = seen.select(F.col("fp").alias("a"), "variant").join(other, "variant").where("a < b")
    return pairs.select("a", "b").distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, and for each fp its (copies, root, head: the smallest (id, fp) of its component)."""
    rows = durable(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), text_col="text", out="fp", words=words, seed=seed).drop("text"))
    prints = durable(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    return rows, _heads(prints, links(prints, radius))


def _heads(prints: DataFrame, linked: DataFrame) -> DataFrame:
    parts = connected_components(linked).select(F.col("node").alias("fp"), "root")
    grouped = prints.join(parts, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    grouped = durable(grouped)
    heads = grouped.groupBy("root").agg(F.min(F.when(F.col("least").isNotNull(), F.struct(F.col("least").alias("id"), "fp"))).alias("head"), F.count("*").alias("n"))
    return durable(join_counted(grouped, heads, "root", "n", grouped.count()).select("fp", "copies", "root", "head"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable), copies
    (rows with this fingerprint).

    Null, empty and blank texts have fingerprint zero and are linked like any other; a very long text is hashed whole, in
    blocks. Rows with equal ids keep a row each.
    A null id counts as no id: a component of nothing else has a null component_id. An empty table gives an empty result;
    extra columns are ignored.
    """
    rows, classes = _classes(docs, id_col, text_col, words, seed, radius)
    table = classes.select("fp", F.col("head.id").alias("component_id"), "copies", F.col("copies").alias("n"))
    out = join_counted(rows, table, "fp", "n", rows.count())
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that with the smallest id; columns are as they were.

    Where rows of different groups share an id, their fingerprints tell them apart; of repeated rows one stays, the first
    by text. Rows with a null id are all kept, as nothing can name the one to stay. Null, empty and blank texts are one
    group. An empty table stays empty.
    """
    rows, classes = _classes(docs, id_col, text_col, words, seed, radius)
    return _keep(docs, rows, classes, lambda some, out: with_fingerprint(some, text_col=text_col, out=out, words=words, seed=seed), id_col, text_col)


def keep_heads(docs: DataFrame, rows: DataFrame, linked: DataFrame, with_print: Callable[[DataFrame, str], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """As ``keep_one``, for fingerprints of another kind: ``rows`` (id, fp), the links between them, and what adds them."""
    prints = durable(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    return _keep(docs, rows, _heads(prints, linked), with_print, id_col, text_col)


def _keep(docs: DataFrame, rows: DataFrame, classes: DataFrame, with_print: Callable[[DataFrame, str], DataFrame], id_col: str, text_col: str) -> DataFrame:
    mark, print_, rank = fresh(docs.columns, "head", "fp", "rank")
    heads = classes.where("head is not null and fp = head.fp").select(F.col("head.id").alias(mark), F.col("fp").alias(print_))
    again = durable(rows.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias(mark)))
    same = F.col(id_col) == F.col(mark)
    kept = docs.join(heads.select(mark), same, "left_semi").join(again, same, "left_anti").unionByName(docs.where(F.col(id_col).isNull()))
    if again.isEmpty():
        return kept
    several = with_print(docs.join(again, same, "left_semi"), print_)
    pairs = heads.select(F.col(mark), F.col(print_).alias(rank))
    several = several.join(pairs, same & (F.col(print_) == F.col(rank)), "left_semi")
    # A minimum, so that the repeats of one id are combined before the shuffle.
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col(text_col).isNull(), F.col(text_col))).alias(rank)
    return kept.unionByName(several.groupBy(F.col(id_col).alias(mark), print_).agg(first).select(f"{rank}.*"))
