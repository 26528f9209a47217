"""Near copies by five-word shingles: SimHash with meet-in-the-middle ball hashing, verified by exact Jaccard.

Each distinct set of shingles has a SimHash, and those within two bits are linked as by ``simhash``. At a similarity of 0.8
about ten of 64 bits differ, and a ball of half that radius has eight million points. So that no pair between is lost, the
same is done on fingerprints whose digits are min-hashes, five for each of eight: it emits the five points that leave one
of them out. Two texts meet where at most one differs; at 0.8 that happens to 74 of 100 pairs, and to all but one in 40,000 of
them in one of eight fingerprints.

Texts that meet, directly or by way of others, are a family. Inside a family the similarity of all whole sets is computed,
as matrix products over blocks of bounded size, and only links enough to connect what is similar leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.llm.common import add_columns, durable, join_counted, utf8
from scribelake.llm.components import connected_components
from scribelake.llm.simhash import keep_heads, links, majority

PRINTS, SIZE = 8, 5
#: A block of a family has room for so many shingles; each text takes up some besides its own, as it is a row of a matrix.
ROOM, EACH = 4_000_000, 2_000
#: In a block of over SMALL texts, shingles that more than DENSE of them have are counted by matrix products and rarer ones
#: pair by pair; in a smaller one all are counted by matrix products.
SMALL, DENSE = 256, 32
#: Up to so many members of families are broadcast to where the sets are made; more are joined by shuffle.
BROADCAST_MEMBERS = 200_000
_own = np.random.default_rng(5)
FACTORS, TERMS = (_own.integers(0, 1 << 63, (PRINTS, SIZE), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
SALTS = _own.integers(0, 1 << 63, (PRINTS, SIZE), np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of the text's shingles in order; a shorter text is one shingle, an empty one has none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64))


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) if len(hashes) else 0


def points(hashes: np.ndarray) -> np.ndarray:
    """The points of all fingerprints; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(PRINTS * SIZE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, _mix(hashes[at : at + 1024, None] * FACTORS.reshape(1, -1)).min(axis=0))
    terms = _mix(least.reshape(PRINTS, SIZE) * TERMS)
    return _mix(terms.sum(axis=1, keepdims=True, dtype=np.uint64) - terms + SALTS).ravel().view(np.int64)


def similar(sets: list[np.ndarray], similarity: float = 0.8) -> np.ndarray:
    """Which of these sorted sets share this much of their union, as a symmetric matrix."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared, waiting = np.zeros((m, m)), []
    few = 1 if m <= SMALL else DENSE
    dense = np.flatnonzero(uses > few)
    place = np.full(len(uses), -1)
    place[dense] = np.arange(len(dense))
    for first in range(0, len(dense), 1024):
        has = (place[column] >= first) & (place[column] < first + 1024)
        part = np.zeros((m, min(1024, len(dense) - first)), np.float32)
        part[owner[has], place[column[has]] - first] = 1
        shared += part @ part.T
    order, starts = np.argsort(column, kind="stable"), uses.cumsum() - uses
    for k in range(2, few + 1):
        at = starts[uses == k]
        left, right = np.triu_indices(k, 1)
        step = max(1, 4_000_000 // len(left))
        for first in range(0, len(at), step):
            who = owner[order[at[first : first + step, None] + np.arange(k)]]  # in order, as owners are
            waiting.append((who[:, left] * m + who[:, right]).ravel())
            if sum(map(len, waiting)) > 4_000_000:
                rare = np.bincount(np.concatenate(waiting), minlength=m * m).reshape(m, m)
                shared += rare + rare.T
                waiting = []
    if waiting:
        rare = np.bincount(np.concatenate(waiting), minlength=m * m).reshape(m, m)
        shared += rare + rare.T
    near = shared >= similarity * (sizes[:, None] + sizes - shared) - 1e-6
    np.fill_diagonal(near, True)
    return near


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) that connect what the matrix connects, each row to the first of its part."""
    out, left = [], np.ones(len(near), bool)
    for first in range(len(near)):
        if left[first]:
            left[first] = False
            front = np.array([first])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & left)
                left[front] = False
                out += [(first, int(i)) for i in front]
    return out


def _longs(keys: list[int]) -> pa.Array:
    return pa.array(np.array(keys, np.uint64).view(np.int64))


def with_key(docs: DataFrame, *, text_col: str, out: str) -> DataFrame:
    make = lambda cols: [_longs([set_key(shingle_set(t)) for t in utf8(cols[text_col])])]
    return add_columns(docs, T.StructType([T.StructField(out, T.LongType())]), make, [text_col])


def _with_points(docs: DataFrame) -> DataFrame:
    """(id, fp: the set's key, print: its SimHash, size, points) of (id, text)."""

    def make(cols: dict[str, pa.Array]) -> list[pa.Array]:
        sets = list(map(shingle_set, utf8(cols["text"])))
        return [_longs(list(map(set_key, sets))), _longs(list(map(majority, sets))), pa.array([len(s) for s in sets], pa.int64()), pa.array([points(s) for s in sets], pa.list_(pa.int64()))]

    fields = (T.StructField("fp", T.LongType()), T.StructField("print", T.LongType()), T.StructField("size", T.LongType()), T.StructField("points", T.ArrayType(T.LongType())))
    return add_columns(docs, T.StructType(list(fields)), make, ["text"]).drop("text")


def _sets(docs: DataFrame) -> DataFrame:
    """(fp, shingles) of (text), copies once for each task as far as it remembers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[int] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                new: dict[int, bytes] = {}
                for text in utf8(batch.slice(start, 256).column("text")):
                    hashes = shingle_set(text)
                    if (key := set_key(hashes)) not in made:
                        made.add(key)
                        new[key] = hashes.tobytes()
                if len(made) > 500_000:
                    made.clear()
                yield pa.RecordBatch.from_arrays([_longs(list(new)), pa.array(new.values(), pa.binary())], names=["fp", "shingles"])

    return docs.select("text").mapInArrow(run, "fp long, shingles binary")


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): set keys that connect all whose SimHashes lie within two bits. Keys of one SimHash are linked to the smallest of
    them, and those smallest ones by the balls of ``simhash.links``."""
    own = durable(rows.where("size > 0").select("fp", "print").distinct())
    heads = durable(own.groupBy("print").agg(F.min("fp").alias("head"), F.count("*").alias("n")))
    same = join_counted(own, heads, "print", "n", own.count()).where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    near = durable(links(heads.select(F.col("print").alias("fp")), 2))
    end = lambda c: heads.select(F.col("print").alias(c), F.col("head").alias(f"head_{c}"))
    near = near.join(end("a"), "a").join(end("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return same.unionByName(near)


def _families(rows: DataFrame) -> DataFrame:
    """(fp, root, blocks): the texts that meet others, the family of each and into how many blocks the family is cut."""
    seen = rows.select("fp", F.explode("points").alias("point"))
    meets = durable(seen.groupBy("point").agg(F.count("*").alias("n"), F.min("fp").alias("head"), F.max("fp").alias("other")).where("head <> other").drop("other"))
    total = rows.agg(F.sum(F.size("points"))).first()[0] or 0
    pairs = join_counted(seen, meets, "point", "n", total).where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    pairs = simhash_pairs(rows).unionByName(pairs)
    nodes = durable(connected_components(pairs).select(F.col("node").alias("fp"), "root").join(rows.select("fp", "size").distinct(), "fp"))
    families = nodes.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum(F.col("size") + EACH) / ROOM).cast("int").alias("blocks"))
    return durable(join_counted(nodes, families, "root", "n", nodes.count()).select("fp", "root", "blocks"))


def _links(rows: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links between set keys, enough to connect all similar pairs of a family.

    Members are dealt to blocks by a hash. Each two blocks of a family come together once, so a task holds two blocks at
    most however large the family is; a family of one block, as nearly all are, is sent once.
    """
    wanted = _families(rows)
    few = wanted.count() <= BROADCAST_MEMBERS
    members = _sets(docs).join(F.broadcast(wanted) if few else wanted, "fp").dropDuplicates(["fp"])
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(own)))
    dealt = members.select("fp", "shingles", "root", own.alias("own"), F.explode(others).alias("other"))
    dealt = dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, sets = None, [], []

        def found() -> pa.RecordBatch:
            links = forest(similar(sets, similarity)) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in links], pa.int64()), pa.array([keys[j] for _, j in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *group, fp, shingles in zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high", "fp", "shingles")), strict=True):
                if group != held:
                    yield found()
                    held, keys, sets = group, [], []
                keys.append(fp)
                sets.append(np.frombuffer(shingles, np.uint64))
        yield found()

    dealt = dealt.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    return durable(dealt.mapInArrow(run, "a long, b long"))


def keep_one_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of texts that share this much of their five-word shingles, that with the
    smallest id; columns are as they were.

    Words are parted by ASCII white space, A-Z count as a-z. Ids, nulls and repeated rows are treated as by
    ``simhash.keep_one``. Null, empty and blank texts are one group; very long texts are taken whole. An empty table
    stays empty.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = durable(_with_points(texts))
    links = _links(rows, texts, similarity)
    rows = rows.select("id", "fp")
    return keep_heads(docs, rows, links, lambda some, out: with_key(some, text_col=text_col, out=out), id_col, text_col)
