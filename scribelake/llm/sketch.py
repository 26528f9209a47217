"""Document fingerprints by invertible Bloom lookup tables.

A text is a set of paragraph digests. Its table has cells of (count, XOR of keys, XOR of checks), three cells for each
digest, so tables subtract cell by cell: what two versions share vanishes, and peeling cells that hold a single digest
recovers those in which they differ.

``sketch`` gives a text's table as bytes, with room for a difference of half its digests. Sizes are doublings of one
another, and a table folds to any smaller size, so two stored sketches can always be subtracted. If peeling gets stuck, the
difference is too large for them, and sketches of both texts are made again at twice the size.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.llm.common import add_columns

HASHES = 3
#: Cells of the smallest table; each size is twice the one before.
LEAST_CELLS = 24
#: A line is cut after each word whose last byte is 0 modulo 4 (about every fourth), and after MOST_WORDS words anyway.
MOST_WORDS = 12
_WORD, _GAP = rb"[^ \t-\r]+", rb"[ \t\x0b-\r]+"
_ENDS = b"".join(re.escape(bytes([b])) for b in range(256) if b % 4 == 0 and not bytes([b]).isspace())
_most = b"{0,%d}" % (MOST_WORDS - 1)
_PIECES = re.compile(b"(?:%s%s)%s?[^ \t-\r]*[%s](?![^ \t-\r])|(?:%s%s)%s%s" % (_WORD, _GAP, _most, _ENDS, _WORD, _GAP, _most, _WORD)).findall
#: A table has room for a difference of this share of the text's digests.
SHARE, ROOM = 0.5, 1.5
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u8")])


def pieces(text: str) -> list[bytes]:
    """Paragraphs (lines), cut where their own words say, so that an edit changes only the pieces near it. Every part of a
    text is cut by the same rule."""
    return _PIECES(text.encode())


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests; the nth copy of a piece has a digest of its own, so repeats count."""
    found = list(map(xxhash.xxh3_64_intdigest, pieces(text)))
    keys, copies = np.unique(np.array(found, np.uint64), return_counts=True)
    if len(keys) == len(found):
        return keys
    more = np.flatnonzero(copies > 1)
    nth = np.concatenate([np.arange(1, c) for c in copies[more].tolist()]).astype(np.uint64)
    again = np.repeat(keys[more], copies[more] - 1)
    return np.unique(np.concatenate([keys, _mixed(again ^ _mixed(nth, 3), 4)]))


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = keys + np.uint64(_MIX[0] * (salt + 1) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX[2])
        return z ^ (z >> np.uint64(31))


def cells_of(keys: np.ndarray, cells: np.ndarray | int) -> list[np.ndarray]:
    """Each key's three cells, one in each third of a table of so many cells."""
    third = np.asarray(cells // HASHES, np.uint64)
    return [(_mixed(keys, 11 * i + 5) % third + np.uint64(i) * third).astype(np.int64) for i in range(HASHES)]


@dataclass
class Tables:
    """Tables side by side in flat arrays."""

    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, at: list[np.ndarray], size: int) -> Tables:
        out = Tables(np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64))
        out.put(keys, at, np.ones(len(keys), np.int64))
        return out

    def put(self, keys: np.ndarray, at: list[np.ndarray], sign: np.ndarray) -> None:
        checks = _mixed(keys, 99)
        for cell in at:
            np.add.at(self.count, cell, sign)
            np.bitwise_xor.at(self.key, cell, keys)
            np.bitwise_xor.at(self.check, cell, checks)

    def of_owner(self, start: int, end: int) -> bytes:
        """The cells of one table, as they are stored."""
        out = np.zeros(end - start, _CELL)
        out["count"], out["key"], out["check"] = self.count[start:end], self.key[start:end], self.check[start:end]
        return out.tobytes()


def level(digests_: int) -> int:
    """How often the smallest table is doubled for a text of so many digests."""
    return max(0, math.ceil(math.log2(max(1.0, ROOM * SHARE * digests_ / LEAST_CELLS))))


def size_at(levels: np.ndarray | int) -> np.ndarray | int:
    return LEAST_CELLS * 2**levels


def tables(sets: list[np.ndarray], cells: np.ndarray) -> Tables:
    """The tables of several sets, side by side."""
    base = cells.cumsum() - cells
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keys = np.concatenate(sets)
    return Tables.of(keys, [c + base[owner] for c in cells_of(keys, cells[owner])], int(cells.sum()))


def folded(made: Tables, base: np.ndarray, own: np.ndarray, to: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> tuple[Tables, np.ndarray]:
    """Differences, side by side, and their sizes: of tables in ``made`` (from ``base``, at levels ``own``) those in ``plus``
    less those in ``minus``, all at levels ``to``. A cell of a third goes to its place modulo the smaller third."""
    cells = size_at(to)
    start = cells.cumsum() - cells
    out = Tables(*(np.zeros(int(cells.sum()), a.dtype) for a in (made.count, made.key, made.check)))
    for side, sign in ((plus, 1), (minus, -1)):
        sizes = size_at(own[side])
        pair = np.repeat(np.arange(len(side)), sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(sizes.cumsum() - sizes, sizes)
        third = np.repeat(sizes // HASHES, sizes)
        small = cells[pair] // HASHES
        at = start[pair] + place // third * small + place % third % small
        cell = np.repeat(base[side], sizes) + place
        used = made.count[cell] != 0
        at, cell = at[used], cell[used]
        np.add.at(out.count, at, sign * made.count[cell])
        np.bitwise_xor.at(out.key, at, made.key[cell])
        np.bitwise_xor.at(out.check, at, made.check[cell])
    return out, cells


def peel(table: Tables, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, digest, sign) of all that comes off the tables side by side, and which of them didn't come off wholly."""
    base, owner_of = cells.cumsum() - cells, np.repeat(np.arange(len(cells)), cells)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    look = np.flatnonzero(np.abs(table.count) == 1)
    while len(look):
        pure = look[_mixed(table.key[look], 99) == table.check[look]]
        # A digest may stand alone in several of its cells.
        _, first = np.unique(table.key[pure] ^ _mixed(owner_of[pure].astype(np.uint64), 7), return_index=True)
        pure = pure[first]
        keys, owner, sign = table.key[pure], owner_of[pure], table.count[pure]
        at = [c + base[owner] for c in cells_of(keys, cells[owner])]
        table.put(keys, at, -sign)
        found.append((owner, keys, sign))
        look = np.concatenate(at)
        look = np.unique(look[np.abs(table.count[look]) == 1])
    stuck = np.zeros(len(cells), bool)
    stuck[owner_of[(table.count != 0) | (table.key != 0) | (table.check != 0)]] = True
    return *(np.concatenate(x) for x in zip(*found, strict=True)), stuck


class Sketches:
    """The tables of several texts, by their digest sets. Differences of pairs are peeled from these tables; only pairs that
    get stuck have larger ones made."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.levels = sets, np.array([level(len(s)) for s in sets], np.int64)
        cells = size_at(self.levels)
        self.base, self.made = cells.cumsum() - cells, tables(sets, cells)

    def stored(self) -> list[bytes]:
        ends = self.base + size_at(self.levels)
        return [self.made.of_owner(a, b) for a, b in zip(self.base.tolist(), ends.tolist(), strict=True)]

    def differences(self, pairs: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each pair of texts, what only the first and only the second has. All pairs are peeled together, from the
        stored tables folded to the smaller size of the two; those that get stuck, again with twice as large tables."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(pairs)
        first, second = np.array(pairs, np.int64).reshape(-1, 2).T
        at, todo = np.minimum(self.levels[first], self.levels[second]), np.arange(len(pairs))
        while len(todo):
            a, b = first[todo], second[todo]
            stored = at[todo] <= np.minimum(self.levels[a], self.levels[b])
            if stored.all():
                table, cells = folded(self.made, self.base, self.levels, at[todo], a, b)
            else:
                cells = size_at(at[todo])
                table = tables([self.sets[i] for i in a], cells)
                other = tables([self.sets[i] for i in b], cells)
                table = Tables(table.count - other.count, table.key ^ other.key, table.check ^ other.check)
            owner, keys, sign, stuck = peel(table, cells)
            order = np.argsort(owner, kind="stable")
            keys, sign = keys[order], sign[order]
            edges = np.searchsorted(owner[order], np.arange(len(todo) + 1))
            for i in np.flatnonzero(~stuck):
                k, s = keys[edges[i] : edges[i + 1]], sign[edges[i] : edges[i + 1]]
                out[todo[i]] = (k[s > 0], k[s < 0])
            at[todo[stuck]] += 1
            todo = todo[stuck]
        return out


def sketch(text: str, doublings: int = 0) -> bytes:
    """A text's table as bytes: how many digests (8 bytes), then the cells. ``doublings``: how often it is made larger than
    usual, after ``compare`` has found no difference."""
    keys = digests(text)
    cells = size_at(level(len(keys)) + doublings)
    made = tables([keys], np.array([cells]))
    return len(keys).to_bytes(8, "little") + made.of_owner(0, cells)


def compare(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Of two sketches, wherever they were stored: digests that only the first and only the second text has, and the
    Jaccard index; None if they are too small for the difference."""
    count = [int.from_bytes(x[:8], "little") for x in (a, b)]
    both = [np.frombuffer(x[8:], _CELL) for x in (a, b)]
    levels = np.array([int(np.log2(len(x) // LEAST_CELLS)) for x in both])
    flat = np.concatenate(both)
    made = Tables(flat["count"].astype(np.int64), flat["key"].astype(np.uint64), flat["check"].astype(np.uint64))
    table, cells = folded(made, np.array([0, len(both[0])]), levels, levels.min(keepdims=True), np.array([0]), np.array([1]))
    _, keys, sign, stuck = peel(table, cells)
    if stuck[0]:
        return None
    only = keys[sign > 0], keys[sign < 0]
    return *only, likeness(count[0], count[1], only)


def likeness(a: int, b: int, only: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard index from set sizes and the recovered difference; two empty sets are alike."""
    apart = len(only[0]) + len(only[1])
    shared = (a + b - apart) / 2
    return shared / (shared + apart) if shared + apart else 1.0


def with_sketch(docs: DataFrame, *, text_col: str = "text", out: str = "sketch") -> DataFrame:
    """``docs`` with each whole text's ``sketch``, to be stored and compared with those of later versions. A map over rows; a
    null text is empty, and equal texts have equal sketches."""
    make = lambda cols: [pa.array([sketch(t or "") for t in cols[text_col].to_pylist()], pa.binary())]
    return add_columns(docs, T.StructType([T.StructField(out, T.BinaryType())]), make, [text_col])


def parts_for(docs: DataFrame, most: int = 100_000) -> int:
    """As many parts as the files below are read in, which Spark bounds by bytes (``spark.sql.files.maxPartitionBytes``), but the
    session's shuffle partitions at least. Only ids are read to count them."""
    splits = docs.select(F.spark_partition_id().alias("p")).distinct().count()
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, splits))


def in_id_order(docs: DataFrame, parts: int, sample: int = 400_000) -> DataFrame:
    """(id, text, ahead) sorted by id, then by a hash of the text, then by text, within parts; each part ends with the
    first row of the next (``ahead`` 1).

    Any type of id that has an order will do; a null id is the smallest. Bounds are drawn from ``sample`` rows in all, twenty a
    part at most, by a hash, as (id, hash) pairs, so that rows with one id can be in several parts. They are one literal of the
    plan. Texts are shuffled once, and only ``parts`` rows twice.
    """
    key = F.struct(F.col("id").isNotNull().alias("has"), F.col("id").alias("id"), F.xxhash64("text").alias("h"))
    drawn = docs.select(key.alias("k"))
    drawn = drawn.orderBy(F.xxhash64("k", F.lit(9))).limit(min(sample, 20 * parts)) if parts > 1 else drawn.limit(0)
    kind = docs.select(key.alias("k")).schema["k"].dataType
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    drawn = [r["k"] for r in drawn.orderBy("k").select(F.to_json("k", exact).alias("k")).collect()]
    cuts = [drawn[i * len(drawn) // parts] for i in range(1, parts)] if drawn else []
    stride = max(1, int(len(cuts) ** 0.5))
    as_array = lambda rows: F.from_json(F.lit("[" + ",".join(rows) + "]"), T.ArrayType(kind), exact)
    fine, coarse = as_array(cuts), as_array(cuts[::stride])
    # The part is how many bounds are below the key; first among every stride-th of them, then between two of those.
    block = F.greatest(F.size(F.filter(coarse, lambda c: c < key)) - 1, F.lit(0)) * stride
    part = (block + F.size(F.filter(F.slice(fine, block + 1, F.lit(stride)), lambda c: c < key))).cast("int")
    heads = docs.select(key.alias("k"), part.alias("p")).groupBy("p").agg(F.min("k").alias("k")).orderBy("p").collect()
    ahead = docs.sparkSession.createDataFrame([(r["k"], heads[i - 1]["p"]) for i, r in enumerate(heads)], T.StructType([T.StructField("k", kind), T.StructField("to", T.IntegerType())]))
    ahead = ahead.select(F.col("k.id").alias("of"), F.col("k.h").alias("h_of"), "to")
    rows = docs.withColumn("h", F.xxhash64("text")).withColumn("p", part)
    rows = rows.join(F.broadcast(ahead), F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("h_of")), "left")
    places = F.array_compact(F.array(F.struct(F.col("p").alias("part"), F.lit(0).alias("ahead")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("part"), F.lit(1).alias("ahead")))))
    rows = rows.select("id", "text", "h", F.explode(places).alias("at")).select("id", "text", "h", "at.part", "at.ahead")
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ahead", F.col("id").asc_nulls_first(), "h", "text")


OUT = T.StructType([T.StructField(n, k) for n, k in (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()), ("recovered", T.LongType()), ("sketch", T.BinaryType()), ("edited_sketch", T.BinaryType()))])


def compare_texts(texts: list[str], nexts: list[str]) -> list[tuple]:
    """The columns of ``OUT`` for texts and the texts that follow them."""
    cut = [len(t) // 4 for t in texts]
    edited = [t[: len(t) - k] + n[:k] for t, n, k in zip(texts, nexts, cut, strict=True)]
    own = {t: i for i, t in enumerate(dict.fromkeys([*texts, *nexts, *edited]))}
    made = Sketches([digests(t) for t in own])
    size = [len(s) for s in made.sets]
    stored = [n.to_bytes(8, "little") + x for n, x in zip(size, made.stored(), strict=True)]
    marks = [hashlib.sha256(x).hexdigest() for x in stored]
    a, e, n = ([own[t] for t in ts] for ts in (texts, edited, nexts))
    apart = made.differences([*zip(a, e, strict=True), *zip(a, n, strict=True)])
    to_edited, to_next = apart[: len(texts)], apart[len(texts) :]
    return [
        (len(t), hashlib.sha256(ed.encode()).hexdigest(), marks[a[i]], marks[e[i]], likeness(size[a[i]], size[e[i]], to_edited[i]), likeness(size[a[i]], size[n[i]], to_next[i]), len(to_edited[i][0]) + len(to_edited[i][1]), stored[a[i]], stored[e[i]])
        for i, (t, ed) in enumerate(zip(texts, edited, strict=True))
    ]


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, block: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    recovered (digests that peeling recovers between the text and its edited text), sketch, edited_sketch. A fingerprint is the
    SHA-256 of the text's ``sketch``; likenesses are peeled from these tables, and ``compare`` gives the same from what is
    returned, of any two rows, unless they differ by more than the tables hold.

    The edited text ends with the beginning of the next document by id (after the last comes the first; a lone document
    is its own next). Ids can be of any type that has an order. A null text is empty: no digests, and alike to another
    empty one. Null ids come first; rows with equal ids follow each other by a hash of their texts. A very long text is
    sketched whole, in memory in proportion to it. An empty table gives an empty result; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = parts or parts_for(docs)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *OUT])

    def run(batches):
        kept: list[tuple] = []  # rows that wait for the one after them

        def flush(ready: list[tuple], nexts: list[str]):
            for start in range(0, len(ready), block):
                some = ready[start : start + block]
                made = compare_texts([t for _, t in some], nexts[start : start + block])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*((i, *m) for (i, _), m in zip(some, made, strict=True)), strict=True), arrow, strict=True)], schema=arrow)

        arrow = _arrow(schema)
        for batch in batches:
            ready, nexts = [], []
            for i, text, ahead in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "ahead")), strict=True):
                if kept:
                    ready.append(kept.pop())
                    nexts.append(text)
                if not ahead:
                    kept.append((i, text))
            if ready:
                yield from flush(ready, nexts)

    return in_id_order(rows, parts).select("id", "text", "ahead").mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
