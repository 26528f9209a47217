"""Byte-level BPE by a hierarchical-bitmap rank queue.

Within a pre-token, every adjacent pair that the vocabulary can merge waits in the bucket of its merge rank, as a
position in a linked list of symbols. A two-level bitmap says which buckets hold anything, so that find-first-set gives
the lowest rank in constant time; entries that a merge has made stale are skipped when they come up. A pre-token of n
bytes takes O(n log n) whatever its length, the log only for the order of places inside a bucket.

Pre-tokens don't touch, so one queue serves very many: the lowest rank of all is the lowest of each one that has it, and its
bucket is merged as a whole, by arrays. That needs ranks to come up in order: pre-tokens in which a merge makes a pair of
lower rank than its own, which trained vocabularies hardly have, are merged one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from copy import copy
from functools import cached_property, lru_cache
from heapq import heappop, heappush
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.llm.common import add_columns, utf8

#: Ranks of one bitmap word.
WORD_SIZE = 256
#: Remembered pre-tokens of one task: two generations of at most so many, of at most so many characters each.
MEMO, MEMO_LENGTH = 750_000, 48
#: Texts of at most so many characters are looked up together; a longer one is alone.
TEXTS = 1 << 22
#: Pre-tokens of at most so many bytes share a queue, a longer one is alone; under the least, buckets are too small for arrays.
QUEUE, LEAST_QUEUE = 1 << 20, 1 << 13
#: Rows of one batch of digests.
ROWS = 4096


class Pairs:
    """Which symbols merge, as arrays. A symbol is a token's rank; ``end`` follows each pre-token and merges with none."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.end = end = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        #: The rank of every two bytes, -1 for none.
        self.two = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        cuts = ((ranks.get(token[:i]), ranks.get(token[i:]), rank) for token, rank in ranks.items() for i in range(1, len(token)))
        rows = [cut for cut in cuts if None not in cut]
        left, right, merged = np.array(rows, np.int32).reshape(-1, 3).T
        #: Symbols that a pair of lower rank has.
        self.odd = {*left[merged < left].tolist(), *right[merged < right].tolist()}
        #: Those that no pair has.
        self.last = {*ranks.values()} - {*left.tolist(), *right.tolist()}
        self.after, self.before = self._by(left, right, merged), self._by(right, left, merged)
        #: By symbol, filled with what goes with one symbol and emptied again.
        self.table = np.full(end + 2, -1, np.int32)

    def _by(self, one: np.ndarray, other: np.ndarray, merged: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        order = np.argsort(one, kind="stable")
        return np.searchsorted(one[order], np.arange(self.end + 1)).tolist(), other[order], merged[order]

    def ranks(self, by: tuple[list[int], np.ndarray, np.ndarray], symbol: int, *others: np.ndarray) -> list[np.ndarray]:
        """Of the pairs of a symbol and others, by ``after`` or ``before``; -1 for none."""
        starts, symbols, merged = by
        a, b = starts[symbol], starts[symbol + 1]
        if a == b:
            return [np.full(len(o), -1, np.int32) for o in others]
        self.table[symbols[a:b]] = merged[a:b]
        found = [self.table[o] for o in others]
        self.table[symbols[a:b]] = -1
        return found


class Vocabulary:
    """Ranks from a file of base64 tokens and ranks. ``pattern`` cuts texts into pre-tokens, each merged by itself."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.find = regex.compile(pattern).findall
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n, get = len(piece), ranks.get
        symbols: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The queue: positions by rank, a bitmap word for every WORD_SIZE ranks, and a summary with one bit for each word.
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        summary = 0
        for i in range(n - 1):
            if (rank := get(piece[i : i + 2])) is not None:
                if rank in buckets:
                    buckets[rank].append(i)  # in order, so still a heap
                else:
                    buckets[rank] = [i]
                    w = rank // WORD_SIZE
                    words[w] = words.get(w, 0) | 1 << rank % WORD_SIZE
                    summary |= 1 << w
        while summary:
            # Find first set, twice.
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            least = w * WORD_SIZE + (bits & -bits).bit_length() - 1
            bucket = buckets[least]
            i = heappop(bucket)
            if not bucket:
                del buckets[least]
                words[w] = bits = bits & bits - 1
                if not bits:
                    summary &= summary - 1
            left, j = symbols[i], after[i]
            if left is None or j >= n or get(merged := left + symbols[j]) != least:
                continue  # stale: a neighbour, or this symbol itself, has been merged meanwhile
            symbols[i], symbols[j] = merged, None
            after[i] = k = after[j]
            h = before[i]
            if k < n:
                before[k] = i
            for at, rank in ((i, get(merged + symbols[k]) if k < n else None), (h, get(symbols[h] + merged) if h >= 0 else None)):
                if rank is not None:
                    if rank in buckets:
                        heappush(buckets[rank], at)
                    else:
                        buckets[rank] = [at]
                        w = rank // WORD_SIZE
                        words[w] = words.get(w, 0) | 1 << rank % WORD_SIZE
                        summary |= 1 << w
        return tuple(ranks[s] for s in symbols if s is not None)

    @cached_property
    def pairs(self) -> Pairs | None:
        """None if some byte is no token."""
        return Pairs(self.ranks) if all(bytes([i]) in self.ranks for i in range(256)) else None

    def merge_all(self, pieces: Iterable[bytes]) -> Iterator[tuple[int, ...]]:
        """``merge`` of each pre-token in turn."""
        some: list[bytes] = []
        size = 0
        for piece in pieces:
            if some and size + len(piece) > QUEUE:
                yield from self._merge_some(some, size)
                some, size = [], 0
            some.append(piece)
            size += len(piece)
        yield from self._merge_some(some, size)

    def _merge_some(self, pieces: list[bytes], size: int) -> Iterator[tuple[int, ...]]:
        """By one queue."""
        if size < LEAST_QUEUE or self.pairs is None:
            yield from map(self.merge, pieces)
            return
        parts = [p for p in pieces if p not in self.ranks]
        merged = self._merge_parts(parts) if parts else iter(())
        for piece in pieces:
            yield (whole,) if (whole := self.ranks.get(piece)) is not None else next(merged)

    def _merge_parts(self, parts: list[bytes]) -> Iterator[tuple[int, ...]]:
        """As ``merge``, all places of a bucket at once."""
        pairs = self.pairs
        end, gone = pairs.end, pairs.end + 1
        code = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
        n, ends = len(code), np.cumsum([len(p) + 1 for p in parts]) - 1
        symbols = pairs.single[code]
        symbols[ends] = end
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)  # the last place comes before the first
        #: The rank of the pair that begins at each place, -1 for none.
        pair = np.full(n, -1, np.int32)
        pair[:-1] = pairs.two[code[:-1].astype(np.int32) * 256 + code[1:]]
        pair[ends] = pair[ends - 1] = -1
        #: Parts in which ranks don't come up in order.
        alone: set[int] = set()
        # The queue: positions by rank, those of the beginning and those of merges, a bitmap word for every WORD_SIZE ranks, and a
        # summary with one bit for each word.
        at = np.flatnonzero(pair >= 0).astype(np.int32)
        at = at[np.argsort(pair[at])]
        found, starts = np.unique(pair[at], return_index=True)
        initial = dict(zip(found.tolist(), np.split(at, starts[1:]), strict=False))
        buckets: dict[int, list[int]] = {rank: [] for rank in initial}
        words: dict[int, int] = {}
        summary = 0
        for rank in buckets:
            w = rank // WORD_SIZE
            words[w] = words.get(w, 0) | 1 << rank % WORD_SIZE
            summary |= 1 << w
        none = at = rank_at = at[:0]
        while True:
            for i, rank in zip(at.tolist(), rank_at.tolist(), strict=True):
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    w = rank // WORD_SIZE
                    words[w] = words.get(w, 0) | 1 << rank % WORD_SIZE
                    summary |= 1 << w
            if not summary:
                break
            # Find first set, twice.
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            least = w * WORD_SIZE + (bits & -bits).bit_length() - 1
            i = np.array(buckets.pop(least), np.int32)
            if (begun := initial.pop(least, None)) is not None:
                i = np.concatenate([begun, i])
            words[w] = bits = bits & bits - 1
            if not bits:
                summary &= summary - 1
            i = i[pair[i] == least]  # the others are stale: a neighbour, or the symbol itself, has been merged meanwhile
            if not len(i):
                at = rank_at = none
                continue
            i.sort()
            j = after[i]
            if (chained := j[:-1] == i[1:]).any():
                # Of places in a row, each the next one's left neighbour, every other one merges, from the left.
                k = np.arange(len(i))
                first = np.maximum.accumulate(np.where(np.append(True, ~chained), k, 0))
                i = i[(k - first) % 2 == 0]
                j = after[i]
            k, h = after[j], before[i]
            was = symbols[k]
            symbols[i], symbols[j], pair[j] = least, gone, -1
            after[i], before[k] = k, i
            if least in pairs.last:
                pair[h] = pair[i] = -1
                at = rank_at = none
                continue
            then, early = pairs.ranks(pairs.after, least, symbols[k], was)
            (back,) = pairs.ranks(pairs.before, least, symbols[h])
            if least in pairs.odd and (low := (early >= 0) & (early < least) | (back >= 0) & (back < least)).any():
                alone.update(np.searchsorted(ends, i[low]).tolist())
            pair[h], pair[i] = back, then
            i, h, then, back = i[then >= 0], h[back >= 0], then[then >= 0], back[back >= 0]
            other = symbols[h] != least  # those are among the places merged just now
            at, rank_at = np.concatenate([i, h[other]]), np.concatenate([then, back[other]])
        ids = symbols[symbols != gone]
        stops = np.flatnonzero(ids == end).tolist()
        ids, start = ids.tolist(), 0
        for k, stop in enumerate(stops):
            yield self.merge(parts[k]) if k in alone else tuple(ids[start:stop])
            start = stop + 1

    def encode(self, text: str) -> list[int]:
        """As the public library does without special tokens."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """``encode`` of each text in turn."""
        numbers: defaultdict[str, int] = defaultdict(count().__next__)
        some: list[list[int]] = []
        size = 0
        for text in texts:
            if some and size + len(text) > TEXTS:
                yield from self._encode_some(some, list(numbers))
                numbers, some, size = defaultdict(count().__next__), [], 0
            some.append(list(map(numbers.__getitem__, self.find(text))))
            size += len(text)
        yield from self._encode_some(some, list(numbers))

    def _encode_some(self, texts: list[list[int]], pieces: list[str]) -> Iterator[list[int]]:
        """Of texts as places in a list of their pre-tokens, of which those that aren't remembered are merged together."""
        new, old = self.new, self.old
        ids = list(map(new.get, pieces))
        missing = [k for k, known in enumerate(ids) if known is None]
        merged = self.merge_all(pieces[k].encode() for k in missing if pieces[k] not in old)
        for k in missing:
            piece = pieces[k]
            ids[k] = old[piece] if piece in old else next(merged)
            if len(piece) <= MEMO_LENGTH:
                if len(new) >= MEMO:
                    self.old = new
                    self.new = new = {}
                new[piece] = ids[k]
        for text in texts:
            yield list(chain.from_iterable(map(ids.__getitem__, text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Once for each Python worker."""
    own = Vocabulary(path, pattern)
    own.pairs  # noqa: B018  # copies have it too
    return own


class TaskVocabulary:
    """What functions for tasks hold: the worker's vocabulary, with remembered pre-tokens that go with the task. Workers stay for
    other work, in which they would hold them for nothing."""

    def __init__(self, path: str, pattern: str) -> None:
        self.named = path, pattern

    @cached_property
    def own(self) -> Vocabulary:
        own = copy(vocabulary(*self.named))
        own.new, own.old = {}, {}
        return own


def encode_column(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text; a null or empty text has none."""
    task = TaskVocabulary(path, pattern)

    def make(cols: dict[str, pa.Array]) -> list[pa.Array]:
        return [pa.array(list(task.own.encode_all(t.as_py() or "" for t in cols[text_col])), pa.list_(pa.int32()))]

    return add_columns(docs, T.StructType([T.StructField(out, T.ArrayType(T.IntegerType()))]), make, [text_col])


def decode_column(docs: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that ids stand for; null ids have none. An unknown id fails the job."""

    def make(cols: dict[str, pa.Array]) -> list[pa.Array]:
        decode = vocabulary(path, pattern).decode
        return [pa.array([decode(ids or []) for ids in cols[ids_col].to_pylist()], pa.binary())]

    return add_columns(docs, T.StructType([T.StructField(out, T.BinaryType())]), make, [ids_col])


def round_trip(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256, of the whole text and of its ids decoded.

    Encodes and decodes without the ids leaving the worker. A null text is empty: no ids, digests of no bytes. A very long
    text is encoded whole, in memory in proportion to it. Ids may be null or repeat; each row is on its own. An empty table gives an empty result; extra columns are ignored.
    """
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    task = TaskVocabulary(path, pattern)

    def make(cols: dict[str, pa.Array]) -> list[pa.Array]:
        own, counts, ids_sha, text_sha = task.own, [], [], []
        for ids in own.encode_all(t.as_py() or "" for t in cols["text"]):
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(own.names.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return add_columns(rows, fields, make, ["text"], ROWS).select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")
