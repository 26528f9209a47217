"""Language-model scoring by a subword lattice.

A word is a path through pieces of an existing vocabulary, and its probability is the sum over all paths, by a forward
recursion in log space. A vocabulary's scores say how likely a piece is to begin with. The public vocabulary at hand is of
merge ranks, not of unigram scores, so Zipf's law turns its scores into probabilities, and expected counts in the distinct
words of the training documents re-weight them: a substitute for scores that the file doesn't have. ``lattice_score`` is
of this alone. For ``score``, words that training has seen are also remembered whole: each keeps its discounted share of
the tokens, and what the discount takes is spread by the lattice. So

    P(word) = max(c - D, 0) / N + D V / N * sum over segmentations of P(pieces) P(stop after the last, go on after others)

which sums to one over all byte strings, and the end of a text is a token with a share of its own.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.llm.common import durable

#: So many of the most frequent words, at most, are looked up where texts are read (and a few more that have over a
#: thousandth of all tokens); the rest shuffle. Longer words than LONG bytes are among those few only.
HOT, LONG = 200_000, 100
#: Entries of a worker's word counts before they are handed on.
HELD = 300_000
#: Symbols of a block of words.
BLOCK = 60_000
_PRIME, _SPREAD = 0x100000001B3, 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Pieces:
    """The vocabulary: pieces as bytes (a leading space marks a word's start) and their scores."""

    pieces: tuple[bytes, ...]
    scores: tuple[float, ...]

    @staticmethod
    @lru_cache(maxsize=4)
    def read(path: str) -> Pieces:
        """Of a sentencepiece model file. Byte pieces make every word reachable."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {}
        least = min(model.get_score(i) for i in range(model.get_piece_size()))
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i):
                continue
            piece = bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            score = least if model.is_byte(i) else model.get_score(i)
            if piece:
                found[piece] = max(score, found.get(piece, score))
        for b in range(256):
            found.setdefault(bytes([b]), least)
        return Pieces(tuple(found), tuple(found.values()))

    def start(self) -> np.ndarray:
        """Probabilities by Zipf's law: a merge's score is its rank, negated."""
        return self.shared(1.0 / (20.0 - np.minimum(0.0, np.array(self.scores))))

    def shared(self, weight: np.ndarray) -> np.ndarray:
        """Probabilities of the pieces that can come first, and likewise of all others: each kind sums to one."""
        first = np.array([p[:1] == b" " for p in self.pieces])
        return weight / np.where(first, weight[first].sum(), weight[~first].sum())


class Lattice:
    """Forward and backward recursions over blocks of words; a word starts with a space."""

    def __init__(self, pieces: tuple[bytes, ...], probability: np.ndarray, stop: np.ndarray | float) -> None:
        """``stop``: how likely a word ends after a piece, for each piece or for all."""
        self.last, self.go = np.log(probability) + np.log(stop), np.log(probability) + np.log1p(-np.asarray(stop))
        self.longest = max(map(len, pieces))
        bits = max(4, (8 * len(pieces)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), 2**bits - 1
        self.slots, self.ids = np.zeros(2**bits, np.uint64), np.full(2**bits, -1, np.int64)
        for i, piece in enumerate(pieces):
            h = 0
            for b in piece:
                h = (h * _PRIME + b + 1) % 2**64
            at = (h * _SPREAD % 2**64) >> (64 - bits)
            while self.ids[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at], self.ids[at] = h, i

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed byte strings, -1 for what is no piece; collisions go on to the next slot."""
        at = ((h * np.uint64(_SPREAD)) >> self.shift).astype(np.int64)
        out = self.ids[at]
        off = np.flatnonzero((out >= 0) & (self.slots[at] != h))
        while len(off):
            at[off] = (at[off] + 1) & self.mask
            out[off] = self.ids[at[off]]
            off = off[(out[off] >= 0) & (self.slots[at[off]] != h[off])]
        return out

    def _arcs(self, words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths, and for each piece length the ids of arcs by word and start."""
        size = np.array([len(w) for w in words])
        longest = int(size.max())
        symbols = np.zeros((len(words), longest), np.uint64)
        symbols[np.arange(longest) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        arcs, h = [], np.zeros((len(words), longest), np.uint64)
        for n in range(1, min(self.longest, longest) + 1):
            h = h[:, : longest - n + 1] * np.uint64(_PRIME) + symbols[:, n - 1 :] + np.uint64(1)
            ids = self._find(h.reshape(-1)).reshape(h.shape)
            ids[np.arange(longest - n + 1) + n > size[:, None]] = -1
            arcs.append(ids)
        return size, arcs

    def _weights(self, size: np.ndarray, arcs: list[np.ndarray]) -> list[np.ndarray]:
        """Log probability of each arc, and that the word ends there or goes on."""
        out = []
        for n, ids in enumerate(arcs, 1):
            final = np.arange(ids.shape[1]) + n == size[:, None]
            out.append(np.where(ids >= 0, np.where(final, self.last[ids], self.go[ids]), -np.inf))
        return out

    def _forward(self, weights: list[np.ndarray], rows: int, longest: int) -> np.ndarray:
        alpha = np.full((rows, longest + 1), -np.inf)
        alpha[:, 0] = 0.0
        for end in range(1, longest + 1):
            terms = np.stack([alpha[:, end - n] + weights[n - 1][:, end - n] for n in range(1, min(end, len(weights)) + 1)])
            top = terms.max(axis=0)
            safe = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                alpha[:, end] = safe + np.log(np.exp(terms - safe).sum(axis=0))
        return alpha

    def _blocks(self, words: list[bytes]):
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        start = 0
        while start < len(order):
            end, n = start + 1, len(words[order[start]])
            while end < len(order) and (end - start + 1) * max(n, len(words[order[end]])) <= BLOCK:
                n = len(words[order[end]])
                end += 1
            yield order[start:end]
            start = end

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural-log marginal probability of each word over all its segmentations."""
        out = np.zeros(len(words))
        for block in self._blocks(words):
            size, arcs = self._arcs([words[i] for i in block])
            alpha = self._forward(self._weights(size, arcs), len(block), int(size.max()))
            out[block] = alpha[np.arange(len(block)), size]
        return out

    def expected(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each piece, and of those the ones at a word's end, summed over the words."""
        uses, ends = np.zeros(len(self.go)), np.zeros(len(self.go))
        for block in self._blocks(words):
            size, arcs = self._arcs([words[i] for i in block])
            longest, rows = int(size.max()), len(block)
            weights = self._weights(size, arcs)
            alpha = self._forward(weights, rows, longest)
            total = alpha[np.arange(rows), size]
            beta = np.full((rows, longest + 1), -np.inf)
            for start in range(longest, -1, -1):
                terms = [np.where(size == start, 0.0, -np.inf)]
                terms += [beta[:, start + n] + weights[n - 1][:, start] for n in range(1, min(longest - start, len(weights)) + 1)]
                terms = np.stack(terms)
                top = terms.max(axis=0)
                safe = np.where(np.isfinite(top), top, 0.0)
                with np.errstate(divide="ignore"):
                    beta[:, start] = safe + np.log(np.exp(terms - safe).sum(axis=0))
            for n, (ids, weight) in enumerate(zip(arcs, weights, strict=True), 1):
                log = alpha[:, : longest - n + 1] + weight + beta[:, n:] - total[:, None]
                has, final = ids >= 0, (ids >= 0) & (np.arange(ids.shape[1]) + n == size[:, None])
                uses += np.bincount(ids[has], np.exp(log[has]), len(uses))
                ends += np.bincount(ids[final], np.exp(log[final]), len(ends))
        return uses, ends


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case; the end of the text is not among them."""
    return (text or "").encode().lower().split()


def learns(id_col: str = "doc_id", folds: int = 7, fold: int = 2):
    """Whether a row is for training: crc32(id as text) mod ``folds`` is not ``fold``; a null id is the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % folds != fold


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c: occurrences in rows that train, everywhere: in all rows), from (text, train)."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("everywhere", pa.int64())])

    def run(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            words = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([seen[1][w] for w in words], pa.int64()), pa.array([seen[0][w] + seen[1][w] for w in words], pa.int64())], schema=schema)
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in batches:
            for text, train in zip(batch.column("text").to_pylist(), batch.column("train").to_pylist(), strict=True):
                seen[bool(train)].update(tokens(text))
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield flush()
        yield flush()

    return rows.select("text", "train").mapInArrow(run, "word string, c long, everywhere long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("everywhere").alias("everywhere"))


@dataclass(frozen=True)
class WordModel:
    """Everything a word's probability needs besides its count."""

    pieces: tuple[bytes, ...]
    probability: np.ndarray
    stop: np.ndarray | float
    words: int  # training tokens without ends
    ends: int
    kinds: int  # distinct words
    discount: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def end(self) -> float:
        return (self.ends + 1) / (self.words + self.ends + 2)

    def log10(self, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words with these counts: with what is remembered of them, and by the lattice alone."""
        alone = _lattice(self).score([b" " + w for w in words])
        spread = self.discount * self.kinds / self.words if self.words else 1.0
        seen = np.maximum(counts - self.discount, 0) / max(1, self.words)
        with np.errstate(divide="ignore"):
            both = np.logaddexp(np.log(seen), np.log(spread) + alone)
        return (np.log1p(-self.end) + both) / np.log(10), (np.log1p(-self.end) + alone) / np.log(10)


_made: dict[str, Lattice] = {}


def _lattice(model: WordModel) -> Lattice:
    """One for each worker and model."""
    if model.name not in _made:
        _made.clear()
        _made[model.name] = Lattice(model.pieces, model.probability, model.stop)
    return _made[model.name]


def fit(counts: DataFrame, ends: int, path: str, *, rounds: int = 2, prior: float = 1000.0) -> WordModel:
    """Re-weights the vocabulary's pieces by their expected counts in all distinct training words (a word counts once,
    as the lattice stands in for rare ones), with ``prior`` counts by the vocabulary's own scores. What comes back from
    a round is a sum for each piece, so its size is the vocabulary's."""
    total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).first()
    vocabulary = Pieces.read(path)
    start = vocabulary.start()
    probability, stop, pieces = start, 0.25, vocabulary.pieces
    for _ in range(rounds if total["v"] else 0):

        def run(batches, probability=probability, stop=stop):
            lattice = Lattice(pieces, probability, stop)
            sums = np.zeros((2, len(pieces)))
            for batch in batches:
                sums += lattice.expected([b" " + w for w in batch.column("word").cast(pa.binary()).to_pylist()])
            used = np.flatnonzero(sums[0])
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0, used]), pa.array(sums[1, used])], names=["piece", "uses", "ends"])

        made = counts.where("c > 0").select("word").mapInArrow(run, "piece long, uses double, ends double")
        got = made.groupBy("piece").agg(F.sum("uses").alias("uses"), F.sum("ends").alias("ends")).toArrow()
        uses, ending = np.zeros(len(pieces)), np.zeros(len(pieces))
        at = np.array(got.column("piece"), np.int64)
        uses[at], ending[at] = np.array(got.column("uses")), np.array(got.column("ends"))
        # A piece ends a word as often as it has been seen to; rare ones as often as all do.
        stop = (ending + 10 * ending.sum() / uses.sum()) / (uses + 10)
        probability = vocabulary.shared(uses + prior * start)
    one, two = total["one"] or 0, total["two"] or 0
    discount = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5
    return WordModel(pieces, probability, stop, total["n"] or 0, ends, total["v"] or 0, discount)


def _hot(words: DataFrame, total: int) -> Column:
    """Which words are looked up where texts are read: frequent and short ones, at most HOT, and any that alone have over a
    thousandth of all tokens. The limit is read off the numbers of words by magnitude of their count, so it is exact."""
    size = F.floor(F.log2("everywhere") * 8).cast("int")
    short = F.octet_length("word") <= LONG
    numbers = words.where(short).groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect()
    least, sum_ = None, 0
    for r in numbers:
        sum_ += r["count"]
        if sum_ > HOT:
            break
        least = r["size"]
    often = F.col("everywhere") * 1000 > total
    return often if least is None else often | (short & (size >= least))


def score_texts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, rounds: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score.

    Tokens are words and one end. Word counts cover all training rows. Frequent words, at most ``HOT``, are scored where
    the text is read; others are shuffled to the word table once per text, and sums come back by row. A null or empty
    text is one end. A very long text is scored as a whole; a word of n bytes takes memory in proportion to n times the
    longest piece (some 180 MB for 400,000 bytes without a space). Rows are told apart by id and text, and repeated rows
    have a result each; without training rows all words come from the lattice alone. An empty table gives an empty
    result; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), learns(id_col, folds, fold).alias("train"))
    counts = durable(count_words(rows))
    ends = rows.where("train").count()
    model = fit(counts, ends, path, rounds=rounds)
    train = model.words + ends
    below = float(train + model.kinds + bool(ends) + 1)  # N + (V + 1); the end is a distinct token too

    def run(batches):
        for batch in batches:
            c = np.array(batch.column("c"), np.int64)
            log, alone = model.log10(batch.column("word").cast(pa.binary()).to_pylist(), c)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("everywhere"), pa.array(log), pa.array(alone)], names=["word", "c", "everywhere", "log", "alone"])

    words = durable(counts.mapInArrow(run, "word string, c long, everywhere long, log double, alone double"))
    hot_ones = _hot(words, words.agg(F.sum("everywhere")).first()[0] or 0)
    hot = words.where(hot_ones).select("word", "c", "log", "alone").toArrow()
    columns = (hot.column("word").cast(pa.binary()).to_pylist(), *(hot.column(c).to_pylist() for c in ("c", "log", "alone")))
    known = docs.sparkSession.sparkContext.broadcast({w: (bool(c), np.log10((c + 1) / below).item(), log, alone) for w, c, log, alone in zip(*columns, strict=True)})
    last = float(np.log10(model.end))
    end = (bool(ends), float(np.log10((ends + 1) / below)), last, last)

    def split(batches):
        look = known.value.get
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                cols: list[list] = [[] for _ in range(9)]
                ids, marks, names, times, *sums = cols
                for i, text in enumerate(part.column("text").to_pylist()):
                    found = Counter(tokens(text))
                    n, k, b, s, a, rare = 1, int(end[0]), *end[1:], []
                    for word, m in found.items():
                        n += m
                        if (hit := look(word)) is None:
                            rare.append(word)
                        else:
                            k += m * hit[0]
                            b += m * hit[1]
                            s += m * hit[2]
                            a += m * hit[3]
                    mark = xxhash.xxh3_64_intdigest(text) >> 1
                    # A text without rare words goes by a name of its own: with a space in it, it is no word.
                    rare = rare or [b" %d" % (mark ^ xxhash.xxh3_64_intdigest(b"%d %d" % (start, i)))]
                    ids += [i] * len(rare)
                    marks += [mark] * len(rare)
                    names += rare
                    times += [found.get(w, 0) for w in rare]
                    for column, value in zip(sums, (n, k, b, s, a), strict=True):
                        column.append(value)
                        column += [None] * (len(rare) - 1)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(ids, pa.int64())), pa.array(marks, pa.int64()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(times, pa.int32()),
                    *(pa.array(c, pa.float64() if f else pa.int64()) for f, c in zip((0, 0, 1, 1, 1), sums, strict=True)),
                ], names=["id", "mark", "word", "times", "n_tokens", "n_known", "base", "score", "lattice"])

    schema = T.StructType([rows.schema["id"], *(T.StructField(n, k) for n, k in (("mark", T.LongType()), ("word", T.StringType()), ("times", T.IntegerType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("lattice", T.DoubleType())))])
    joined = rows.select("id", "text").mapInArrow(split, schema).join(words.where(~hot_ones).select("word", "c", "log", "alone"), "word", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = lambda c: F.col("times") * F.coalesce(c, F.lit(0.0))
    each = joined.groupBy("id", "mark").agg(
        F.count("n_tokens").alias("copies"), F.max("n_tokens").alias("n_tokens"), F.sum(zero("n_known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(zero("base") + rest(F.log10((F.col("c") + 1) / F.lit(below)))).alias("base_score"), F.sum(zero("score") + rest(F.col("log"))).alias("score"), F.sum(zero("lattice") + rest(F.col("alone"))).alias("lattice_score"),
    )
    n = F.col("copies")
    out = each.withColumn("copy", F.explode(F.sequence(F.lit(1), n.cast("int"))))
    return out.select(
        F.col("id").alias(id_col), (~learns("id", folds, fold)).alias("held_out"), "n_tokens", (F.col("n_known") / n).cast("long").alias("n_known"), F.lit(train).cast("long").alias("train_tokens"),
        *((F.col(c) / n).alias(c) for c in ("base_score", "score", "lattice_score")),
    )
