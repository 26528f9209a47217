"""Quality rules by labelling lines: a linear-chain conditional random field marks each line as content or boilerplate.

Labels are of documents, so lines are taught in rounds. At first all lines of a good document are content and all of a
bad one boilerplate; then the field decodes the bad documents itself (at least one line of each stays boilerplate) and
learns from that. Viterbi decoding marks all lines of a text together, and the share of words in content lines decides
whether it is kept, unless the base rules have failed it already.

Lines are measured in blocks of texts at once: sums over bytes and words by line are differences of running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.llm.common import add_columns, utf8
from scribelake.llm.toxicity import held_out, labelled_sample

FEATURES = ("words", "word_bytes", "upper", "digits", "symbols", "marks", "beyond_ascii", "ends_stop", "ends_cry", "ends_symbol", "lone_symbols", "long_words", "distinct", "commonest", "like_before", "copy", "stops", "capital", "first", "last")
#: A text with fewer words fails, and so does one with more than this share of its words in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 0.5, 3
_SPACE, _SYMBOLS = b"\t\n\x0b\x0c\r ", b"#*$%&|<>"
_STOPS, _MARKS = b".,;:?", bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _SYMBOLS)


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_IS = {
    "space": _table(_SPACE), "upper": _table(bytes(range(65, 91))), "digits": _table(bytes(range(48, 58))), "symbols": _table(_SYMBOLS), "marks": _table(_MARKS),
    "beyond": _table(bytes(range(128, 256))), "first_byte": ~_table(bytes(range(128, 192))), "stop": _table(_STOPS), "cry": _table(b"!"),
}


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many are set from each start to its end."""
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[ends] - upto[starts]


@dataclass
class Measured:
    """A block of texts: the base rules' counts by text, and the lines that hold a word, in order, with their features."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    owner: np.ndarray  # the text of each line
    line_words: np.ndarray
    features: np.ndarray

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (self.n_repeat_words > MOST_REPEATED * self.n_words)


def measure(texts: list[bytes]) -> Measured:
    """Every text is looked at whole; an empty one has no lines."""
    n = len(texts)
    whole = b"\n".join(texts)
    raw = np.frombuffer(whole, np.uint8)
    breaks = np.flatnonzero(raw == 10)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(raw)]])
    text_starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    owner = np.searchsorted(text_starts, starts, "right") - 1

    # Words, in the order in which the texts are cut: none goes over a line's end.
    dark = np.concatenate([[False], ~_IS["space"][raw], [False]])
    word_starts, word_ends = np.flatnonzero(dark[1:-1] & ~dark[:-2]), np.flatnonzero(dark[1:-1] & ~dark[2:]) + 1
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in whole.split()), np.int64, len(word_starts))
    line_of = np.searchsorted(starts, word_starts, "right") - 1
    line_words = np.bincount(line_of, minlength=len(starts))
    lengths, last = word_ends - word_starts, raw[word_ends - 1] if len(word_ends) else np.zeros(0, np.uint8)
    by_word = lambda flags: np.bincount(line_of, flags, len(starts))

    # Lines, only those with a word.
    seen: dict[tuple[int, bytes], int] = {}
    again, full = np.zeros(len(starts), bool), line_words > 0
    for i, (line, text) in enumerate(zip(whole.split(b"\n"), owner.tolist(), strict=True)):
        if full[i]:
            again[i] = seen.setdefault((text, line), i) != i
    copied = np.zeros(len(starts), bool)
    copied[[seen[owner[i], whole[starts[i] : ends[i]]] for i in np.flatnonzero(again)]] = True
    pairs, times = np.unique(line_of * max(1, len(known)) + ids, return_counts=True)
    pair_line = pairs // max(1, len(known))
    commonest = np.zeros(len(starts))
    np.maximum.at(commonest, pair_line, times)

    w, size = np.maximum(line_words, 1), np.maximum(ends - starts, 1)
    of_bytes = {k: _sums(_IS[k][raw], starts, ends) for k in ("upper", "digits", "symbols", "marks", "beyond")}
    first_word = np.minimum(np.searchsorted(line_of, np.arange(len(starts))), max(0, len(ids) - 1))
    before = np.concatenate([[False], (ids[1:] == ids[:-1]) & (line_of[1:] == line_of[:-1])]) if len(ids) else np.zeros(0, bool)
    final = first_word + line_words - 1
    at = lambda flags, place: flags[np.clip(place, 0, len(flags) - 1)] if len(flags) else np.zeros(len(place), bool)
    lines = np.flatnonzero(full)
    kept_owner = owner[lines]
    columns = (
        np.log1p(line_words), by_word(lengths) / w, of_bytes["upper"] / size, of_bytes["digits"] / size, of_bytes["symbols"] / size, of_bytes["marks"] / size, of_bytes["beyond"] / size,
        by_word(_IS["stop"][last]) / w, by_word(_IS["cry"][last]) / w, by_word(_IS["symbols"][last] & (lengths > 1)) / w, by_word(_IS["symbols"][last] & (lengths == 1)) / w,
        by_word(lengths > 15) / w, np.bincount(pair_line, minlength=len(starts)) / w, commonest / w * (line_words > 4), by_word(before) / w, again | copied, at(_IS["stop"][last], final),
        at(_IS["upper"][raw[word_starts]] if len(ids) else np.zeros(0, bool), first_word),
    )
    features = np.zeros((len(lines), len(FEATURES)))
    for k, c in enumerate(columns):
        features[:, k] = c[lines]
    if len(lines):
        features[:, -2] = np.concatenate([[True], kept_owner[1:] != kept_owner[:-1]])
        features[:, -1] = np.concatenate([kept_owner[1:] != kept_owner[:-1], [True]])

    text_of_word = owner[line_of]
    sums = lambda flags: np.bincount(owner, _sums(flags, starts, ends), n).astype(np.int64)
    return Measured(
        np.bincount(text_of_word, minlength=n), sums(dark[1:-1] & _IS["first_byte"][raw]), sums(_IS["symbols"][raw]), np.bincount(owner[again], minlength=n),
        np.bincount(text_of_word[_repeated(ids, text_of_word, WINDOW)], minlength=n), kept_owner, line_words[lines], features,
    )


def _repeated(ids: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Which words are in a window of so many that its text holds twice or more."""
    out = np.zeros(len(ids), bool)
    if len(ids) < window:
        return out
    at = np.flatnonzero(owner[window - 1 :] == owner[: len(owner) - window + 1])
    key = owner[at]
    for k in range(window):
        _, key = np.unique(key * (int(ids.max()) + 1) + ids[at + k], return_inverse=True)
    twice = at[np.bincount(key, minlength=1)[key] > 1]
    for k in range(window):
        out[twice + k] = True
    return out


@dataclass
class Field:
    """Scores of a chain: a line's own for content (boilerplate has 0), and of moves[a, b] from a label to the next."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # the last is a constant
    moves: np.ndarray

    def own(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight[:-1] + self.weight[-1]


class Chains:
    """Lines of several texts, longest first, so that those with a line at place t are the first of them."""

    def __init__(self, owner: np.ndarray) -> None:
        _, first, length = np.unique(owner, return_index=True, return_counts=True)
        order = np.argsort(-length, kind="stable")
        self.first, self.length = first[order], length[order]
        self.steps = int(self.length[0]) if len(length) else 0
        self.alive = np.searchsorted(-self.length, -np.arange(self.steps), "left")

    def at(self, t: int) -> np.ndarray:
        """The lines at place t."""
        return self.first[: self.alive[t]] + t


def viterbi(field: Field, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The most likely labels of each text's lines together: true for content, and for what is as likely."""
    chains, own, label = Chains(owner), field.own(x), np.zeros(len(x), bool)
    came = np.zeros((2, len(x)), bool)  # from content, for a line that is boilerplate or content
    best = np.zeros((2, len(chains.first)))
    for t in range(chains.steps):
        lines = chains.at(t)
        k, m = len(lines), field.moves
        if t:
            ways = best[:, None, :k] + m[:, :, None]
            came[:, lines] = ways[1] >= ways[0]
            best[:, :k] = ways.max(axis=0)
        best[1, :k] += own[lines]
    ends = best[1] >= best[0]
    for t in range(chains.steps - 1, -1, -1):
        lines = chains.at(t)
        k = len(lines)
        later = t + 1 < chains.length[:k]
        label[lines] = np.where(later, came[label[np.minimum(lines + 1, len(x) - 1)].astype(int), np.minimum(lines + 1, len(x) - 1)], ends[:k])
    return label


def _expected(field: Field, own: np.ndarray, chains: Chains) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of the log partition functions, each line's probability of content, and the expected moves."""
    forward, back = np.zeros((2, len(own))), np.zeros((2, len(own)))
    m = field.moves
    for t in range(chains.steps):
        lines = chains.at(t)
        if t:
            ways = forward[:, None, lines - 1] + m[:, :, None]
            forward[:, lines] = np.logaddexp(ways[0], ways[1])
        forward[1, lines] += own[lines]
    for t in range(chains.steps - 2, -1, -1):
        lines = chains.at(t + 1)
        ahead = back[:, lines] + np.stack([np.zeros(len(lines)), own[lines]])
        ways = m[:, :, None] + ahead[None]
        back[:, lines - 1] = np.logaddexp(ways[:, 0], ways[:, 1])
    ends = chains.first + chains.length - 1
    total = np.logaddexp(forward[0, ends], forward[1, ends])
    of_line = np.zeros(len(own))
    for t in range(chains.steps):
        lines = chains.at(t)
        of_line[lines] = total[: len(lines)]
    p = np.exp(forward[1] + back[1] - of_line)
    moves = np.zeros((2, 2))
    for t in range(1, chains.steps):
        lines = chains.at(t)
        ahead = back[:, lines] + np.stack([np.zeros(len(lines)), own[lines]])
        moves += np.exp(forward[:, None, lines - 1] + m[:, :, None] + ahead[None] - of_line[lines]).sum(axis=2)
    return float(total.sum()), p, moves


def fit_field(x: np.ndarray, owner: np.ndarray, label: np.ndarray, *, start: Field | None = None, chained: bool = True, l2: float = 0.5, steps: int = 80, rate: float = 0.1) -> Field:
    """The field of highest penalised likelihood of the labels, climbed with adaptive steps. Rows of a text are in order.
    Unless ``chained``, moves score nothing and lines are learned one by one."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))])
    chains, y = Chains(owner), label.astype(float)
    same = owner[1:] == owner[:-1]
    seen = np.array([[(same & (label[:-1] == a) & (label[1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    w = np.concatenate([start.weight, start.moves.ravel()]) if start else np.zeros(z.shape[1] + 4)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        field = Field(mean, scale, w[:-4], w[-4:].reshape(2, 2))
        _, p, moves = _expected(field, z @ w[:-4], chains)
        slope = (np.concatenate([z.T @ (y - p), (seen - moves).ravel() * chained]) - l2 * w) / len(x)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w = w + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return Field(mean, scale, w[:-4], w[-4:].reshape(2, 2))


def teach(x: np.ndarray, owner: np.ndarray, good: np.ndarray, rounds: int = 3) -> Field | None:
    """The field from the lines of texts that are ``good`` or not (by line). None where a kind is missing.

    In the first round lines are learned one by one: as all lines of a text still have its label, a chain would learn
    nothing but that.
    """
    if not len(x) or good.all() or not good.any():
        return None
    label, field = good.copy(), None
    for k in range(rounds):
        field = fit_field(x, owner, label, start=field, chained=k > 0, steps=40 if field else 80)
        label = good | viterbi(field, x, owner)
        # The line of a bad text that is least like content stays boilerplate.
        bad = np.flatnonzero(~good)
        worst = bad[np.lexsort((field.own(x[bad]), owner[bad]))]
        label[worst[np.concatenate([[True], owner[worst][1:] != owner[worst][:-1]])]] = False
    return fit_field(x, owner, label, start=field, steps=40)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 4_000, lines: int = 200, seed: int = 11) -> Field | None:
    """Fits on at most ``sample`` labelled documents outside the held-out fold, and of each on at most ``lines`` lines in a
    row from a place drawn by its text (documented bounds; marking has none)."""
    rows = labelled_sample(docs, labels, "quality", id_col=id_col, text_col=text_col, rows=sample, seed=seed)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            m, x = measure(texts), []
            edges = np.searchsorted(m.owner, np.arange(len(texts) + 1))
            for a, b, t in zip(edges[:-1], edges[1:], texts, strict=True):
                a += len(t) % max(1, b - a - lines + 1)
                x.append(m.features[a : min(b, a + lines)].astype(np.float32).ravel())
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").cast(pa.string()), "x": pa.array(x, pa.list_(pa.float32())), "good": pc.equal(batch.column("label"), 1)})

    got = rows.select("id", "text", "label").mapInArrow(make, "id string, x array<float>, good boolean").toArrow().to_pydict()
    order = [i for i in sorted(range(len(got["id"])), key=lambda i: (got["id"][i], got["good"][i], got["x"][i])) if got["x"][i]]
    if not order:
        return None
    x = [np.array(got["x"][i], float).reshape(-1, len(FEATURES)) for i in order]
    sizes = [len(m) for m in x]
    return teach(np.vstack(x), np.repeat(np.arange(len(x)), sizes), np.repeat(np.array([got["good"][i] for i in order], bool), sizes))


def content_words(field: Field | None, m: Measured) -> tuple[np.ndarray, np.ndarray]:
    """For each text its words in content lines and its content lines; without a field every line is content."""
    content = viterbi(field, m.features, m.owner) if field else np.ones(len(m.owner), bool)
    n = len(m.n_words)
    return np.bincount(m.owner, m.line_words * content, n).astype(np.int64), np.bincount(m.owner[content], minlength=n)


def blocks(texts: list[bytes], size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``size`` bytes; a longer text is a run of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("n_lines", T.LongType()), T.StructField("n_content_lines", T.LongType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def with_verdict(docs: DataFrame, field: Field | None, *, text_col: str = "text", least_share: float = 0.5) -> DataFrame:
    """``docs`` with ``VERDICT``'s columns, a map over rows."""

    def make(cols: dict[str, pa.Array]) -> list[pa.Array]:
        texts, out = utf8(cols[text_col]), []
        for start, end in blocks(texts):
            m = measure(texts[start:end])
            words, lines = content_words(field, m)
            share = words / np.maximum(m.n_words, 1)
            out.append((*(getattr(m, c) for c in COUNTS), m.base_failed, np.bincount(m.owner, minlength=end - start), lines, share, ~m.base_failed & (share >= least_share)))
        return [pa.array(np.concatenate(c), k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()], strict=True)]

    return add_columns(docs, VERDICT, make, [text_col], rows=1000)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.5, **options) -> DataFrame:
    """One row per row of ``docs``: id, held_out (its label isn't learned from) and ``VERDICT``: the base rules' counts,
    n_lines (with a word), n_content_lines, content_share (of the words) and kept.

    A text is kept if the base rules pass it and at least ``least_share`` of its words are in content lines. A null or empty
    text has no lines and fails the base rules. Every whole text is marked, very long ones too, in memory in proportion. Equal texts
    have equal verdicts, repeated rows one each. A null id is in the fold of the empty text. Without labels of both kinds
    every line is content. An empty table gives an empty result; extra columns are ignored.
    """
    field = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    rows = with_verdict(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), field, least_share=least_share)
    return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), *VERDICT.names)


def mark_lines(docs: DataFrame, field: Field | None, *, id_col: str = "doc_id", text_col: str = "text", out: str = "content") -> DataFrame:
    """``docs`` with the text of their content lines alone, joined by line ends, in ``out``; empty where there is none."""

    def make(cols: dict[str, pa.Array]) -> list[pa.Array]:
        texts, found = utf8(cols[text_col]), []
        for start, end in blocks(texts):
            m = measure(texts[start:end])
            content = iter((viterbi(field, m.features, m.owner) if field else np.ones(len(m.owner), bool)).tolist())
            for t in texts[start:end]:
                found.append(b"\n".join(line for line in t.split(b"\n") if line.split() and next(content)).decode())
        return [pa.array(found, pa.string())]

    return add_columns(docs, T.StructType([T.StructField(out, T.StringType())]), make, [text_col], rows=1000)
