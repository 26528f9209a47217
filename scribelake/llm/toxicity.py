"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees, out_of_fold
from scribelake.llm.common import add_columns, draw, durable, fresh

#: Words of contempt, in English, German, French and Spanish.
LEXICON = frozenset(
    """
    idiot idiots stupid moron morons dumb fool scum trash garbage loser losers pathetic worthless disgusting clown clowns
    imbecile vermin filth freak creep jerk coward ugly useless hate bastard damn hell bitch crap shit fuck fucking asshole
    idiotin dumm dummkopf trottel depp arschloch scheisse scheiße abschaum versager widerlich wertlos erbärmlich hässlich
    idiote imbécile crétin débile connard connasse salaud salope merde ordure dégoûtant pathétique nul minable abruti
    idiota estúpido estúpida imbécil tonto tonta basura mierda asqueroso asquerosa patético patética inútil cabrón payaso
    """.split()
)
SECOND_PERSON = frozenset("you your yours yourself youre u du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Look-alikes inside words; a star stands for any letter.
LOOK_ALIKES = str.maketrans("013457@$!|+", "oieastasiit")
STARRED = frozenset(f"{w[:i]}*{w[i + 1 :]}" for w in LEXICON for i in range(1, len(w)))
_WORDS = re.compile(r"[^\W\d_]+").findall
#: Words with digits or signs before a letter of theirs.
_MIXED = re.compile(r"(?<![\w@$*!|+])[^\W\d_]*[0-9@$*!|+]+[^\W\d_][\w@$*!|+]*").findall
#: Kinds of bytes: letters (any byte of another script's is one), and digits and signs that can stand for letters.
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN[list(b"0123456789@$*!|+")] = True
NAMES = ("words", "lexicon_density", "lexicon_hits", "kinds", "learned_density", "learned_hits", "second_person", "proximity", "capitals", "shouted", "exclaims", "punctuation", "digits", "obfuscated", "disguised_hits", "runs")


#: Learned stems are word beginnings of these lengths; a whole word has "=" before it.
STEMS = range(3, 8)
CODES = 400_000


class WordCodes(dict):
    """What a lower-case word is: 1 in the lexicon, 2 second person, 4 x 2**i has a stem of the ith learned set (up to six).
    Remembers up to CODES words."""

    def __init__(self, *learned: frozenset[str]) -> None:
        super().__init__()
        self.learned = learned

    def __missing__(self, word: str) -> int:
        own = {f"={word}", *(word[:n] for n in STEMS)}
        code = (word in LEXICON) | 2 * (word in SECOND_PERSON) | sum(4 << i for i, stems_ in enumerate(self.learned) if not own.isdisjoint(stems_))
        if len(self) < CODES:
            self[word] = code
        return code


def features(text: str, codes: WordCodes) -> list[list[float]]:
    """Dense features of a whole text, a row for each learned set; zeros for an empty text."""
    low = text.lower()
    words = _WORDS(low)
    n, code = max(1, len(words)), np.frombuffer(bytes(map(codes.__getitem__, words)), np.uint8)
    known, person = int((code & 1).sum()), int(((code & 2) > 0).sum())
    spots = np.flatnonzero(code & 2)
    data = np.frombuffer(text.encode(), np.uint8)
    raw, letter = np.bincount(data, minlength=256), _LETTER[data]
    # The pattern is slow, and can match only where a sign comes before a letter.
    mixed = _MIXED(low) if (_SIGN[data[:-1]] & letter[1:]).any() else []
    disguised = sum((plain := m.translate(LOOK_ALIKES)) in LEXICON or plain in STARRED for m in mixed)
    same = (data[1:] == data[:-1]) & letter[1:]
    runs = int((same[1:] & same[:-1]).sum())
    size = max(1, int(raw.sum()))
    upper, letters = raw[65:91].sum(), max(1, raw[65:91].sum() + raw[97:123].sum())
    marks = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()
    out = []
    for i in range(len(codes.learned)):
        own, at = int(((code & (4 << i)) > 0).sum()), np.flatnonzero(code & (1 | 4 << i))
        near = 0.0
        if len(at) and person:
            right = np.searchsorted(spots, at)
            gap = np.minimum(np.abs(spots[np.minimum(right, person - 1)] - at), np.abs(spots[np.maximum(right - 1, 0)] - at))
            near = float((1.0 / (1.0 + gap)).max())
        out.append([
            np.log1p(len(words)), known / n, np.log1p(known), len({words[j] for j in at}), own / n, np.log1p(own), person / n, near,
            upper / letters, float(upper > letters / 2), raw[33] / size, marks / size, raw[48:58].sum() / size, len(mixed) / n, disguised, runs / n,
        ])
    return out


@dataclass
class ToxicityModel:
    trees: Trees
    isotonic: Isotonic
    learned: frozenset[str]
    codes: WordCodes | None = None

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        codes = self.codes = self.codes or WordCodes(self.learned)  # kept by the worker's copy of the model
        return np.clip(self.isotonic(self.trees.margin(np.array([features(t, codes)[0] for t in texts]))), 0.0, 1.0)


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether crc32(id as text) mod ``folds`` is ``fold``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % folds == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, *, id_col: str, text_col: str, rows: int, seed: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, *also, label) of at most ``rows`` labelled documents outside the held-out fold, drawn by a hash of the id.

    Null labels and ids teach nothing; a document with several labels has the largest. The ids are few, so they are
    broadcast and the documents aren't shuffled.
    """
    ids = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("label"))
    ids = ids.orderBy(draw(F.lit(seed), F.col("doc_id")), "doc_id").limit(rows).select(F.col("doc_id").alias("id"), "label")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *also)
    return texts.join(F.broadcast(ids), "id")


def stems(text: str) -> set[str]:
    words = set(_WORDS(text.lower()))
    return {w[:n] for n in STEMS for w in words if len(w) >= n}.union("=" + w for w in words)


def _learned(sample: DataFrame, parts: int, least_share: float, least: int, ratio: float, most: int) -> list[frozenset[str]]:
    """The stems learned from the whole sample, then those learned without part 0, without part 1, ... of it.

    A stem is in at least a ``least_share`` of the toxic texts (and ``least`` of them) and ``ratio`` times as usual there as
    elsewhere; of more than ``most``, the commonest. Counts are combined in the worker by blocks of documents and again
    before the shuffle.
    """
    names = [f"{kind}{i}" for kind in "tc" for i in range(parts)]
    schema = pa.schema([("stem", pa.string()), *((n, pa.int64()) for n in names)])

    def count(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part, found = batch.slice(start, 200), {n: Counter() for n in names}
                for text, label, i in zip(*(part.column(c).to_pylist() for c in ("text", "label", "part")), strict=True):
                    found[f"{'t' if label == 1 else 'c'}{i}"].update(stems(text or ""))
                keys = sorted(set().union(*found.values()))
                yield pa.RecordBatch.from_pydict({"stem": keys, **{n: [found[n][s] for s in keys] for n in names}}, schema)

    sizes = {(r["toxic"], r["part"]): r["n"] for r in sample.groupBy((F.col("label") == 1).alias("toxic"), "part").agg(F.count("*").alias("n")).collect()}
    table = sample.select("text", "label", "part").mapInArrow(count, "stem string, " + ", ".join(f"{n} long" for n in names)).groupBy("stem").agg(*(F.sum(n).alias(n) for n in names))
    table = durable(table.where(sum((F.col(f"t{i}") for i in range(parts)), F.lit(0)) >= least))
    out = []
    for without in range(-1, parts):
        used = [i for i in range(parts) if i != without]
        toxic, clean = (sum(sizes.get((k, i), 0) for i in used) for k in (True, False))
        t, c = (sum((F.col(f"{kind}{i}") for i in used), F.lit(0)) for kind in "tc")
        found = table.where((t >= max(least, least_share * toxic)) & (t / F.lit(float(max(toxic, 1))) >= ratio * (c + 0.5) / F.lit(float(max(clean, 1))))) if toxic and clean else table.limit(0)
        out.append(frozenset(r["stem"] for r in found.orderBy(t.desc(), "stem").limit(most).collect()))
    return out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 12_000, most_stems: int = 1000, parts: int = 3, seed: int = 4) -> ToxicityModel:
    """Fits on at most ``sample`` labelled documents outside the held-out fold and with at most ``most_stems`` learned word
    beginnings (documented bounds; scoring has none).

    Isotonic calibration uses margins of models that haven't seen a row's label in any way: for each part of the sample,
    stems and trees are learned from the other parts. Equal texts are in one part. With no labels every score is 0.
    """
    rows = labelled_sample(docs, labels, "toxic", id_col=id_col, text_col=text_col, rows=sample, seed=seed)
    rows = durable(rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")))
    learned = _learned(rows, parts, 0.01, 4, 6.0, most_stems)

    def make(batches):
        codes = WordCodes(*learned)
        for batch in batches:
            x = [sum(features(t or "", codes), []) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").cast(pa.string()), "x": pa.array(x, pa.list_(pa.float64())), "y": batch.column("label").cast(pa.float64()), "part": batch.column("part")})

    got = rows.select("id", "text", "label", "part").mapInArrow(make, "id string, x array<double>, y double, part int").toArrow().to_pydict()
    order = sorted(range(len(got["y"])), key=lambda i: (got["id"][i], got["y"][i], got["x"][i]))
    x = np.array([got["x"][i] for i in order]).reshape(len(order), parts + 1, len(NAMES))
    y, part = (np.array([got[c][i] for i in order]) for c in ("y", "part"))
    y = (y == 1).astype(float)
    if not len(y):
        return ToxicityModel(fit_trees(x[:, 0], y), Isotonic(np.zeros(1), np.zeros(1)), learned[0])
    margin = out_of_fold(lambda i: x[:, 1 + i], y, part)
    return ToxicityModel(fit_trees(x[:, 0], y), fit_isotonic(margin, y), learned[0])


def with_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the calibrated score of each whole text, from 0 to 1. A null text is empty, and scored too."""

    def make(cols: dict[str, pa.Array]) -> list[pa.Array]:
        return [pa.array(model.score([t or "" for t in cols[text_col].to_pylist()]), pa.float64())]

    return add_columns(docs, T.StructType([T.StructField(out, T.DoubleType())]), make, [text_col])


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted. Only the text is an input of a score.

    A null text is empty, and empty and very long texts are scored as wholes like any other; equal texts have equal
    scores and repeated rows a result each. A null id is in the fold of the empty text. Empty tables give empty results;
    extra columns are ignored."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    rows = with_toxicity(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, text_col="text", out="score")
    return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns are as they were, null texts are scored as
    empty ones and an empty table stays empty."""
    (score,) = fresh(docs.columns, "score")
    return with_toxicity(docs, fit(docs, labels, id_col=id_col, text_col=text_col, **options), text_col=text_col, out=score).where(F.col(score) < threshold).drop(score)
