"""Document quality by co-training: a classifier of the text's words and one of the page's metadata.

The content view sees words; the metadata view sees where the page is from, how large it is said to be, and its form: lines,
how much of it is capitals, digits or
markup, and how small it packs. Both are logistic regressions on labelled documents. In each round, each
view labels the unlabelled documents that it ranks surest, in the proportion of the classes, and the other view learns from
them too. After each round both views are calibrated on labelled documents that they haven't learned from. The last round
counts whose combined score fits those as well as any round's, so an exchange that does harm is undone. A document's score
combines the calibrated views.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scribelake.llm.common import add_columns, draw
from scribelake.llm.toxicity import held_out, labelled_sample

HASHED = 64
CONTENT = ("words", "word_length", "long_words", "distinct", "decorated", "exclaimed", "bars", "repeats", "commonest", "stops")
SOURCES, LANGS = 24, 8
FORM = ("lines", "line_bytes", "longest_line", "blank_lines", "capitals", "lower", "digits", "marks", "packed")
META = (*FORM, "log_chars", "no_size", *(f"source_{i}" for i in range(SOURCES)), *(f"lang_{i}" for i in range(LANGS)))


def content(text: str) -> np.ndarray:
    """What the words are like, and hashed counts of word shapes; zeros for an empty text."""
    out = np.zeros(len(CONTENT) + HASHED)
    words = text.split()
    n = len(words)
    if not n:
        return out
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    last = raw_ends(words)
    out[: len(CONTENT)] = (
        np.log1p(n), lengths.mean(), (lengths > 15).mean(), len(seen) / n, last["decorated"] / n, last["exclaimed"] / n, seen.get("|", 0) / n,
        1 - len(seen) / n if n > 20 else 0.0, max(seen.values()) / n, last["stops"] / n,
    )
    shape = np.fromiter((xxhash.xxh32_intdigest(w[-3:]) % HASHED for w in seen), np.int64, len(seen))
    out[len(CONTENT) :] = np.bincount(shape, np.fromiter(seen.values(), np.int64, len(seen)), HASHED) / n
    return out


def raw_ends(words: list[str]) -> dict[str, int]:
    """How many words end in decoration, in exclamation, in a full stop."""
    ends = {"decorated": 0, "exclaimed": 0, "stops": 0}
    for w in words:
        c = w[-1]
        if not c.isalnum():
            if c == "!":
                ends["exclaimed"] += 1
            elif c == ".":
                ends["stops"] += 1
            elif c != ",":
                ends["decorated"] += 1
    return ends


def form(text: str) -> np.ndarray:
    """What the page looks like from afar, whatever its words are; zeros for an empty one."""
    out = np.zeros(len(FORM))
    raw = text.encode()
    if not raw:
        return out
    lines = [len(x) for x in raw.split(b"\n")]
    full = [n for n in lines if n]
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    shares = [x / len(raw) for x in (count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), marks)]
    out[:] = (np.log1p(len(full)), np.log1p(sum(full) / max(1, len(full))), np.log1p(max(lines)), 1 - len(full) / len(lines), *shares, len(zlib.compress(raw, 1)) / len(raw))
    return out


def metadata(text: str, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """The page's form, how large it is said to be and where it is from; no word of its text. Sources and languages are
    hashed; what is null has a value of its own."""
    out, at = np.zeros(len(META)), len(FORM)
    out[:at] = form(text)
    out[at], out[at + 1] = np.log1p(max(0, n_chars or 0)), n_chars is None
    out[at + 2 + xxhash.xxh32_intdigest(source or "") % SOURCES] = 1
    out[at + 2 + SOURCES + xxhash.xxh32_intdigest(lang or "") % LANGS] = 1
    return out


@dataclass
class Logistic:
    """On standardised features, with margins first turned into probabilities by ``calibration``."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weight[1:] + self.weight[0]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.calibration[0] * self.margin(x) + self.calibration[1]


def _newton(z: np.ndarray, target: np.ndarray, penalty: np.ndarray, centre: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights with the least logistic loss plus penalty x squared distance from ``centre`` / 2; steps that don't lower it
    are halved."""

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float((np.logaddexp(0, m) - target * m).sum() + (penalty * (w - centre) ** 2).sum() / 2)

    w, now = centre.copy(), loss(centre)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - target) + penalty * (w - centre))
        while (new := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if new > now - 1e-9:
            break
        w, now = w - step, new
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> Logistic:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)])
    penalty = np.full(z.shape[1], l2)
    penalty[0] = 1e-3
    return Logistic(mean, scale, _newton(z, y, penalty, np.zeros(z.shape[1])))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic map from margins, with smoothed targets; identity if a class is missing. Few rows
    move the slope little from 1."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    slope, offset = _newton(np.stack([margin, np.ones_like(margin)], axis=1), target, np.array([2.0, 0.1]), np.array([1.0, 0.0]))
    return float(max(slope, 0.0)), float(offset)


@dataclass
class QualityModel:
    views: tuple[Logistic, Logistic] | None
    prior: float  # log odds of the classes
    given: tuple[tuple[int, int], ...] = ()  # by round that counts: pseudo-labels handed over by content, by metadata

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined and single-view probabilities. Given the class, the views are taken as independent."""
        if self.views is None:
            flat = np.full(len(a), 1 / (1 + np.exp(-self.prior)))
            return flat, flat, flat
        one, two = self.views[0].log_odds(a), self.views[1].log_odds(b)
        return *(1 / (1 + np.exp(-np.clip(m, -50, 50))) for m in (one + two - self.prior, one, two)),


def co_train(a: np.ndarray, b: np.ndarray, y: np.ndarray, pool_a: np.ndarray, pool_b: np.ndarray, *, rounds: int = 5, share: float = 0.05) -> QualityModel:
    """a, b: the two views of labelled rows; pool_a, pool_b: of unlabelled ones. In a round, a view hands over a ``share`` of
    the pool at most, in the proportion of the classes: for each class the rows it ranks surest, of those it finds likelier
    to be in it than the classes' proportion says. A fourth of the labelled rows are kept for calibration and to choose
    the round: the last whose loss there is within a quarter of a standard error of the least."""
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
    keep = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~keep])) < 2 or len(np.unique(y[keep])) < 2:
        return QualityModel(None, prior)
    pools, labels = (pool_a, pool_b), np.full((2, len(pool_a)), -1)  # labels[v]: what view v learns from

    def learn() -> list[Logistic]:
        """Each view on its labels so far, calibrated on the rows that are kept."""
        out = []
        for i, v in enumerate((a, b)):
            view = fit_logistic(np.vstack([v[~keep], pools[i][labels[i] >= 0]]), np.concatenate([y[~keep], labels[i][labels[i] >= 0]]))
            view.calibration = platt(view.margin(v[keep]), y[keep])
            out.append(view)
        return out

    def losses(views: list[Logistic]) -> np.ndarray:
        m = views[0].log_odds(a[keep]) + views[1].log_odds(b[keep]) - prior
        return np.logaddexp(0, m) - y[keep] * m

    views = learn()
    tried, given = [(losses(views), views)], []
    for _ in range(rounds if len(pool_a) else 0):
        handed = [0, 0]
        for giver, taker in ((0, 1), (1, 0)):
            odds = views[giver].log_odds(pools[giver]) - prior
            for label, sure, part in ((1, odds, y.mean()), (0, -odds, 1 - y.mean())):
                free = np.flatnonzero((labels[taker] < 0) & (sure > 0))
                best = free[np.argsort(-sure[free], kind="stable")][: max(1, int(share * part * len(odds)))]
                labels[taker, best] = label
                handed[giver] += len(best)
        views = learn()
        tried.append((losses(views), views))
        given.append((handed[0], handed[1]))
    means = [x.mean() for x, _ in tried]
    best = tried[int(np.argmin(means))][0]
    last = max(k for k, m in enumerate(means) if m <= best.mean() + best.std() / len(best) ** 0.5 / 4)
    return QualityModel((tried[last][1][0], tried[last][1][1]), prior, tuple(given[:last]))


def _views(texts: list, langs: list, sources: list, sizes: list) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or "" for t in texts]
    a = np.array([content(t) for t in texts]).reshape(len(texts), len(CONTENT) + HASHED)
    b = np.array([metadata(t, lang, source, n) for t, lang, source, n in zip(texts, langs, sources, sizes, strict=True)]).reshape(len(texts), len(META))
    return a, b


COLUMNS = ("text", "lang", "source", "n_chars")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, lang, source, n_chars); metadata that the table hasn't got is null."""
    have = {c.lower() for c in docs.columns}
    also = [F.col(c).cast(k).alias(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *also)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 8_000, pool: int = 8_000, seed: int = 2, **options) -> QualityModel:
    """Fits on at most ``sample`` labelled documents outside the held-out fold and a ``pool`` of unlabelled ones for the
    pseudo-labels (documented bounds; scoring has none). Without labels of both classes, every score is the prior."""
    named = _named(docs, id_col, text_col)
    rows = labelled_sample(named, labels, "quality", id_col="id", text_col="text", rows=sample, seed=seed, also=("lang", "source", "n_chars"))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"))
    ids = named.select("id").where("id is not null").join(known, "id", "left_anti").orderBy(draw(F.lit(seed + 100), F.col("id")), "id").limit(pool)
    others = named.join(F.broadcast(ids.distinct()), "id").withColumn("label", F.lit(-1)).select(*rows.columns)

    def make(batches):
        for batch in batches:
            a, b = _views(*(batch.column(c).to_pylist() for c in COLUMNS))
            yield pa.RecordBatch.from_pydict({"id": batch.column("id").cast(pa.string()), "a": pa.array(list(a), pa.list_(pa.float64())), "b": pa.array(list(b), pa.list_(pa.float64())), "label": batch.column("label").cast(pa.int32())})

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("a", T.ArrayType(T.DoubleType())), T.StructField("b", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])
    # A bounded sample: it is put in order here, as an order in the plan would compute the features twice.
    got = rows.unionByName(others).mapInArrow(make, schema).toArrow().to_pydict()
    order = sorted(range(len(got["id"])), key=lambda i: (got["id"][i], got["label"][i], got["a"][i], got["b"][i]))
    y = np.array([got["label"][i] for i in order], np.int64)
    a, b = (np.array([got[c][i] for i in order]).reshape(len(y), n) for c, n in (("a", len(CONTENT) + HASHED), ("b", len(META))))
    has = y >= 0
    return co_train(a[has], b[has], (y[has] == 1).astype(float), a[~has], b[~has], **options)


SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("score", "content_score", "metadata_score")])


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """One row per row of ``docs``: id, held_out (the id's row isn't learned from), score (0 to 1), content_score,
    metadata_score, predicted (1 for good), keep (the same as a boolean).

    Every whole text is scored, very long ones too. Null texts are empty; null metadata (lang, source, n_chars) has a value
    of its own, as has metadata whose column isn't there. Rows are on their own: equal rows have equal scores. Other
    columns are ignored. Empty tables give empty results.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **options)

    def make(cols: dict[str, pa.Array]) -> list[pa.Array]:
        a, b = _views(*(cols[c].to_pylist() for c in COLUMNS))
        return [pa.array(s, pa.float64()) for s in model.score(a, b)]

    rows = add_columns(_named(docs, id_col, text_col), SCORES, make, list(COLUMNS))
    return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), *SCORES.names, (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= threshold).alias("keep"))
