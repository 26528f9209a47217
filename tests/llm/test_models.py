"""The classifiers and the language model: parts against plain loops, wholes by held-out results."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from scribelake.llm import boosting, lattice, quality, toxicity
from scribelake.llm.common import documents as table
from tests.llm.data import SCHEMA, awkward, documents, labels, row, words

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.1"
RECALL = 0.9


# ---- lattice ---------------------------------------------------------------------------------------------------------
def test_marginals_like_plain_sums():
    own = random.Random(2)
    pieces = tuple({bytes(own.choices(b" abc", k=own.randint(1, 4))) for _ in range(40)} | {bytes([i]) for i in range(256)})
    p = np.array([own.random() for _ in pieces])
    p /= p.sum()
    made = lattice.Lattice(pieces, p, 0.3)
    chance = dict(zip(pieces, p))

    def paths(word):
        """(probability, pieces) of every segmentation."""
        if not word:
            yield 1.0, ()
        for n in range(1, len(word) + 1):
            if word[:n] in chance:
                for q, rest in paths(word[n:]):
                    yield chance[word[:n]] * 0.7 * q, (word[:n], *rest)

    found = [b" abcabca", b" a", b"c", b" bbbbbbbbb", b" \x00\xff"]
    assert np.allclose(made.score(found), [math.log(0.3 / 0.7 * sum(q for q, _ in paths(w))) for w in found])
    want, last = Counter(), Counter()
    for w in found:
        ways = list(paths(w))
        for q, used in ways:
            last[used[-1]] += q / sum(x for x, _ in ways)
            for piece in used:
                want[piece] += q / sum(x for x, _ in ways)
    assert np.allclose(made.expected(found), [[want[x] for x in pieces], [last[x] for x in pieces]])
    stops = np.array([own.uniform(0.1, 0.9) for _ in pieces])
    each = dict(zip(pieces, stops))
    several = [sum(q / 0.7 ** len(u) * math.prod(1 - each[x] for x in u[:-1]) * each[u[-1]] for q, u in paths(w)) for w in found]
    assert np.allclose(np.exp(lattice.Lattice(pieces, p, stops).score(found)), several, atol=0)
    assert np.isfinite(made.score([b" " + b"x" * 30_000]))[0]


def test_probabilities_of_words_sum_to_at_most_one():
    pieces = tuple(bytes([b]) for b in b" ab") + (b" a", b"ab")
    model = lattice.WordModel(pieces, np.array([0.5, 0.4, 0.3, 0.5, 0.3]), np.array([0.4, 0.2, 0.5, 0.3, 0.9]), 100, 10, 3, 0.5)
    every, layer = [], [b""]
    for _ in range(12):
        layer = [w + c for w in layer for c in (b"a", b"b")]
        every += layer
    counts = {b"a": 60, b"ab": 30, b"b": 10}
    total = (10 ** model.log10(every, np.array([counts.get(w, 0) for w in every]))[0]).sum() + model.end
    assert 0.9 < total <= 1 + 1e-9


def test_scores_like_a_plain_count(spark):
    rows = awkward() + [row(i, words(i, 40)) for i in range(100, 180)]
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    counts = Counter(w for r in train for w in lattice.tokens(r[1]))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    want = Counter()
    for r in rows:
        found = lattice.tokens(r[1])
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in found) + math.log10((len(train) + 1) / (n + v + 1))
        want[r[0], r not in train, len(found) + 1, sum(w in counts for w in found) + 1, n, round(base, 6)] += 1
    for hot in (200_000, 5):  # nearly all words looked up, nearly all shuffled
        lattice.HOT, before = hot, lattice.HOT
        try:
            got = lattice.score_texts(documents(spark, rows), PIECES, rounds=1).collect()
        finally:
            lattice.HOT = before
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 for r in got)
    assert lattice.score_texts(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def test_scores_like_a_plain_sum_over_segmentations(spark, monkeypatch):
    made = []
    monkeypatch.setattr(lattice, "fit", lambda *a, fit=lattice.fit, **k: made.append(fit(*a, **k)) or made[-1])
    rows = awkward() + [row(i, words(i, 40)) for i in range(100, 160)] + [row(200, "zq#x " + "w" * 200), row(201, "the " * 5000)]
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    counts = Counter(w for r in train for w in lattice.tokens(r[1]))
    for hot in (200_000, 3):
        monkeypatch.setattr(lattice, "HOT", hot)
        got = lattice.score_texts(documents(spark, rows), PIECES, rounds=1).collect()
        model = made[-1]
        chance, stop = dict(zip(model.pieces, model.probability)), dict(zip(model.pieces, np.broadcast_to(model.stop, len(model.pieces))))
        n, v = sum(counts.values()), len(counts)
        assert (model.words, model.kinds, model.ends) == (n, v, len(train))

        def alone(word, seen={}):  # noqa: B006
            """By a table of reached places, with plain products."""
            if (word, id(model)) not in seen:
                mass, ended = [1.0] + [0.0] * len(word), 0.0
                for i in range(len(word)):
                    for m in range(1, min(len(word) - i, max(map(len, chance))) + 1):
                        if (piece := word[i : i + m]) in chance:
                            if i + m == len(word):
                                ended += mass[i] * chance[piece] * stop[piece]
                            else:
                                mass[i + m] += mass[i] * chance[piece] * (1 - stop[piece])
                seen[word, id(model)] = ended
            return seen[word, id(model)]

        want = Counter()
        for r in rows:
            score = pure = math.log10(model.end)
            for w in lattice.tokens(r[1]):
                if len(w) > 150:  # a plain product would be zero
                    break
                pure += math.log10((1 - model.end) * alone(b" " + w))
                score += math.log10((1 - model.end) * (max(counts[w] - model.discount, 0) / n + model.discount * v / n * alone(b" " + w)))
            else:
                want[r[0], round(score, 4), round(pure, 4)] += 1
        assert not want - Counter((r["doc_id"], round(r["score"], 4), round(r["lattice_score"], 4)) for r in got)


def test_no_piece_of_the_vocabulary_is_left_out():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    real = {model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    pieces = lattice.Pieces.read(PIECES).pieces
    assert real <= set(pieces)
    longest = max(pieces, key=len)
    one = lattice.Lattice(pieces, np.where([p == longest for p in pieces], 0.5, 1e-9), 0.5)
    assert len(longest) > 16 and one.score([longest])[0] == pytest.approx(math.log(0.25), abs=1e-3)


def test_unlikely_words_cost_more(spark):
    rows = [row(i, "the then the other there " * 3) for i in range(60)] + [row(1000, "the then"), row(1001, "the zq#x"), row(1002, "the thenthere")]
    score = {r["doc_id"]: r["score"] for r in lattice.score_texts(documents(spark, rows), PIECES).collect()}
    assert score[1000] > score[1002] > score[1001]


# ---- trees and calibration -------------------------------------------------------------------------------------------
def test_trees_and_isotonic():
    own = np.random.default_rng(0)
    x = own.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (own.random(3000) < 0.05)).astype(float)
    margin = boosting.out_of_fold(lambda fold: x, y, np.arange(3000) % 3)
    assert ((margin > 0) == y).mean() > 0.93
    curve = boosting.fit_isotonic(margin, y)
    p = curve(margin)
    assert (np.diff(curve.value) >= 0).all() and abs(p.mean() - y.mean()) < 0.02 and ((p - y) ** 2).mean() < 0.07
    for m, v in ((np.zeros(0), np.zeros(0)), (np.zeros(5), np.ones(5))):
        assert np.isfinite(boosting.fit_isotonic(m, v)(np.zeros(2))).all()
    assert np.isfinite(boosting.fit_trees(np.zeros((0, 4)), np.zeros(0)).margin(x)).all()


def plain_boosting(x, y, trees, depth, rate, bins, l2, least):
    """Row by row: each node takes the cut, among quantiles, that gains most."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    margin = np.full(len(y), math.log(share / (1 - share)))
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    worth = lambda g, h: g * g / (h + l2)

    def grow(rows, p, level):
        g, h = p - y, p * (1 - p)
        total = sum(g[rows]), sum(h[rows])
        best = (1e-9, None, None)
        for j in range(x.shape[1]) if level < depth else ():
            for c in cuts[j]:
                left, right = [r for r in rows if x[r, j] <= c], [r for r in rows if x[r, j] > c]
                if len(left) >= least and len(right) >= least:
                    gain = worth(sum(g[left]), sum(h[left])) + worth(sum(g[right]), sum(h[right])) - worth(*total)
                    if gain > best[0] + 1e-12:
                        best = (gain, left, right)
        if best[1] is None:
            return [(rows, -rate * total[0] / (total[1] + l2))]
        return grow(best[1], p, level + 1) + grow(best[2], p, level + 1)

    for _ in range(trees):
        for rows, leaf in grow(list(range(len(y))), 1 / (1 + np.exp(-margin)), 0):
            margin[rows] += leaf
    return margin


def test_trees_like_plain_loops():
    own = np.random.default_rng(4)
    x = np.round(own.normal(size=(90, 3)), 1)
    y = ((x[:, 0] + 0.5 * x[:, 2] > 0.2) ^ (own.random(90) < 0.1)).astype(float)
    options = dict(trees=6, depth=3, rate=0.3, bins=9, l2=1.0, least=5.0)
    assert np.allclose(boosting.fit_trees(x, y, **options).margin(x), plain_boosting(x, y, **options))


def test_isotonic_like_the_minmax_formula():
    own = np.random.default_rng(5)
    margin = own.permutation(60) / 10
    y = (own.random(60) < margin / 6).astype(float)
    order = np.argsort(margin)
    m, v = margin[order], y[order]
    level = [max(min(v[j : k + 1].mean() for k in range(i, 60)) for j in range(i + 1)) for i in range(60)]
    blocks = [np.flatnonzero(np.isclose(level, x)) for x in sorted(set(np.round(level, 9)))]
    curve = boosting.fit_isotonic(margin, y)
    assert np.allclose(curve.at, [m[b].mean() for b in blocks])
    assert np.allclose(curve.value, np.maximum.accumulate([(v[b].sum() + y.mean()) / (len(b) + 1) for b in blocks]))


def plain_features(text, learned):
    """One by one, as the names say."""
    low, out = text.lower(), {}
    found = re.findall(r"[^\W\d_]+", low)
    n = max(1, len(found))
    known = [w in toxicity.LEXICON for w in found]
    own = [("=" + w in learned) or any(w[:k] in learned for k in range(3, 8)) for w in found]
    person = [i for i, w in enumerate(found) if w in toxicity.SECOND_PERSON]
    marked = [i for i in range(len(found)) if known[i] or own[i]]
    data = text.encode()
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    mixed = re.findall(r"(?<![\w@$*!|+])[^\W\d_]*[0-9@$*!|+]+[^\W\d_][\w@$*!|+]*", low)
    starred = {w[:i] + "*" + w[i + 1 :] for w in toxicity.LEXICON for i in range(1, len(w))}
    size, upper = max(1, len(data)), sum(65 <= b <= 90 for b in data)
    letters = max(1, upper + sum(97 <= b <= 122 for b in data))
    out = dict(words=math.log1p(len(found)), lexicon_density=sum(known) / n, lexicon_hits=math.log1p(sum(known)), kinds=len({found[i] for i in marked}), learned_density=sum(own) / n, learned_hits=math.log1p(sum(own)))
    out |= dict(second_person=len(person) / n, proximity=max((1 / (1 + abs(i - j)) for i in marked for j in person), default=0), capitals=upper / letters, shouted=upper > letters / 2, exclaims=data.count(b"!") / size)
    out |= dict(punctuation=sum(33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in data) / size, digits=sum(48 <= b < 58 for b in data) / size, obfuscated=len(mixed) / n)
    out |= dict(disguised_hits=sum((p := w.translate(toxicity.LOOK_ALIKES)) in toxicity.LEXICON or p in starred for w in mixed), runs=sum(a == b == c and letter(b) and letter(c) for a, b, c in zip(data, data[1:], data[2:])) / n)
    return [float(out[k]) for k in toxicity.NAMES]


def test_toxic_features():
    sets = frozenset({"=glorp", "zzt"}), frozenset({"wea"}), frozenset()
    codes = toxicity.WordCodes(*sets)
    f = lambda t: dict(zip(toxicity.NAMES, toxicity.features(t, codes)[0]))
    clean, rude = f("The weather is fine today."), f("You are an IDIOT, glorp zztar!! st*pid 1d10t")
    assert clean["lexicon_hits"] == clean["learned_hits"] == clean["proximity"] == 0
    assert rude["kinds"] == 3 and rude["proximity"] == 0.25 and rude["disguised_hits"] >= 1 and rude["obfuscated"] > 0 and rude["second_person"] > 0
    assert not any(sum(toxicity.features("", codes), []))
    texts = [r[1] or "" for r in awkward()] + ["You IDIOT!!! Glorp, 1d10t st*pid. tú zztop weather", "sooo baaad DU DUMMKOPF $hit x@y 4ever", "THE END " * 9000]
    for text in texts:
        for own, got in zip(sets, toxicity.features(text, codes)):
            assert np.allclose(got, plain_features(text, own)), text[:40]


def test_stems_of_a_part_are_learned_without_it(spark):
    rows = [(i, ("grumble" if i < 40 else "plain") + f" w{i}", int(i < 40), i % 2) for i in range(200)]
    rows += [(900 + i, "secretword x", 1, 1) for i in range(20)]  # of part 1 alone
    sample = spark.createDataFrame(rows, "id long, text string, label int, part int")
    every, without0, without1 = toxicity._learned(sample, 2, 0.02, 5, 8.0, 1000)
    assert "=grumble" in every & without0 & without1 and "=secretword" in every & without0 and "=secretword" not in without1
    assert len(toxicity._learned(sample, 2, 0.02, 5, 8.0, 3)[0]) == 3


def test_toxicity_on_awkward_tables(spark):
    docs = documents(spark)
    for known in ([], [(1, 1, 0)], [(1, 1, None), (None, 1, 1), (2, None, 1), (2, 1, 0), (3, 1, 0), (999, 0, 1)]):
        got = toxicity.score_toxicity(docs, labels(spark, known)).collect()
        assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
        assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in got)
    assert toxicity.score_toxicity(spark.createDataFrame([], SCHEMA), labels(spark, [])).count() == 0
    kept = toxicity.drop_toxic(docs, labels(spark, []))
    assert kept.columns == docs.columns and kept.count() == len(awkward())


def plain_co_training_data():
    own = np.random.default_rng(3)
    y = (own.random(3000) < 0.7).astype(float)
    a, b = own.normal(size=(3000, 5)) + y[:, None] * [2, 0, 0, 0, 0], own.normal(size=(3000, 3)) + y[:, None] * [0, 2, 0]
    return a, b, y


def test_word_shapes_count_every_word():
    text = " ".join(["aaa", "bbb"] * 1200 + ["last"])  # a stride of 2 or more would miss one of the two words
    want = np.zeros(quality.HASHED)
    for w in text.split():
        want[xxhash.xxh32_intdigest(w[-3:]) % quality.HASHED] += 1 / 2401
    assert np.allclose(quality.content(text)[len(quality.CONTENT) :], want)


def plain_content(text):
    found, n = text.split(), len(text.split())
    if not n:
        return [0.0] * (len(quality.CONTENT) + quality.HASHED)
    seen = Counter(found)
    ends = Counter("fine" if w[-1].isalnum() or w[-1] == "," else w[-1] if w[-1] in "!." else "other" for w in found)
    out = [math.log1p(n), sum(map(len, found)) / n, sum(len(w) > 15 for w in found) / n, len(seen) / n, ends["other"] / n, ends["!"] / n, seen["|"] / n]
    out += [1 - len(seen) / n if n > 20 else 0.0, max(seen.values()) / n, ends["."] / n]
    shapes = Counter(xxhash.xxh32_intdigest(w[-3:]) % quality.HASHED for w in found)
    return out + [shapes[i] / n for i in range(quality.HASHED)]


def plain_metadata(text, lang, source, n_chars):
    out, raw = [0.0] * len(quality.META), text.encode()
    if raw:
        lines = [len(x.encode()) for x in text.split("\n")]
        full = [n for n in lines if n]
        share = lambda test: sum(map(test, raw)) / len(raw)
        out[:4] = math.log1p(len(full)), math.log1p(sum(full) / max(1, len(full))), math.log1p(max(lines)), 1 - len(full) / len(lines)
        out[4:8] = share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b < 58), share(lambda b: 33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127)
        out[8] = len(zlib.compress(raw, 1)) / len(raw)
    out[9], out[10] = math.log1p(n_chars or 0), float(n_chars is None)
    out[11 + xxhash.xxh32_intdigest(source or "") % quality.SOURCES] = 1.0
    out[11 + quality.SOURCES + xxhash.xxh32_intdigest(lang or "") % quality.LANGS] = 1.0
    return out


def test_views_like_plain_loops():
    for text in [r[1] or "" for r in awkward()] + ["A | b | c!\nDE!! x, y. z% " * 30, "end. " * 40_000]:
        assert np.allclose(quality.content(text), plain_content(text)), text[:40]
        for page in (("en", "src1", 100), (None, None, None)):
            assert np.allclose(quality.metadata(text, *page), plain_metadata(text, *page)), text[:40]


def test_logistic_and_platt_are_at_their_optimum():
    own = np.random.default_rng(7)
    x, y = own.normal(size=(300, 4)) * [1, 5, 0.1, 0] + [0, 3, 1, 2], (own.random(300) < 0.3).astype(float)
    view = quality.fit_logistic(x, y, l2=0.7)
    z = np.hstack([np.ones((300, 1)), (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)])
    p = 1 / (1 + np.exp(-z @ view.weight))
    assert np.allclose(z.T @ (p - y) + np.array([1e-3, 0.7, 0.7, 0.7, 0.7]) * view.weight, 0, atol=1e-4)
    margin = view.margin(x)
    slope, offset = quality.platt(margin, y)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    wrong = 1 / (1 + np.exp(-slope * margin - offset)) - target
    assert abs((wrong * margin).sum() + 2.0 * (slope - 1)) < 1e-4 and abs(wrong.sum() + 0.1 * offset) < 1e-4
    assert quality.platt(margin, np.ones(300)) == (1.0, 0.0)


def test_quality_scores_like_plain_sums(spark):
    docs, known = documents(spark, awkward() + [row(i, words(i, 30) if i % 2 else "| ! " * 30) for i in range(100, 200)]), labels(spark, [(i, i % 2, 0) for i in range(100, 200)])
    model = quality.fit(docs, known)
    want = Counter()
    for r in docs.collect():
        odds = []
        for view, x in zip(model.views, (plain_content(r["text"] or ""), plain_metadata(r["text"] or "", r["lang"], r["source"], r["n_chars"]))):
            m = view.weight[0] + sum(w * min(8, max(-8, (v - mean) / scale)) for w, v, mean, scale in zip(view.weight[1:], x, view.mean, view.scale))
            odds.append(view.calibration[0] * m + view.calibration[1])
        want[r["doc_id"], round(1 / (1 + math.exp(-max(-50, min(50, sum(odds) - model.prior)))), 6)] += 1
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in quality.score_quality(docs, known).collect()) == want
    bare = docs.select("doc_id", "text")
    assert quality.score_quality(bare, known).count() == docs.count()


def test_an_exchange_that_does_harm_is_undone():
    own = np.random.default_rng(11)
    y = (own.random(1200) < 0.8).astype(float)
    a, b = own.normal(size=(1200, 3)) + y[:, None] * [3, 0, 0], own.normal(size=(1200, 2))
    # In the pool, the sure ones of the good view are of one kind of the other view by accident.
    pool_a, pool_b = a[:600], np.where(a[:600, :1] > 3, 9.0, own.normal(size=(600, 1))) * [1, 0] + b[:600]
    loss = lambda m: -np.log(np.clip(np.where(y[900:] == 1, m.score(a[900:], b[900:])[0], 1 - m.score(a[900:], b[900:])[0]), 1e-9, 1)).mean()
    with_, without = (quality.co_train(a[600:900], b[600:900], y[600:900], pool_a, pool_b, rounds=r) for r in (5, 0))
    assert loss(with_) <= loss(without) + 0.01


def test_co_training_learns_from_unlabelled_rows():
    a, b, y = plain_co_training_data()
    model = quality.co_train(a[:60], b[:60], y[:60], a[60:2000], b[60:2000])
    both, one, two = model.score(a[2000:], b[2000:])
    right = lambda p: ((p > 0.5) == y[2000:]).mean()
    alone = quality.co_train(a[:60], b[:60], y[:60], a[:0], b[:0]).score(a[2000:], b[2000:])
    assert right(both) >= max(right(one), right(two)) - 0.005 and right(both) > 0.9 and right(both) >= right(alone[0]) - 0.01
    assert quality.co_train(a[:5], b[:5], np.ones(5), a[5:9], b[5:9]).views is None


def test_quality_on_awkward_tables(spark):
    docs = documents(spark)
    for known in ([], [(i, i % 2, 0) for i in range(1, 25)], [(1, None, 1), (None, 0, 0)]):
        got = quality.score_quality(docs, labels(spark, known)).collect()
        assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(spark.createDataFrame([], SCHEMA), labels(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_results(spark):
    docs, known = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r["doc_id"]: r for r in known.collect()}
    tox = [r for r in toxicity.score_toxicity(docs, known).collect() if r["held_out"] and r["doc_id"] in truth]
    found = [r["predicted"] for r in tox if truth[r["doc_id"]]["toxic"]]
    assert sum(r["predicted"] and not truth[r["doc_id"]]["toxic"] for r in tox) <= 1
    assert np.mean(found) >= RECALL and sum(found) >= 0.95 * sum(r["predicted"] for r in tox)
    good = [r for r in quality.score_quality(docs, known).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] for r in good if truth[r["doc_id"]]["quality"]]) > 0.97
    assert np.mean([r["predicted"] == truth[r["doc_id"]]["quality"] for r in good]) > 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_both_views_teach_on_the_drivers_tables(spark):
    """Pseudo-labels go both ways, change what content learns, and cost nothing on documents that aren't learned from."""
    docs, known = table(spark, SF, "documents"), table(spark, SF, "labels")
    with_, without = (quality.fit(docs, known, rounds=r) for r in (5, 0))
    assert with_.given and all(min(g) > 0 for g in with_.given) and not without.given
    assert not np.allclose(with_.views[0].weight, without.views[0].weight)
    assert not np.allclose(with_.views[1].weight, without.views[1].weight)
    truth = {r["doc_id"]: r["quality"] for r in known.collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    a, b = quality._views(*([r[c] for r in rows] for c in quality.COLUMNS))
    y = np.array([truth[r["doc_id"]] for r in rows])
    right = lambda m: [((p > 0.5) == y).mean() for p in m.score(a, b)]
    assert right(with_)[0] >= right(without)[0] and min(right(with_)) > 0.95


def test_very_long_texts_are_scored_whole(spark):
    """A text of half a million words, whose last ones are counted like its first."""
    long_ = words(1, 500_000)
    docs = documents(spark, [row(k, words(k, 40) if k % 2 else "| !! $$$ " * 20) for k in range(60)] + [row(900, long_), row(901, long_ + " stupid" * 50_000)])
    known = labels(spark, [(k, k % 2, int(k % 4 == 0)) for k in range(60)])
    for got in (quality.score_quality(docs, known).collect(), toxicity.score_toxicity(docs, known).collect()):
        assert len(got) == 62 and all(0 <= r["score"] <= 1 for r in got)
    a, b = quality.content(long_), quality.content(long_ + " stupid" * 50_000)
    assert np.expm1(a[0]) == pytest.approx(500_000) and np.expm1(b[0]) == pytest.approx(550_000)
