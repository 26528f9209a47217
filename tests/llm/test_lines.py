"""Line labelling: counts against plain loops, the field against enumeration, verdicts against labels."""

import itertools
import os
import random

import numpy as np
import pytest

from scribelake.llm import lines
from tests.llm import data

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    t = text or ""
    words, seen, dup = t.encode().split(), set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows, covered = {}, set()
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            covered.update(i + k for i in places for k in range(3))
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def messy(seed):
    own = random.Random(seed)
    words = ["a", "b", "a b", "the", "x%", "|", "é", "日本", " ", " ", "C!", "<i>"]
    return "".join(own.choice(words) + own.choice([" ", " ", "\n", "\t", "\r", "\x0b", "  ", "\n\n"]) for _ in range(own.randrange(0, 60)))


def test_counts_are_those_of_plain_loops():
    texts = [messy(k) for k in range(300)] + ["", "\n", " \n a", "a", "a a a a", "a b c\na b c\n a b c"]
    m = lines.measure([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(getattr(m, c)[i]) for c in lines.COUNTS) == plain_counts(t), repr(t)
    held = [(i, line) for i, t in enumerate(texts) for line in t.split("\n") if line.encode().split()]
    assert m.owner.tolist() == [i for i, _ in held]
    assert m.line_words.tolist() == [len(line.encode().split()) for _, line in held]


def test_features_dont_depend_on_the_block():
    texts = [messy(k).encode() for k in range(40)]
    together = lines.measure(texts)
    alone = [lines.measure([t]).features for t in texts]
    np.testing.assert_allclose(together.features, np.vstack(alone), rtol=1e-12)


def chain_score(field, own, labels):
    return sum(own[i] * y for i, y in enumerate(labels)) + sum(field.moves[a, b] for a, b in itertools.pairwise(labels))


def a_field(rng, k=3):
    return lines.Field(np.zeros(k), np.ones(k), rng.normal(size=k + 1), rng.normal(size=(2, 2)))


def test_viterbi_and_expectations_by_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(20):
        field, sizes = a_field(rng), rng.integers(1, 7, size=5)
        owner = np.repeat(np.arange(5) * 3, sizes)
        x = rng.normal(size=(len(owner), 3))
        own, got = field.own(x), lines.viterbi(field, x, owner)
        total, p, moves = lines._expected(field, own, lines.Chains(owner))
        want_total, want_p, want_moves = 0.0, np.zeros(len(owner)), np.zeros((2, 2))
        for o in np.unique(owner):
            at = np.flatnonzero(owner == o)
            ways = list(itertools.product((0, 1), repeat=len(at)))
            scores = np.array([chain_score(field, own[at], w) for w in ways])
            assert tuple(got[at].astype(int)) == ways[int(scores.argmax())]
            z = np.logaddexp.reduce(scores)
            want_total += z
            for w, s in zip(ways, np.exp(scores - z), strict=True):
                want_p[at] += s * np.array(w)
                for a, b in itertools.pairwise(w):
                    want_moves[a, b] += s
        np.testing.assert_allclose([total, *p, *moves.ravel()], [want_total, *want_p, *want_moves.ravel()], rtol=1e-9)


def test_ties_are_content():
    field = lines.Field(np.zeros(1), np.ones(1), np.zeros(2), np.zeros((2, 2)))
    assert lines.viterbi(field, np.zeros((4, 1)), np.array([0, 0, 0, 1])).all()


def test_a_chain_learns_from_its_neighbours():
    """Lines whose own sign is missing are marked as those around them are."""
    rng = np.random.default_rng(2)
    owner = np.repeat(np.arange(200), 10)
    label = np.repeat(rng.integers(0, 2, 400), 5).astype(bool)
    shown = rng.random(2000) < 0.6
    x = np.where(shown, np.where(label, 1.0, -1.0), 0.0)[:, None]
    field = lines.fit_field(x, owner, label)
    assert field.moves[1, 1] > field.moves[1, 0] and field.moves[0, 0] > field.moves[0, 1]
    hidden = ~shown
    assert (lines.viterbi(field, x, owner) == label)[hidden].mean() > 0.85


def test_bad_texts_teach_which_of_their_lines_are_bad():
    rng = np.random.default_rng(3)
    owner, good = np.repeat(np.arange(120), 6), np.repeat(np.arange(120) % 2 == 0, 6)
    junk = ~good & (np.tile(np.arange(6), 120) > 2)
    x = np.where(junk, 2.0, 0.0)[:, None] + rng.normal(0, 0.3, (720, 1))
    field = lines.teach(x, owner, good)
    assert (lines.viterbi(field, x, owner) == ~junk).mean() > 0.97
    assert lines.teach(x, owner, np.ones(720, bool)) is None


def test_awkward_rows(spark):
    docs = data.awkward() + [data.row(70 + k, "\n".join(data.words(70 + k * 9 + j, 12) + "." for j in range(6))) for k in range(30)] + [data.row(200 + k, "\n".join("% ".join(data.words(k * 9 + j, 12).split()) for j in range(6))) for k in range(30)]
    labels = data.labels(spark, [(70 + k, 1, 0) for k in range(30)] + [(200 + k, 0, 0) for k in range(30)] + [(None, 1, 1), (71, None, 0), (999, 1, 0)])
    got = lines.judge(data.documents(spark, docs), labels).collect()
    assert len(got) == len(docs)
    own = lambda r: tuple((v is None, v) for v in r)
    assert sorted((own((r["doc_id"], *(r[c] for c in lines.COUNTS))) for r in got)) == sorted(own((i, *plain_counts(t))) for i, t, *_ in docs)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
        assert r["kept"] == (not r["base_failed"] and r["content_share"] >= 0.5)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[70 + k] for k in range(30)) and not any(kept[200 + k] for k in range(30))
    same = [tuple(r)[2:] for r in got if r["doc_id"] == 40]
    assert len(same) == 2 and same[0] == same[1]


def test_no_labels_and_empty_tables(spark):
    got = lines.judge(data.documents(spark), data.labels(spark, [])).collect()
    assert all(r["content_share"] == (1.0 if r["n_words"] else 0.0) for r in got)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert lines.judge(data.documents(spark, []), data.labels(spark, [(1, 1, 0)])).collect() == []


def test_very_long_texts(spark):
    """Hundreds of thousands of words, in one line and in many, marked whole."""
    many, one = "\n".join(data.words(k, 12) for k in range(20_000)), data.words(5, 300_000)
    rng = np.random.default_rng(4)
    field = lines.Field(np.zeros(len(lines.FEATURES)), np.ones(len(lines.FEATURES)), rng.normal(size=len(lines.FEATURES) + 1), np.eye(2))
    got = {r["doc_id"]: r for r in lines.with_verdict(data.documents(spark, [data.row(1, many), data.row(2, one), data.row(3, None)]), field).collect()}
    assert (got[1]["n_lines"], got[2]["n_lines"], got[3]["n_lines"]) == (20_000, 1, 0)
    assert got[2]["n_words"] == 300_000
    m = lines.measure([many.encode()])
    assert got[1]["n_content_lines"] == int(lines.viterbi(field, m.features, m.owner).sum())


def test_marked_lines_are_the_content(spark):
    field = lines.Field(np.zeros(len(lines.FEATURES)), np.ones(len(lines.FEATURES)), np.zeros(len(lines.FEATURES) + 1), np.zeros((2, 2)))
    field.weight[lines.FEATURES.index("symbols")] = -100.0
    field.weight[-1] = 1.0
    got = lines.mark_lines(data.documents(spark, [data.row(1, "a b\n\n% %\nc"), data.row(2, None)]), field).collect()
    assert {r["doc_id"]: r["content"] for r in got} == {1: "a b\nc", 2: ""}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_held_out_labels(spark):
    """Documents whose labels weren't learned: what is marked bad is bad, and good ones fail by the base rules alone."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = lines.judge(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert not [r for r in rows if r["quality"] == 0 and r["kept"]]
    assert not [r for r in rows if r["quality"] == 1 and not r["kept"] and not r["base_failed"]]
