import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from scribelake.llm import shingles
from tests.llm.data import SCHEMA, awkward, documents, row, words


def plain_set(text):
    found = (text or "").encode().lower().split()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def plain_kept(rows):
    """(id, set) of the row to stay of each group, over all pairs."""
    sets = sorted({plain_set(r[1]) for r in rows}, key=sorted)
    part = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    group = dict(zip(sets, part, strict=True))
    least = {}
    for r in rows:
        g = group[plain_set(r[1])]
        least[g] = min(least.get(g, r[0]), r[0])
    return Counter(least.values())


def near_copies():
    own, rows = random.Random(3), []
    for g in range(8):
        base = words(g, 150).split()
        for i in range(12):
            text = list(base)
            for at in own.sample(range(150), own.randint(0, 5)):
                text[at] = f"w{own.random()}"
            rows.append(row(1000 + g * 100 + i, " ".join(text)))
    return rows


def test_stage_keeps_one_of_each_group_at_four_fifths(spark):
    rows = near_copies()
    docs = documents(spark, rows)
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in got) == plain_kept(rows)


def test_awkward_and_empty_tables(spark):
    rows = [r for r in awkward() if r[0] is not None]
    docs = documents(spark, awkward())
    kept = shingles.keep_one_similar(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sum(r["doc_id"] is None for r in got) == sum(r[0] is None for r in awkward())
    assert set(plain_kept(rows)) <= {r["doc_id"] for r in got}
    assert shingles.keep_one_similar(spark.createDataFrame([], SCHEMA)).count() == 0


def test_families_of_many_blocks_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(shingles, "ROOM", 3000)
    monkeypatch.setattr(shingles, "EACH", 400)
    monkeypatch.setattr(shingles, "BROADCAST_MEMBERS", 0)
    rows = near_copies()
    got = shingles.keep_one_similar(documents(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in got) == plain_kept(rows)


@pytest.mark.parametrize("small,dense", [(256, 32), (0, 32), (0, 5)])
def test_similar_like_plain_sets(monkeypatch, small, dense):
    monkeypatch.setattr(shingles, "SMALL", small)
    monkeypatch.setattr(shingles, "DENSE", dense)
    own = random.Random(4)
    base = list(range(60))
    sets = [np.unique(np.array([x if own.random() > 0.06 else own.randrange(1000) for x in base], np.uint64)) for _ in range(80)]
    sets += [np.arange(5, dtype=np.uint64), np.arange(4, dtype=np.uint64), np.array([7], np.uint64)]
    plain = [set(s.tolist()) for s in sets]
    want = np.array([[len(a & b) >= 0.8 * len(a | b) for b in plain] for a in plain])
    assert (shingles.similar(sets) == want).all() and want[80, 81]
    assert (shingles.similar(sets[80:82]) == want[80:82, 80:82]).all()
    part = list(range(len(sets)))
    for i, j in shingles.forest(want):
        old, new = part[j], part[i]
        part = [new if p == old else p for p in part]
    assert all((part[i] == part[j]) or not want[i, j] for i in range(len(sets)) for j in range(i))


def test_simhash_balls_link_what_min_hashes_miss(spark, monkeypatch):
    """Without points of min-hashes, pairs within two bits are found by SimHash alone, and verified; the others are not."""
    monkeypatch.setattr(shingles, "points", lambda hashes: np.zeros(0, np.int64))
    base = [words(g, 600).split() for g in range(20)]
    rows = [row(100 * g + i, " ".join(text[:-i] if i else text)) for g, text in enumerate(base) for i in (0, 1, 2, 300)]
    prints = {r[0]: shingles.majority(shingles.shingle_set(r[1].encode())) for r in rows}
    near = {g for g in range(20) if (prints[100 * g] ^ prints[100 * g + 1]).bit_count() <= 2 and (prints[100 * g + 1] ^ prints[100 * g + 2]).bit_count() <= 2}
    assert len(near) > 10
    kept = {r["doc_id"] for r in shingles.keep_one_similar(documents(spark, rows)).collect()}
    assert all(not kept & {100 * g + 1, 100 * g + 2} for g in near)
    assert kept >= {100 * g + i for g in range(20) for i in (0, 300)}
