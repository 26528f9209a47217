"""Importance resampling against a plain loop."""

import hashlib
import math
import re
import zlib

import pyarrow as pa
import pytest

from scribelake.llm import resampling
from tests.llm import data

TOKEN = re.compile(resampling.TOKEN)


def grams(text, least, most):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = TOKEN.findall(lower)
    return words, [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, least=1, most=1, buckets=10_000, percent=10, least_words=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    cut = [grams(text, least, most) for _, text, *_ in docs]
    for _, found in cut:
        for g in found:
            s[bucket(g)] += 1
    for text in target:
        for g in grams(text, least, most)[1]:
            t[bucket(g)] += 1
    total_s, total_t = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for (i, *_), (words, found) in zip(docs, cut, strict=True):
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in found)
        rows.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(fit) * percent // 100
    rank = {id(r): k + 1 for k, r in enumerate(fit[:drawn])}
    return [(*r, rank.get(id(r))) for r in rows]


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("options", [{}, {"least": 1, "most": 2, "buckets": 97, "percent": 40}, {"least": 2, "most": 3, "least_words": 1, "percent": 100}])
def test_same_as_a_plain_loop(spark, options):
    docs = data.awkward()
    target = [data.words(5, 40), None, "", data.words(34, 200), "日本語 a-b a_b A1b2"]
    got = resampling.resample(data.documents(spark, docs), spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id int, text string, rank string"), **options)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    # Rows equal in id and score have their ranks in any order among them.
    want = plain(docs, target, **options)
    assert sorted(((*r[:5], None) for r in map(tuple, got.collect())), key=key) == sorted(((*r[:5], None) for r in want), key=key)
    assert sorted(((r[0], r[4], r[5]) for r in map(tuple, got.collect()) if r[5]), key=key) == sorted(((r[0], r[4], r[5]) for r in want if r[5]), key=key)


def test_a_large_group_of_equal_rows(spark):
    """A third of the rows are equal in everything, null ids among them; each drawn row has a rank of its own."""
    docs = [data.row(None, data.words(1, 25))] * 300 + [data.row(7, data.words(1, 25))] * 100 + [data.row(k, data.words(k, 30)) for k in range(100, 700)]
    got = resampling.resample(data.documents(spark, docs, 9), spark.createDataFrame([(data.words(1, 300),)], "text string"), percent=70).collect()
    assert len(got) == 1000
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 701))
    scores = [r["score"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]
    assert scores == sorted(scores, reverse=True)


def test_long_text(spark):
    """A text longer than a block is counted whole."""
    docs = [data.row(1, data.words(1, 400_000)), *[data.row(k, data.words(k, 30)) for k in range(2, 40)]]
    assert len(docs[0][1]) > resampling.BLOCK / 4
    got = resampling.resample(data.documents(spark, docs), spark.createDataFrame([(data.words(3, 30),)], "text string"))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(docs, [data.words(3, 30)]), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(data.documents(spark, []), none).collect() == []
    docs = data.awkward()[:12]
    assert sorted(map(tuple, resampling.resample(data.documents(spark, docs), none).collect()), key=key) == sorted(plain(docs, []), key=key)


def test_blocks():
    cuts = lambda sizes, most: list(resampling.blocks(pa.array(["x" * n for n in sizes], pa.string()), most))
    assert cuts([1, 2, 3], 10) == [(0, 3)]
    assert cuts([5, 6, 20, 1], 10) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert cuts([], 10) == []


def test_the_spill_goes(spark, tmp_path):
    from scribelake.llm.common import shared_folder, spilled

    import os

    with spilled(spark.range(3), "gone") as rows:
        assert rows.count() == 3
        assert any(n.startswith("gone-") for n in os.listdir(shared_folder(spark).removeprefix("file:")))
    assert not any(n.startswith("gone-") for n in os.listdir(shared_folder(spark).removeprefix("file:")))
