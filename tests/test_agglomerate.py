"""Clustering in rounds and blocks against merging one pair at a time."""

import numpy as np
import pytest

from scribelake.operators.agglomerate import all_merges, cluster_turns, cut, nearest_partners
from scribelake.operators.speakers import cluster


def voices(n, speakers, dims, noise, seed):
    rng = np.random.default_rng(seed)
    own = rng.normal(size=(speakers, dims))
    v = own[rng.integers(speakers, size=n)] + rng.normal(0, noise, (n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("speakers,noise,threshold,most", [(3, 0.3, 0.5, 8), (12, 0.3, 0.5, 8), (5, 3.0, 0.5, 8), (6, 0.8, 0.9, 4), (4, 0.2, -1.0, 8)])
def test_notes_cut_like_one_pair_at_a_time(speakers, noise, threshold, most):
    v = voices(150, speakers, 12, noise, speakers)
    ids = np.arange(150) * 3 + 7
    merges = [(a, b, h, i) for i, (a, b, h) in enumerate(all_merges(ids, v, np.ones(150)))]
    assert cut(ids, merges, threshold, most).tolist() == cluster(v, threshold, most).tolist()


def test_partners_by_blocks(spark):
    rng = np.random.default_rng(2)
    sums = {k: rng.normal(size=(n, 6)) for k, n in (("a", 90), ("b", 7), ("c", 1))}
    sizes = {k: rng.integers(1, 9, len(v)) for k, v in sums.items()}
    rows = [(k, i * 2, v.tolist(), int(sizes[k][i])) for k, m in sums.items() for i, v in enumerate(m)]
    got = {(r["rec"], r["id"]): r for r in nearest_partners(spark.createDataFrame(rows, "rec string, id long, v array<double>, n long"), "rec", block=20).collect()}
    assert ("c", 0) not in got and len(got) == 97
    for k in "ab":
        unit = sums[k] / sizes[k][:, None]
        mean = unit @ unit.T
        np.fill_diagonal(mean, -np.inf)
        for i in range(len(mean)):
            assert got[k, 2 * i]["partner"] == 2 * int(mean[i].argmax()) and got[k, 2 * i]["mean"] == pytest.approx(mean[i].max())


def test_rounds_give_the_clusters_of_one_task(spark):
    """A recording of speakers, one of noise that has to be merged below the threshold, and two that are small."""
    sound = {"speakers": voices(700, 6, 16, 0.25, 1), "noise": voices(400, 3, 10, 5.0, 2), "small": voices(60, 3, 16, 0.3, 3), "one": voices(1, 1, 16, 0.1, 4)}
    rows = [(k, i * 5, x.tolist()) for k, v in sound.items() for i, x in enumerate(v)]
    table = spark.createDataFrame(rows, "rec string, id long, v array<double>").repartition(6)
    got = {}
    for r in cluster_turns(table, "rec", local=300, block=128).collect():
        got.setdefault(r["rec"], {})[r["id"]] = r["label"]
    for k, v in sound.items():
        assert [got[k][i * 5] for i in range(len(v))] == cluster(v).tolist(), k


def test_equal_vectors_and_no_vectors(spark):
    one = voices(1, 1, 8, 0, 5)[0]
    rows = [("r", i, (one if i % 3 else -one).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "rec string, id long, v array<double>")
    labels = {r["id"]: r["label"] for r in cluster_turns(table, "rec", local=100, block=40).collect()}
    assert labels == {i: int(i % 3 > 0) for i in range(120)}
    assert cluster_turns(table.limit(0), "rec").collect() == []
