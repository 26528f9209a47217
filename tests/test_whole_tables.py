"""Queries without SQL over whole tables, against plain loops."""

import hashlib
import os
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from scribelake.plans.queries import QUERIES
from tests.test_signal import plain_chunks, plain_cluster

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_repeats_like_the_pattern_engine_of_another_language(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    loop = re.compile(r"(.{1,30}?)(?:\s*\1){4,}")
    want = {r["doc_id"]: hashlib.sha256(loop.sub(r"\1", r["text"]).strip().encode()).hexdigest() for r in rows}
    assert {r["doc_id"]: r["collapsed"] for r in QUERIES["x4_collapse_repeats"](spark, SF).collect()} == want


def test_chunks_of_every_recording(spark):
    rows = sorted(pq.read_table(f"{SF}/events.parquet", columns=["user_id", "ts", "event_id", "value"]).to_pylist(), key=lambda r: (r["ts"], r["event_id"]))
    energy, want = defaultdict(list), []
    for r in rows:
        energy[r["user_id"]].append(r["value"] * r["value"])
    for k, blocks in energy.items():
        sums, end = np.repeat(np.array(blocks) * 160, 20), len(blocks) * 3200
        for i, start in enumerate(range(0, end, 960_000)):
            want += [(k, i, a, b) for a, b in plain_chunks(sums, start, min(end, start + 960_000))]
    got = [(r["recording_id"], r["label"], r["start"], r["end"]) for r in QUERIES["w5_chunks"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_clusters_of_every_vector(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    own, got = defaultdict(list), defaultdict(lambda: defaultdict(set))
    for r in sorted(rows, key=lambda r: r["vec_id"]):
        v = np.array(r["embedding"], np.float64)
        own[r["vec_id"] // 20].append((r["vec_id"], v / np.linalg.norm(v)))
    for r in QUERIES["u5_cluster"](spark, SF).collect():
        got[r["recording"]][r["speaker"]].add(r["vec_id"])
    for k, vectors in own.items():
        want = {frozenset(vectors[i][0] for i in g) for g in plain_cluster(np.array([v for _, v in vectors]))}
        assert set(map(frozenset, got[k].values())) == want
