"""The pipeline's stages on one small corpus, and against what its operators say in plain Python."""

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers

from scribelake.llm import bpe
from tests.llm.data import CLASHING, awkward, documents, labels, row, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, folder):
    rows = [r[:5] for r in awkward() if r[0] is not None]
    rows += [row(i, words(i, 30) + (" you stupid worthless idiot" if i % 6 == 0 else ""), f"src{i % 5}")[:5] for i in range(100, 340)]
    rows += [row(i, words(100 + i % 3, 60) + " card 4111111111111111")[:5] for i in range(400, 430)]
    documents(spark).select(*COLUMNS).limit(0).union(spark.createDataFrame(rows, documents(spark).select(*COLUMNS).schema)).write.parquet(f"{folder}/documents.parquet")
    labels(spark, [(i, 1, int(i % 6 == 0)) for i in range(100, 340)]).write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(spark, str(tmp_path))
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == COLUMNS
    ids = {k: {r["doc_id"] for r in v} for k, v in seen.items()}
    toxic = {i for i in range(100, 340) if i % 6 == 0}
    assert not ids["toxicity"] & toxic and ids["toxicity"] | toxic == {r[0] for r in rows}
    assert len(ids["simhash"] & set(range(400, 430))) == 3 and ids["pii"] == ids["simhash"]
    texts = {r["doc_id"]: r["text"] for r in seen["pii"]}
    before = {r["doc_id"]: r["text"] for r in seen["simhash"]}
    assert all(("4111111111111111" in t) is False for t in texts.values() if t) and all(texts[i] == before[i] for i in texts if i < 400)
    assert max(Counter((r["doc_id"], r["text"]) for r in seen["mixing"]).values()) <= 3 and ids["mixing"] <= ids["pii"]
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], len(vocabulary.encode(r["text"] or "")), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in seen["mixing"])
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in seen["bpe"]) == want
    again = Counter(corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert again - Counter(seen["bpe"]) == Counter() == Counter(seen["bpe"]) - again


def test_stages_on_an_empty_table(spark, tmp_path):
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    none = documents(spark).select(*COLUMNS).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "bpe" or out.columns == COLUMNS)


def test_stages_with_null_ids_and_clashing_columns(spark, tmp_path):
    """Every stage on tables with null ids, rows equal in all, and extra columns that have the operators' own names."""
    rows = awkward() + [row(i, words(i, 30) + (" you stupid worthless idiot" if i % 6 == 0 else ""), f"src{i % 5}") for i in range(100, 220)]
    rows += [row(None, words(i, 30) + " you stupid worthless idiot") for i in range(300, 310)] + [row(None, words(500, 40), "src1")] * 7
    docs, before = documents(spark, rows), len(rows)
    labels(spark, [(i, 1, int(i % 6 == 0)) for i in range(100, 220)] + [(None, 1, 1)]).write.parquet(f"{tmp_path}/labels.parquet")
    columns, counts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "bpe":
            break
        assert docs.columns == columns
        kept = docs.collect()
        counts[name] = len(kept)
        assert all(r[c] == "x" for r in kept for c in CLASHING)
        if name == "toxicity":
            gone = [r for r in kept if "stupid worthless" in (r["text"] or "")]
            assert not gone and sum(r["doc_id"] is None and r["text"] == words(500, 40) for r in kept) == 7
        if name in ("simhash", "pii"):
            assert sum(r["doc_id"] is None and r["text"] == words(500, 40) for r in kept) == 7  # nothing can name one of them
    assert before > counts["toxicity"] > counts["simhash"] == counts["pii"]
    assert docs.count() == counts["mixing"] and set(docs.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_a_run_leaves_nothing_in_the_shared_folder(spark, tmp_path):
    import os

    from scribelake.llm.common import shared_folder

    corpus(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert not [n for n in os.listdir(shared_folder(spark).removeprefix("file:")) if n.startswith("pipeline-")]
    assert out.count() > 0


def test_mixing_starts_no_python_workers(spark):
    """Its plan of a few sources stays in the JVM; from Python rows, executors would start workers besides those of the Arrow functions."""
    from scribelake.llm import mixing

    few = spark.sql("select * from values ('a', 1.5D, 3L, 0.1D + 0.2D), (null, null, 2L, double('nan')) as t(source, target, source_size, level)")
    got = mixing._settled(few, True)
    assert got.schema == few.schema and sorted(map(repr, got.collect())) == sorted(map(repr, few.collect()))
    assert mixing._settled(few.limit(0), True).collect() == []
    assert all("LogicalRDD" not in (plan := t._jdf.queryExecution().analyzed().toString()) and "ExistingRDD" not in plan for t in (got, mixing._settled(few.limit(0), True)))
