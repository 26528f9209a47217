import base64
import hashlib
import random
from heapq import heappop

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scribelake.llm import bpe
from tests.llm.data import SCHEMA, awkward, documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = bpe.Vocabulary(PATH, public_tokenizers.PATTERN)
PUBLIC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=300) | st.text(alphabet="aeinrst TH's12\n", max_size=400))
def test_like_the_public_library(text):
    ids = VOCABULARY.encode(text)
    assert ids == PUBLIC.encode_ordinary(text) and VOCABULARY.decode(ids) == text.encode()


@pytest.mark.parametrize("piece", ["a" * 30_000, "ab" * 9_000, "=" * 5_000, "é" * 4_000, "".join(random.Random(3).choices("abcdefgh", k=20_000))])
def test_very_long_pieces(piece):
    assert VOCABULARY.encode(piece) == PUBLIC.encode_ordinary(piece)


def test_a_vocabulary_whose_merges_are_out_of_order():
    # "abc" has a lower rank than "ab", which it is made of; the lowest rank that is there goes first all the same.
    ranks = {bytes([i]): i + 10 for i in range(256)} | {b"abc": 1, b"ab": 5, b"bc": 6, b"cab": 2}
    own = bpe.Vocabulary.__new__(bpe.Vocabulary)
    own.ranks = ranks
    public = tiktoken.Encoding("odd", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    for n in range(1, 40):
        text = "".join(random.Random(n).choices("abc", k=n))
        assert list(own.merge(text.encode())) == public.encode_ordinary(text)


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    own = bpe.Vocabulary(PATH, public_tokenizers.PATTERN)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)]
    assert all(own.encode(t) == PUBLIC.encode_ordinary(t) for t in texts) and len(own.new) <= 50 and len(own.old) <= 50


def nonsense(n, alphabet="abcdefghijklmnoprstuvwyzéü", seed=5):
    draw = random.Random(seed)
    return [("".join(draw.choices(alphabet, k=draw.randint(1, 14)))) for _ in range(n)]


def test_new_pieces_are_merged_by_whole_buckets(monkeypatch):
    """Words that no vocabulary has cost most of the time; their places aren't taken from the queue one at a time."""
    taken = []
    monkeypatch.setattr(bpe, "heappop", lambda bucket: taken.append(1) or heappop(bucket))
    text = " ".join(nonsense(4_000))
    assert bpe.Vocabulary(PATH, public_tokenizers.PATTERN).encode(text) == PUBLIC.encode_ordinary(text)
    assert len(taken) < len(text) // 100


@pytest.mark.parametrize("queue", [1, 300, 1 << 20])
def test_queues_of_many_pieces(monkeypatch, queue):
    monkeypatch.setattr(bpe, "LEAST_QUEUE", 0)
    monkeypatch.setattr(bpe, "QUEUE", queue)
    pieces = [*nonsense(300), *nonsense(100, "a"), *nonsense(100, "=\0 -"), "", "the", "é" * 700, "ab" * 600 + "a", "\0", ""]
    assert list(VOCABULARY.merge_all(p.encode() for p in pieces)) == [VOCABULARY.merge(p.encode()) for p in pieces]
    assert all(list(VOCABULARY.merge(p.encode())) == PUBLIC.encode_ordinary(p) for p in pieces if len(VOCABULARY.find(p)) == 1)
    assert list(VOCABULARY.merge_all([])) == []


def test_queues_with_merges_out_of_order(monkeypatch):
    monkeypatch.setattr(bpe, "LEAST_QUEUE", 0)
    for seed in range(40):
        tokens = sorted({t.encode() for t in nonsense(20, "abc", seed) if 1 < len(t) < 7} | {b"ab", b"bc", b"aa"})
        random.Random(seed).shuffle(tokens)
        own = bpe.Vocabulary.__new__(bpe.Vocabulary)
        own.ranks = {t: i for i, t in enumerate([*tokens, *(bytes([i]) for i in range(256))])}
        pieces = nonsense(60, "abc", seed + 100)
        public = tiktoken.Encoding("odd", pat_str=r"\w+", mergeable_ranks=own.ranks, special_tokens={})
        assert list(map(list, own.merge_all(p.encode() for p in pieces))) == [public.encode_ordinary(p) for p in pieces]
        del own.pairs, own.ranks[b"z"]  # a byte that is no token
        assert list(map(list, own.merge_all(p.encode() for p in pieces))) == [public.encode_ordinary(p) for p in pieces]


def test_texts_by_groups(monkeypatch):
    """Of several groups, with remembered pieces from any of them, texts longer than a group and none."""
    monkeypatch.setattr(bpe, "TEXTS", 500)
    monkeypatch.setattr(bpe, "MEMO", 70)
    own = bpe.Vocabulary(PATH, public_tokenizers.PATTERN)
    texts = [" ".join(nonsense(i % 60, seed=i % 17)) for i in range(150)] + ["", "x" * 3_000, " ".join(nonsense(2_000)), ""]
    assert list(own.encode_all(iter(texts))) == [PUBLIC.encode_ordinary(t) for t in texts]
    assert list(own.encode_all([])) == [] and len(own.new) <= 70 and len(own.old) <= 70


def test_columns(spark):
    docs = documents(spark)
    want = sorted((str(r[0]), len(ids := PUBLIC.encode_ordinary(r[1] or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in awkward())
    assert sorted((str(r["doc_id"]), *r[1:]) for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()) == want
    back = bpe.decode_column(bpe.encode_column(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert set(back.columns) == {*docs.columns, "ids", "decoded"} and all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH, public_tokenizers.PATTERN).count() == 0


def test_workers_keep_no_pieces_after_a_task(spark):
    """Only what a task remembers may hold its pieces: workers are used again, and their memory counts while other stages run."""

    def holding(batches):
        import gc

        from scribelake.llm.bpe import Vocabulary

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(o.new) + len(o.old) for o in gc.get_objects() if isinstance(o, Vocabulary))]})

    rows = [(i, "Zyxwq77piece and Zyxwq77piece") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    pattern = r"[^ ]+"
    assert {r["n_tokens"] for r in bpe.round_trip(docs, PATH, pattern).collect()} == {2 * len(VOCABULARY.merge(b"Zyxwq77piece")) + len(VOCABULARY.merge(b"and"))}
    bpe.encode_column(docs, PATH, pattern).select("ids").collect()
    assert sum(r["n"] for r in spark.range(0, 40, 1, 8).mapInArrow(holding, "n long").collect()) == 0
