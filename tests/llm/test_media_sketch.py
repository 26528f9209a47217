import datetime
import decimal
import hashlib
import io
import math
import random
import re
import struct
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scribelake.llm import media, sketch
from tests.llm.data import SCHEMA, awkward, documents, row, words


# ---- media -----------------------------------------------------------------------------------------------------------
@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=2000))
def test_wav_keeps_every_byte(data):
    padded = media.payload(data)
    assert len(padded) % 192 == 0 and len(padded) > 0 and padded.rstrip(b" ") == data.rstrip(b" ") and len(padded) - len(data) < 193
    stored = media.store(padded)
    assert media.read(stored) == padded
    with wave.open(io.BytesIO(stored)) as track:
        assert track.getnchannels() == 1 and track.getsampwidth() == 1


def plain_peaks(samples, s):
    sound = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    count = max(0, -(-(len(sound) - s.window) // s.hop)) + 1
    sound = np.concatenate([sound, np.zeros(s.window + (count - 1) * s.hop - len(sound), np.float32)])
    power = [np.abs(np.fft.rfft(sound[i * s.hop : i * s.hop + s.window] * np.hanning(s.window).astype(np.float32))) for i in range(count)]
    width, out = s.window // 2 // s.bands, []
    for span in range(0, count, s.span):
        out.append([max(((power[t][b], -t, -b) for t in range(span, min(span + s.span, count)) for b in range(1 + k * width, 1 + (k + 1) * width))) for k in range(s.bands)])
    return [[(-t, -b) for _, t, b in bands] for bands in out]


def test_landmarks_like_plain_loops():
    s = media.Spectrum()
    for n in (0, 100, 300, 5000, 40_000):
        data = media.payload(bytes(random.Random(n).choices(range(256), k=n)))
        peaks = plain_peaks(data, s)
        want = Counter()
        for i, bands in enumerate(peaks):
            for j in range(i, min(len(peaks), i + s.reach + 1)):
                for a in range(s.bands):
                    for b in range(s.bands):
                        if j > i or a < b:
                            (t0, f0), (t1, f1) = bands[a], peaks[j][b]
                            if t1 < t0:
                                (t0, f0), (t1, f1) = (t1, f1), (t0, f0)
                            want[t0, f0 << 20 | f1 << 8 | t1 - t0] += 1
        times, codes = media.landmarks(data)
        assert Counter(zip(times.tolist(), codes.tolist())) == want and (np.diff(times) >= 0).all()
        small = media.landmarks(data, media.Spectrum(block=1))
        assert all(np.array_equal(x, y) for x, y in zip((times, codes), small))


def test_a_tone_has_its_peaks_at_its_frequency():
    sound = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(16_000) / 8000)).astype(np.uint8).tobytes()
    at, bins = media.peaks(sound)
    assert (bins[:, 0] == 32).all() or (bins[:-1, 0] == 32).all()  # 1000 Hz at 31.25 Hz a bin, the top of the first band


def test_media_columns_and_digests(spark):
    docs = documents(spark)
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media.media_digests(docs).collect()}
    for r in awkward():
        raw = (r[1] or "").encode()
        padded = media.payload(raw)
        d = got[r[0], hashlib.sha256(padded).hexdigest()]
        assert d["n_bytes"] == len(raw) and d["payload_bytes"] == len(padded) and d["tail_crc32"] == zlib.crc32(padded[-16:])
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(awkward()) and all(media.read(bytes(r["media"])) == media.payload((r["text"] or "").encode()) and len(r["landmark_times"]) == len(r["landmark_codes"]) for r in rows)
    assert media.media_digests(spark.createDataFrame([], SCHEMA)).count() == 0


# ---- sketches --------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=80))
def test_peeling_recovers_every_difference(shared, a, b):
    left, right = (np.array(sorted(s), np.uint64) for s in (shared | a, shared | b))
    only_a, only_b = sketch.Sketches([left, right]).differences([(0, 1), (1, 0)])[0]
    assert set(only_a.tolist()) == (shared | a) - (shared | b) and set(only_b.tolist()) == (shared | b) - (shared | a)


def test_sketches_in_a_batch_are_independent():
    own = np.random.default_rng(1)
    sets = [np.unique(own.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 0, 1, 0, 0, 900, 500, 500, 3, 2000)]
    pairs = [(0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (5, 9), (9, 9)]
    made = sketch.Sketches(sets)
    for (a, b), (x, y) in zip(pairs, made.differences(pairs)):
        assert set(x.tolist()) == set(sets[a].tolist()) - set(sets[b].tolist()) and set(y.tolist()) == set(sets[b].tolist()) - set(sets[a].tolist())
    assert len(set(made.stored())) == len({s.tobytes() for s in sets})


def test_folding_gives_the_smaller_table():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 400).astype(np.uint64))
    large, small = (sketch.tables([keys], np.array([c])) for c in (192, 48))
    made, cells = sketch.folded(large, np.array([0]), np.array([3]), np.array([1]), np.array([0]), np.zeros(0, np.int64))
    assert cells.tolist() == [48] and all((getattr(made, c) == getattr(small, c)).all() for c in ("count", "key", "check"))


def test_stored_sketches_of_versions():
    text = words(3, 900)
    versions = [text, text.replace("tion", "shun", 4), text[: len(text) * 3 // 4] + words(4, 60), words(5, 200), "", text]
    for a in versions:
        for b in versions:
            doublings, found = 0, None
            while (found := sketch.compare(sketch.sketch(a, doublings), sketch.sketch(b, doublings))) is None:
                doublings += 1
            x, y = (Counter(plain_pieces(t)) for t in (a, b))
            apart = ((x - y).total(), (y - x).total())
            assert (len(found[0]), len(found[1])) == apart
            assert found[2] == pytest.approx((x & y).total() / (x | y).total() if x or y else 1.0)
    assert sketch.compare(sketch.sketch(text), sketch.sketch(versions[1])) is not None  # a small edit needs no larger tables


def test_pieces_lose_nothing_and_stay_where_the_text_does():
    many = lambda seed, n: " ".join(f"w{random.Random(seed * 1000 + i).randrange(10**6):x}" for i in range(n))
    text = many(5, 400) + "\n" + "x " * 50 + "\n\n" + many(6, 30)
    assert b" ".join(sketch.pieces(text)).split() == text.encode().split()
    a, b = sketch.digests(text), sketch.digests(text[: len(text) * 3 // 4] + many(9, 80))
    both = len(np.intersect1d(a, b))
    assert both > 0.5 * len(a) and len(np.intersect1d(a, sketch.digests(many(77, 400)))) < 0.05 * len(a)
    assert len(sketch.digests("d d d d")) == 4 and len(sketch.digests("")) == 0


def plain_pieces(text):
    """Word by word: a piece ends with its line, with a word whose last byte is 0 modulo 4, or with its twelfth word."""
    data, out, held, end = text.encode(), [], [], 0
    for m in re.finditer(rb"[^ \t-\r]+", data):
        if held and b"\n" in data[end : m.start()]:
            out.append(data[held[0] : end])
            held = []
        held.append(m.start())
        end = m.end()
        if data[end - 1] % 4 == 0 or len(held) == 12:
            out.append(data[held[0] : end])
            held = []
    return out + ([data[held[0] : end]] if held else [])


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], xxhash.xxh64_intdigest((r[1] or "").encode(), 42) + 2**63 & 2**64 - 1, r[1] or ""))
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        own, *others = (Counter(plain_pieces(t)) for t in (text, edited, after))
        near = [(own & x).total() / (own | x).total() if own or x else 1.0 for x in others]
        yield r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), round(near[0], 9), round(near[1], 9)


def fingerprint_rows(out):
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out)


def test_fingerprints_like_a_plain_loop(spark):
    rows = awkward() + [row(i, words(i, i % 60)) for i in range(200, 400)] + [row(41, words(i, 9)) for i in range(60)] + [row(900, words(9, 30_000))]
    for parts in (1, 3, 16):
        got = sketch.fingerprint_documents(documents(spark, rows), parts=parts).collect()
        assert fingerprint_rows(got) == Counter(plain(rows))
        assert len({(r["fingerprint"]) for r in got}) == len({tuple(sorted(Counter(plain_pieces(r[1] or "")).items())) for r in rows})
    named = documents(spark, [r for r in rows if r[0] is not None]).withColumn("doc_id", F.format_string("a%05d", "doc_id"))
    got = sketch.fingerprint_documents(named, parts=5).collect()
    want = Counter((f"a{i:05d}", *rest) for (i, *rest) in plain([r for r in rows if r[0] is not None]))
    assert fingerprint_rows(got) == want


def test_sketch_column(spark):
    got = sketch.with_sketch(documents(spark)).collect()
    assert all(bytes(r["sketch"]) == sketch.sketch(r["text"] or "") for r in got)


def test_one_document_and_none(spark):
    r = sketch.fingerprint_documents(documents(spark, [row(1, "one two three four")])).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0
    assert sketch.fingerprint_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_mixed(key, salt):
    """The same mixing of 64 bits, in whole numbers."""
    z = (key + 0x9E3779B97F4A7C15 * (salt + 1)) % 2**64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
    return z ^ z >> 31


def plain_sketch(text):
    """A table cell by cell: pieces end at words whose last byte is a multiple of four, at twelve words, and at line ends."""
    keys, seen = set(), {}
    for line in text.encode().split(b"\n"):
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", line)]
        start = 0
        for i, (_, end) in enumerate(words):
            if line[end - 1] % 4 == 0 or i - start == 11 or i == len(words) - 1:
                key = xxhash.xxh3_64_intdigest(line[words[start][0] : end])
                nth = seen[key] = seen.get(key, -1) + 1
                keys.add(plain_mixed(key ^ plain_mixed(nth, 3), 4) if nth else key)
                start = i + 1
    third = 8 * 2 ** max(0, math.ceil(math.log2(max(1.0, 0.75 * len(keys) / 24))))
    cells = [[0, 0, 0] for _ in range(3 * third)]
    for key in keys:
        for i in range(3):
            cell = cells[plain_mixed(key, 11 * i + 5) % third + i * third]
            cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] ^ key, cell[2] ^ plain_mixed(key, 99)
    return len(keys).to_bytes(8, "little") + b"".join(struct.pack("<iQQ", *c) for c in cells)


def test_fingerprints_are_digests_of_plain_tables(spark):
    rows = [row(k, "\n".join(words(10 * k + j, 30 + 7 * k) for j in range(k % 4 + 1)) + " same same same same") for k in range(30)] + [row(90, None), row(91, "a\n\n b")]
    for r in sketch.fingerprint_documents(documents(spark, rows), parts=4).collect():
        text = next(x[1] for x in rows if x[0] == r["doc_id"]) or ""
        made = plain_sketch(text)
        assert bytes(r["sketch"]) == made and r["fingerprint"] == hashlib.sha256(made).hexdigest(), text
        assert r["edited_fingerprint"] == hashlib.sha256(bytes(r["edited_sketch"])).hexdigest()


def test_what_is_returned_can_be_peeled(spark):
    """Rows' own sketches, without any text, give the likenesses again."""
    rows = [row(k, words(k, 200) if k % 5 else words(1, 220)) for k in range(40)]
    got = sorted(sketch.fingerprint_documents(documents(spark, rows), parts=3).collect(), key=lambda r: r["doc_id"])
    peeled = 0
    for r, after in zip(got, [*got[1:], got[0]], strict=True):
        for other, near in ((r["edited_sketch"], r["near_edited"]), (after["sketch"], r["near_next"])):
            if found := sketch.compare(bytes(r["sketch"]), bytes(other)):
                assert found[2] == near
                peeled += 1
    assert peeled >= 30  # of the 40 edited ones; texts that share nothing differ by more than their tables hold


@pytest.mark.parametrize("kind,make", [("string", lambda k: f"id \"{k:05d}\""), ("timestamp", lambda k: datetime.datetime(2020, 1, 1, 0, 0, 0, 7 * k + 1)), ("double", lambda k: k / 7), ("decimal(20,3)", lambda k: decimal.Decimal(k) / 8)])
def test_bounds_of_any_type(spark, kind, make):
    """More parts than rows in some: the next document is that of the whole order."""
    rows = [(make(k), words(k, 40)) for k in range(60)] + [(None, words(99, 40))]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)
    got = {r["doc_id"]: r for r in sketch.fingerprint_documents(docs, parts=9).collect()}
    order = [None, *(make(k) for k in range(60))]
    texts = dict(rows)
    for one, after in zip(order, [*order[1:], order[0]], strict=True):
        n = len(texts[one]) // 4
        edited = texts[one][: len(texts[one]) - n] + texts[after][:n]
        assert got[one]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
