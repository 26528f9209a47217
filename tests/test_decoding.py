"""Token decoding by batches against a plain loop, and chunks that are transcribed together against one by one."""

import numpy as np
import pytest

from scribelake.operators.decoding import Decoding, decode_sounds, greedy
from scribelake.operators.transcribe import transcribe_chunk, transcribe_chunks, transcribe_together

R = 16_000


class Rolling:
    """Logits from a state that remembers every token and sound, so a mixed-up row would show."""

    prompt, end, suppressed, suppressed_first = (21, 22, 23), 20, (2, 5), (0, 20)

    def __init__(self, limit=30, seed=0):
        self.limit, self.table = limit, np.random.default_rng(seed).normal(size=(97, 26))

    def start(self, sounds, lengths):
        whole = np.array([np.abs(s[:n]).sum() for s, n in zip(sounds, lengths)])
        return {"h": np.floor(whole * 1000).astype(np.int64) % 97}

    def step(self, state, tokens, position):
        state["h"] = (state["h"] * 31 + tokens * 7 + position) % 97
        return self.table[state["h"]]

    def keep(self, state, rows):
        return {"h": state["h"][rows]}

    def text(self, tokens):
        return " ".join(map(str, tokens))


def plain(model, sound):
    """One sound, one token at a time."""
    state, made, early = model.start(sound[None], np.array([len(sound)])), [], []
    token = model.prompt[0]
    for position in range(model.limit - 1):
        logits = model.step(state, np.array([token]), position)[0].copy()
        if position < len(model.prompt) - 1:
            token = model.prompt[position + 1]
            continue
        logits[model.end + 1 :] = -np.inf
        logits[list(model.suppressed)] = -np.inf
        if not made:
            logits[list(model.suppressed_first)] = -np.inf
        token = int(np.argmax(logits))
        if token == model.end:
            return made, False, early
        made.append(token)
        if len(made) % 4 == 0:
            early.append((model.text(made), len(made)))
    return made, True, early


def sounds_of(n, seed=1):
    rng = np.random.default_rng(seed)
    return [rng.integers(-3000, 3000, rng.integers(1, 400)).astype(np.int16) for _ in range(n)]


@pytest.mark.parametrize("batch", [1, 7, 64])
def test_batches_decode_like_one_sound(batch):
    model, sounds = Rolling(), [s / np.float32(32768) for s in sounds_of(50)]
    early = {i: [] for i in range(len(sounds))}
    got = Decoding(model, batch).tokens(sounds, lambda i, text, n: early[i].append((text, n)))
    for i, s in enumerate(sounds):
        tokens, truncated, previews = plain(model, s)
        assert got[i] == (tokens, truncated) and early[i] == previews
    assert {t for _, t in got} == {True, False}
    assert all(not {2, 5, 21, 22, 23, 24, 25} & set(tokens) for tokens, _ in got) and all(t[0] != 0 for t, _ in got)


def test_no_sounds_and_a_limit_below_the_prompt():
    assert greedy(Rolling(), []) == []
    assert greedy(Rolling(limit=3), [np.ones(4, np.float32)]) == [([], True)]


def test_a_table_of_sounds(spark):
    model, sounds = Rolling(), sounds_of(40)
    rows = spark.createDataFrame([(i, i % 3, s.tolist()) for i, s in enumerate(sounds)], "id int, part int, samples array<smallint>").repartition(5)
    got = decode_sounds(rows, Rolling, ["id", "part"], batch=6).collect()
    for i, s in enumerate(sounds):
        tokens, truncated, early = plain(model, s / np.float32(32768))
        own = [(r["kind"], r["tokens"], r["text"], r["truncated"]) for r in got if r["id"] == i]
        assert own == [("preview", n, t, False) for t, n in early] + [("text", len(tokens), model.text(tokens), truncated)]


def cut_short(audio):
    """Runs out of tokens above four seconds and, for some sounds, even below two."""
    return (f"{len(audio)}", len(audio) > 4 * R) if len(audio) % 3 else ("다시 다시 다시 다시 다시 다시", True)


class Together:
    def __call__(self, audio):
        return cut_short(audio)

    def many(self, sounds):
        return [cut_short(s) for s in sounds]


def test_chunks_together_are_as_one_by_one(spark):
    rng = np.random.default_rng(5)
    chunks = [(int(rng.integers(0, 10**6)) * 160, np.full(n, 900 if n % 5 else 0, np.int16)) for n in [1, 160, 2 * R, 2 * R + 3, 5 * R + 1, 9 * R, 19 * R + 7, 20 * R, 0]]
    want = [list(transcribe_chunk(s, start, cut_short)) for start, s in chunks]
    assert transcribe_together(chunks, Together()) == [sorted(w) for w in want]
    rows = spark.createDataFrame([("a", start, None, s.tolist()) for start, s in chunks], "rec string, start long, label int, samples array<smallint>")
    one, many = (sorted(map(tuple, transcribe_chunks(rows, make, "rec").collect()), key=repr) for make in (lambda: cut_short, Together))
    assert one == many


def test_a_step_model_transcribes_a_recording(spark):
    """From samples to a transcript: cut, decoded in batches, halved where the limit is reached, rendered."""
    from scribelake.operators.transcribe import transcribe_recordings
    from tests.test_signal import noise, runs

    pcm = np.concatenate([noise(9), np.zeros(R, np.int16), noise(25, 3)])
    make = lambda: Decoding(Rolling(limit=12))
    texts, _ = transcribe_recordings(runs(spark, a=pcm), make, "rec")
    one, _ = transcribe_recordings(runs(spark, a=pcm), lambda: lambda x: make()(x), "rec")
    assert texts.first()["transcript"] == one.first()["transcript"] != ""
