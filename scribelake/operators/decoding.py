"""Greedy decoding of tokens by a pluggable step model, for many sounds at once. No model is part of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from scribelake.operators.models import mask_logits

#: A preview is given after so many tokens.
PREVIEW = 4


class StepModel(Protocol):
    """An encoder and a decoder that is asked for one token at a time, for all sounds of a batch.

    ``prompt`` is fed first; ``end`` ends a text, and tokens after it are no text; ``suppressed`` ones never come and
    ``suppressed_first`` ones not at first. ``limit`` bounds the positions, the prompt's among them.
    """

    prompt: Sequence[int]
    end: int
    limit: int
    suppressed: Sequence[int]
    suppressed_first: Sequence[int]

    def start(self, sounds: np.ndarray, lengths: np.ndarray) -> Any:
        """The state of a batch: sounds from -1 to 1, a row each, padded with zeros to the longest."""

    def step(self, state: Any, tokens: np.ndarray, position: int) -> np.ndarray:
        """Logits (rows x vocabulary) after these tokens at this position; the state goes on."""

    def keep(self, state: Any, rows: np.ndarray) -> Any:
        """The state of these rows alone."""

    def text(self, tokens: list[int]) -> str: ...


def greedy(model: StepModel, sounds: list[np.ndarray], preview: Callable[[int, str, int], None] | None = None) -> list[tuple[list[int], bool]]:
    """For each sound its tokens, and whether they stop at the limit rather than at an end. ``preview`` hears (sound, text,
    tokens) after every fourth token.

    All sounds are at the same position, as they have the same prompt; one that has ended leaves the batch, so what it
    costs is what the others still need.
    """
    out: list[list[int]] = [[] for _ in sounds]
    lengths = np.array([len(s) for s in sounds], np.int64)
    going, truncated = np.arange(len(sounds)), np.ones(len(sounds), bool)
    if not len(sounds):
        return []
    padded = np.zeros((len(sounds), int(lengths.max())), np.float32)
    for row, s in zip(padded, sounds, strict=True):
        row[: len(s)] = s
    state, tokens = model.start(padded, lengths), np.full(len(sounds), model.prompt[0], np.int64)
    first = len(model.prompt) - 1
    for position in range(model.limit - 1):
        logits = model.step(state, tokens, position)
        if position < first:
            tokens = np.full(len(going), model.prompt[position + 1], np.int64)
            continue
        best = mask_logits(np.asarray(logits), model.end, list(model.suppressed), position == first, list(model.suppressed_first)).argmax(axis=1)
        on = np.flatnonzero(best != model.end)
        truncated[going[best == model.end]] = False
        if not len(on):
            break
        if len(on) < len(going):
            state = model.keep(state, on)
        going, tokens = going[on], best[on].astype(np.int64)
        for i, token in zip(going.tolist(), tokens.tolist(), strict=True):
            out[i].append(token)
            if preview and len(out[i]) % PREVIEW == 0:
                preview(i, model.text(out[i]).strip(), len(out[i]))
    return list(zip(out, truncated.tolist(), strict=True))


class Decoding:
    """A step model as a ``Transcriber``, for one sound or for many; those of like length share a batch."""

    def __init__(self, model: StepModel, batch: int = 16) -> None:
        self.model, self.batch = model, batch

    def __call__(self, audio: np.ndarray) -> tuple[str, bool]:
        return self.many([audio])[0]

    def tokens(self, sounds: list[np.ndarray], preview: Callable[[int, str, int], None] | None = None) -> list[tuple[list[int], bool]]:
        out: list[tuple[list[int], bool]] = [([], False)] * len(sounds)
        order = sorted(range(len(sounds)), key=lambda i: len(sounds[i]))
        for at in range(0, len(order), self.batch):
            some = order[at : at + self.batch]
            heard = (lambda i, text, n, own=some: preview(own[i], text, n)) if preview else None
            for i, found in zip(some, greedy(self.model, [sounds[i] for i in some], heard), strict=True):
                out[i] = found
        return out

    def many(self, sounds: list[np.ndarray]) -> list[tuple[str, bool]]:
        return [(self.model.text(tokens).strip(), truncated) for tokens, truncated in self.tokens(sounds)]


def decode_sounds(sounds: DataFrame, make: Callable[[], StepModel], keys: list[str], batch: int = 16) -> DataFrame:
    """(keys, kind, tokens, text, truncated) of rows (keys, samples: 16-bit): of each sound its previews, in order, and then its
    text. The model is made once for each task, and a task decodes the sounds of an Arrow batch together."""
    schema = ", ".join(f"{k} {sounds.schema[k].dataType.simpleString()}" for k in keys) + ", kind string, tokens int, text string, truncated boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoding = Decoding(make(), batch)
        for frame in batches:
            previews: list[list[tuple]] = [[] for _ in range(len(frame))]
            audio = [np.asarray(s, np.int16).astype(np.float32) / 32768.0 for s in frame["samples"]]
            found = decoding.tokens(audio, lambda i, text, n, into=previews: into[i].append(("preview", n, text, False)))
            out = []
            for key, early, (tokens, truncated) in zip(frame[keys].itertuples(index=False), previews, found, strict=True):
                out += [(*key, *p) for p in early] + [(*key, "text", len(tokens), decoding.model.text(tokens).strip(), truncated)]
            yield pd.DataFrame(out, columns=[*keys, "kind", "tokens", "text", "truncated"])

    return sounds.select(*keys, "samples").mapInPandas(run, schema)
