"""What surrounds a pluggable speech model: choice by device, token masks, the final write, keywords as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from scribelake.operators.speakers import Embedder, window_features
from scribelake.operators.text import top_stems


class Registry:
    """Model factories by device id; an unknown device is a ValueError."""

    def __init__(self) -> None:
        self._makers: dict[str, Callable[[], Any]] = {}

    def add(self, device: str, make: Callable[[], Any]) -> None:
        self._makers[device] = make

    def make(self, device: str) -> Any:
        if device not in self._makers:
            raise ValueError(f"unknown device: {device}")
        return self._makers[device]()


def mask_logits(logits: np.ndarray, end: int, suppressed: list[int], first: bool, suppressed_first: list[int]) -> np.ndarray:
    """Tokens after the end token and suppressed ones can't come; some only not first."""
    out = np.array(logits, np.float64)
    out[..., end + 1 :] = -np.inf
    out[..., suppressed + (suppressed_first if first else [])] = -np.inf
    return out


def embed_windows(windows: DataFrame, make: Callable[[], Embedder], key: str) -> DataFrame:
    """(key, window, v): the unit vector of each window (key, window, features: frames x 80, flat); the model is made once
    for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for batch in batches:
            made = [np.asarray(embed(window_features(np.asarray(f, np.float32).reshape(-1, 80))), np.float64) for f in batch["features"]]
            yield pd.DataFrame({key: batch[key], "window": batch["window"], "v": [(v / max(float(np.linalg.norm(v)), 1e-12)).tolist() for v in made]})

    return windows.select(key, "window", "features").mapInPandas(run, f"{key} {windows.schema[key].dataType.simpleString()}, window long, v array<double>")


def finish_write(update: Callable[..., None], note_id: int, transcript: str, duration: float | None) -> str | None:
    """Saves a finished transcript; if that fails with its duration, without. Returns an error's text."""
    try:
        try:
            update(note_id, transcript=transcript, **({} if duration is None else {"duration": duration}))
        except Exception:
            update(note_id, transcript=transcript)
    except Exception as error:
        return str(error)
    return None


def changed_fields(before: dict[str, Any], after: dict[str, Any], locked: bool) -> dict[str, Any]:
    """What an autosave sends: changed fields, without the transcript while a job writes it."""
    return {k: v for k, v in after.items() if before.get(k) != v and not (locked and k == "transcript")}


@udtf(returnType="rank int, keyword string, count int")
class Keywords:
    """Keywords of one text for lateral joins in SQL; ``operators.text.keywords`` is the way for tables."""

    def eval(self, text: str, limit: int):
        for rank, (word, n) in enumerate(top_stems(text, limit), 1):
            yield rank, word, n
