"""Transcription of chunks by a pluggable model. No speech model is part of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelake.functions.text import collapsed
from scribelake.operators import signal
from scribelake.operators.signal import RATE, SILENT_PEAK
from scribelake.operators.speakers import Embedder, diarize
from scribelake.operators.text import render
from scribelake.sources.shared import durable

SHORT = 2 * RATE


class Transcriber(Protocol):
    """Samples from -1 to 1 to (text, whether the model ran out of tokens). One that also has ``many``, from a list of them to
    a list, is given the parts of several chunks together."""

    def __call__(self, audio: np.ndarray) -> tuple[str, bool]: ...


def without_loops(text: str) -> str:
    """The worker's form of ``functions.text.collapse_repeats``."""
    return collapsed(text).strip()


def transcribe_chunk(samples: np.ndarray, start: int, model: Transcriber, done: Callable[[int], None] = lambda end: None) -> Iterator[tuple[int, int, str]]:
    """(start, end, text) of a chunk's parts that have any text.

    Silence isn't given to the model. Where the model ran out of tokens, a chunk of over 2 s is replaced by its halves; a
    shorter one has its loops collapsed. ``done`` hears how far it has come.
    """
    waiting = [(0, len(samples))]
    while waiting:
        a, b = waiting.pop()
        audio = samples[a:b].astype(np.float32) / 32768.0
        text, truncated = model(audio) if b > a and np.abs(audio).max() >= SILENT_PEAK else ("", False)
        if truncated and b - a > SHORT:
            middle = (2 * start + a + b) // 2 - start
            waiting += [(middle, b), (a, middle)]
            continue
        text = without_loops(text) if truncated else text
        if text:
            yield start + a, start + b, text
        done(start + b)


def transcribe_together(chunks: list[tuple[int, np.ndarray]], model: Transcriber) -> list[list[tuple[int, int, str]]]:
    """What ``transcribe_chunk`` gives for each chunk (start, samples), by rounds: all parts that wait are given to the model's
    ``many`` together, and the halves of those cut short wait for the next round."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in chunks]
    waiting = [(i, 0, len(samples)) for i, (_, samples) in enumerate(chunks)]
    while waiting:
        audio = [chunks[i][1][a:b].astype(np.float32) / 32768.0 for i, a, b in waiting]
        heard = [k for k, x in enumerate(audio) if len(x) and np.abs(x).max() >= SILENT_PEAK]
        texts = dict(zip(heard, model.many([audio[k] for k in heard]), strict=True)) if heard else {}
        halves = []
        for k, (i, a, b) in enumerate(waiting):
            text, truncated = texts.get(k, ("", False))
            start = chunks[i][0]
            if truncated and b - a > SHORT:
                middle = (2 * start + a + b) // 2 - start
                halves += [(i, a, middle), (i, middle, b)]
            elif text := without_loops(text) if truncated else text:
                found[i].append((start + a, start + b, text))
        waiting = halves
    return [sorted(parts) for parts in found]


def transcribe_segment(samples: np.ndarray, model: Transcriber) -> str:
    """A live segment: halved once if the model ran out of tokens, the halves as they are."""
    audio = samples.astype(np.float32) / 32768.0
    text, truncated = model(audio)
    if truncated and len(audio) > SHORT:
        half = len(audio) // 2
        text = " ".join(filter(None, (model(audio[:half])[0], model(audio[half:])[0])))
    return text


def transcribe_chunks(chunks: DataFrame, make: Callable[[], Transcriber], key: str) -> DataFrame:
    """(key, seq, label, text) parts from chunks (key, start, label, samples); ``make`` loads the model once for each task.
    Chunks are independent, so a long recording is spread over the cluster."""
    schema = f"{key} {chunks.schema[key].dataType.simpleString()}, seq long, label int, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            sounds = [(int(r.start), np.asarray(r.samples, np.int16)) for r in batch.itertuples()]
            parts = transcribe_together(sounds, model) if hasattr(model, "many") else [list(transcribe_chunk(x, start, model)) for start, x in sounds]
            rows = [(getattr(r, key), a, r.label, text) for r, own in zip(batch.itertuples(), parts, strict=True) for a, _, text in own]
            yield pd.DataFrame(rows, columns=[key, "seq", "label", "text"]).astype({"label": "Int32"})

    return chunks.select(key, "start", "label", "samples").mapInPandas(run, schema)


def plan_chunks(runs: DataFrame, key: str, speakers: Callable[[], Embedder] | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, total, duration) of recordings (key, offset, samples) and their chunks (key, label, start, end): with a speaker model
    a recording is first parted by speaker, and no chunk crosses a change."""
    tiles = durable(signal.tiles(runs, [key]))
    totals = signal.totals(tiles, [key]).select(key, "total", F.col("seconds").alias("duration"))
    whole = totals.where("total > 0").select(key, F.lit(0).cast("long").alias("start"), F.col("total").alias("end"), F.lit(None).cast("int").alias("label"))
    return totals, durable(signal.chunks(tiles, whole if speakers is None else diarize(runs, speakers, key), key))


def transcribe_recordings(runs: DataFrame, make: Callable[[], Transcriber], key: str, speakers: Callable[[], Embedder] | None = None) -> tuple[DataFrame, DataFrame]:
    """Whole recordings of runs (key, offset, samples): (key, transcript, duration) and the (key, seq, kind, value) events of
    each, in order: the duration, then for each chunk how far it has come in percent, then the text.

    Chunks are spread over the cluster whatever recording they are of. The model's parts are written down once. A
    recording without speech has an empty transcript.
    """
    totals, chunks = plan_chunks(runs, key, speakers)
    parts = durable(transcribe_chunks(signal.cut_samples(runs, chunks, key), make, key))
    texts = render(parts, [key])
    out = durable(totals.join(texts, key, "left").select(key, F.coalesce("transcript", F.lit("")).alias("transcript"), "duration"))
    text = lambda c: F.col(c).cast("string").alias("value")
    length = out.select(key, F.lit(-1).cast("long").alias("seq"), F.lit("duration").alias("kind"), text("duration"))
    come = chunks.join(totals, key).select(key, F.col("end").alias("seq"), F.lit("progress").alias("kind"), (F.col("end") / F.col("total") * 100).cast("string").alias("value"))
    done = out.select(key, F.lit(2**62).alias("seq"), F.lit("done").alias("kind"), text("transcript"))
    return out, length.unionByName(come).unionByName(done)


def transcribe_segments(segments: DataFrame, make: Callable[[], Transcriber], key: str) -> DataFrame:
    """(key, start, end, text) of live segments (key, start, end, n, sum_sq, samples), on a table or a stream: silent ones
    aren't given to the model, and those without text are left out. The model is made once for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            rows = [(getattr(r, key), r.start, r.end, transcribe_segment(np.asarray(r.samples, np.int16), model)) for r in batch.itertuples()]
            yield pd.DataFrame([r for r in rows if r[3]], columns=[key, "start", "end", "text"])

    heard = signal.gate_live(segments).select(key, "start", "end", "samples")
    return heard.mapInPandas(run, f"{key} {segments.schema[key].dataType.simpleString()}, start long, end long, text string")


def transcribe_watched(rows: DataFrame, make: Callable[[], Transcriber], key: str) -> DataFrame:
    """(key, kind, start, end, text) of what ``watched_segments`` gives: segments as ``transcribe_segments`` has them, earlier text
    as it is, and how a recording ended, with its source's last words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            out = []
            for r in batch.itertuples():
                text = r.said or ""
                if r.kind == "segment":
                    text = transcribe_segment(np.asarray(r.samples, np.int16), model) if r.heard else ""
                if text or r.kind != "segment":
                    out.append((getattr(r, key), r.kind, r.start, r.end, text))
            yield pd.DataFrame(out, columns=[key, "kind", "start", "end", "text"])

    heard = F.coalesce(F.sqrt(F.col("sum_sq") / F.when(F.col("n") > 0, F.col("n"))) >= signal.SILENT_RMS, F.lit(False))
    cut = rows.select(key, "kind", "start", "end", F.when(heard, F.col("samples")).alias("samples"), "said", heard.alias("heard"))
    return cut.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, kind string, start long, end long, text string")


def live_text(segments: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """(key, transcript) of transcribed segments in order, a paragraph each; earlier text, if not blank, is the first."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"])
    first = F.array(F.lit(prefix.rstrip())) if prefix.strip() else F.array().cast("array<string>")
    return segments.groupBy(key).agg(F.array_join(F.concat(first, ordered), "\n\n").alias("transcript"))
