"""Segmentation of recordings by energy.

Recordings are tables of 10 ms tiles (recording_id, tile_idx, n, sum_sq, peak): every energy window begins on a tile. A
block is 200 ms, 20 tiles. Keys can be any columns, and nothing collects a recording.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in samples at 16 kHz unless said otherwise.
RATE = 16_000
TILE = 160
BLOCK = 3_200
TILES = BLOCK // TILE
QUIET = 32.0**2
QUIET_SHARE = 0.08
PAUSE_BLOCKS = 3
MAX_REGION = 60 * RATE
CHUNK_FROM, CHUNK_TO = 12 * RATE, 20 * RATE
LIVE_FROM, LIVE_TO = 6 * RATE, 20 * RATE
SILENT_PEAK = 1e-4
SILENT_RMS = 64
PAD_SLACK = RATE // 10


def tiles(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tile_idx, n, sum_sq, peak) from rows (keys, offset, samples): runs of samples that begin on a tile.

    Runs may end anywhere; a tile that two runs share is added up.
    """
    runs = samples.select(*keys, (F.col("offset") / TILE).cast("long").alias("first"), F.explode(_tile_sums(F.col("samples"))).alias("t"))
    rows = runs.select(*keys, (F.col("first") + F.col("t.i")).alias("tile_idx"), "t.n", "t.sum_sq", "t.peak")
    return rows.groupBy(*keys, "tile_idx").agg(F.sum("n").alias("n"), F.sum("sum_sq").alias("sum_sq"), F.max("peak").alias("peak"))


def _tile_sums(samples: Column) -> Column:
    """A struct (i, n, sum_sq, peak) for each tile of an array."""

    def one(i: Column) -> Column:
        part = F.slice(samples, i * TILE + 1, F.lit(TILE))
        square = F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        peak = F.aggregate(part, F.lit(0), lambda s, x: F.greatest(s, F.abs(x.cast("int"))))
        return F.struct(i.alias("i"), F.size(part).alias("n"), square.alias("sum_sq"), peak.alias("peak"))

    count = F.ceil(F.size(samples) / TILE).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), one))


def totals(tiles_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, seconds, rms, peak)."""
    return tiles_.groupBy(*keys).agg(F.sum("n").alias("total"), (F.sum("n") / RATE).alias("seconds"), F.sqrt(F.sum("sum_sq") / F.sum("n")).alias("rms"), F.max("peak").alias("peak"))


def block_energy(tiles_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, energy): the mean square of each complete block."""
    blocks = tiles_.groupBy(*keys, F.floor(F.col("tile_idx") / TILES).alias("idx")).agg(F.sum("n").alias("n"), F.sum("sum_sq").alias("sum_sq"))
    return blocks.where(F.col("n") == BLOCK).select(*keys, "idx", (F.col("sum_sq") / BLOCK).alias("energy"))


def quiet_threshold(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold): 8 % of the median block energy, 1024 at least. Recordings without a block have no row."""
    return blocks.groupBy(*keys).agg(F.greatest(F.lit(QUIET), F.lit(QUIET_SHARE) * F.median("energy")).alias("threshold"))


def speech_regions(blocks: DataFrame, totals_: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end) of speech, from (keys, idx, energy, threshold) and (keys, total).

    A region ends where three quiet blocks begin, and an open one at the recording's end; its start moves back over
    contiguous audible blocks (an eighth of the threshold), not into the region before; pieces are at most a minute. A
    recording shorter than a block is one region.
    """
    order = Window.partitionBy(*keys).orderBy("idx")
    audible = F.max(F.when(F.col("energy") < F.col("threshold") / 8, F.col("idx") + 1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    last_block = F.max("idx").over(Window.partitionBy(*keys))
    voiced = blocks.select(*keys, "idx", "energy", "threshold", F.coalesce(audible, F.lit(0)).alias("heard"), last_block.alias("last_block")).where("energy >= threshold")
    before = F.lag("idx").over(order)
    voiced = voiced.withColumn("new", F.when(before.isNull() | (F.col("idx") - before > PAUSE_BLOCKS), 1).otherwise(0))
    voiced = voiced.withColumn("island", F.sum("new").over(order))
    islands = voiced.groupBy(*keys, "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.min_by("heard", "idx").alias("heard"), F.max("last_block").alias("last_block"))
    islands = islands.join(totals_.select(*keys, "total"), keys)
    open_ = F.col("last_block") - F.col("last") < PAUSE_BLOCKS
    islands = islands.withColumn("end", F.when(open_, F.col("total")).otherwise((F.col("last") + 1) * BLOCK))
    floor = F.coalesce(F.floor(F.lag("end").over(Window.partitionBy(*keys).orderBy("first")) / BLOCK), F.lit(0))
    islands = islands.withColumn("start", F.greatest(floor, F.least("heard", "first")) * BLOCK)
    short = totals_.join(blocks.select(*keys).distinct(), keys, "left_anti").where("total > 0").select(*keys, F.lit(0).cast("long").alias("start"), F.col("total").alias("end"))
    regions = islands.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).unionByName(short)
    return split_long(regions, keys)


def split_long(regions: DataFrame, keys: list[str], most: int = MAX_REGION) -> DataFrame:
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col("end") - F.col("start")) / most) - 1, F.lit(0)).cast("long")))
    rows = regions.select(*keys, "start", "end", piece.alias("k"))
    return rows.select(*keys, (F.col("start") + F.col("k") * most).alias("start"), F.least("end", F.col("start") + (F.col("k") + 1) * most).alias("end"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _median(values: Column) -> Column:
    middle = lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2
    return _once(F.array_sort(values), middle)


def cut_window(energies: Column) -> Column:
    """Which of these windows is cut through: the last quiet one, else the first of the least energy."""

    def place(limit: Column) -> Column:
        quiet = F.filter(F.transform(energies, lambda e, i: F.when(e < limit, i)), lambda i: i.isNotNull())
        return F.coalesce(F.array_max(quiet), F.array_position(energies, F.array_min(energies)).cast("int") - 1)

    return _once(F.greatest(F.lit(QUIET), F.lit(QUIET_SHARE) * _median(energies)), place)


def live_cut(energies: Column) -> Column:
    """``split_point`` of a whole buffer of blocks, as a column: null, or the sample to cut at."""
    first, count = LIVE_FROM // BLOCK, F.size(energies)
    late = F.slice(energies, first + 1, F.greatest(count - first, F.lit(0)))

    def place(limit: Column) -> Column:
        quiet = F.array_max(F.filter(F.transform(late, lambda e, i: F.when(e < limit, i)), lambda i: i.isNotNull()))
        return F.coalesce(quiet, F.when(count >= LIVE_TO // BLOCK, F.array_position(late, F.array_min(late)).cast("int") - 1))

    found = _once(F.greatest(F.lit(QUIET), F.lit(QUIET_SHARE) * _median(energies)), place)
    return F.when(count >= first, ((found + first) * BLOCK + BLOCK // 2).cast("long"))


def voiced(frames: DataFrame) -> DataFrame:
    """Frames (with ``rms`` and the recording's ``threshold``) that are loud enough to be speech."""
    return frames.where(F.col("rms") >= F.sqrt("threshold"))


def span_windows(tiles_: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end, label, e0, e1) of spans (key, start, end, label): the mean squares of a span's 200 ms windows, e0 for
    those that begin a multiple of a block after its start and e1 for those half a block later.

    Every cut is in the middle of a window, so chunks begin on the one grid and on the other by turns, and no other windows
    are ever asked for; both are made of the same half windows. The tiles of a block are one row of sums, put together before
    anything is shuffled or sorted, and blocks and spans meet by the second, so nothing but a span's half windows comes
    together, as one row of sums for each of its seconds. A tile that isn't there is silent.
    """
    half, per_second = BLOCK // 2, RATE // BLOCK
    by_place = lambda place, n: [F.sum(F.when(place == i, F.col("sum_sq"))).alias(f"s{i}") for i in range(n)]
    row = lambda n: F.array(*(f"s{i}" for i in range(n)))
    each = spans.select(key, "start", "end", "label").withColumn("span", F.struct("start", "end", "label"))
    seconds = F.sequence(F.floor(F.col("start") / RATE), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / RATE))
    blocks = tiles_.groupBy(key, F.floor(F.col("tile_idx") / TILES).alias("block")).agg(*by_place(F.pmod("tile_idx", F.lit(TILES)), TILES)).withColumn("second", F.floor(F.col("block") / per_second))
    met = blocks.join(each.select(key, "span", F.explode(seconds).alias("second")), [key, "second"])
    heard = met.select(key, "span", "block", F.posexplode(row(TILES)).alias("i", "sum_sq")).withColumn("at", F.col("block") * BLOCK + F.col("i") * TILE)
    heard = heard.where("sum_sq is not null and at >= span.start and at < span.end").withColumn("half", F.floor((F.col("at") - F.col("span.start")) / half))
    windows = [F.greatest(F.floor((F.col("end") - F.col("start") - g * half) / BLOCK), F.lit(0)).cast("long") + 1 for g in (0, 1)]
    last = F.floor(F.greatest(windows[0] * 2 - 1, windows[1] * 2) / (2 * per_second))
    silent = each.select(key, "span", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("nth"), F.lit(0).cast("long").alias("place"), F.lit(0.0).alias("sum_sq"))
    heard = heard.select(key, "span", F.floor(F.col("half") / (2 * per_second)).alias("nth"), (F.col("half") % (2 * per_second)).alias("place"), "sum_sq")
    sums = heard.unionByName(silent).groupBy(key, "span", "nth").agg(*by_place(F.col("place"), 2 * per_second))
    rows = F.array_sort(F.collect_list(F.struct("nth", F.transform(row(2 * per_second), lambda x: F.coalesce(x, F.lit(0.0))).alias("s"))))
    held = sums.groupBy(key, "span").agg(F.flatten(F.transform(rows, lambda x: x["s"])).alias("h")).select(key, "span.*", "h")
    two = lambda g: lambda w: (F.get("h", (w * 2 + g).cast("int")) + F.get("h", (w * 2 + g + 1).cast("int"))) / BLOCK
    return held.select(key, "start", "end", "label", *(F.transform(F.sequence(F.lit(0).cast("long"), windows[g] - 1), two(g)).alias(f"e{g}") for g in (0, 1)))


def chunks(tiles_: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, label, start, end) of spans (key, start, end, label), none crossing a span: at most 20 s each, and while more
    remains, cut in the middle of a window between 12 s and 20 s (``cut_window``).

    The rule goes from cut to cut, so it is a fold over a span's windows, in the JVM; spans are independent.
    """
    windows, most = (CHUNK_TO - CHUNK_FROM) // BLOCK, F.ceil((F.col("end") - F.col("start")) / CHUNK_FROM)

    def step(done: Column, nth: Column) -> Column:
        low = done["at"] + CHUNK_FROM
        first = ((low - F.col("start")) / BLOCK).cast("int")  # on the other grid a window begins half a block later
        range_ = F.slice(F.when(nth % 2 == 0, F.col("e0")).otherwise(F.col("e1")), first + 1, F.lit(windows))
        cut = low + cut_window(range_) * BLOCK + BLOCK // 2
        to = F.when(done["at"] + CHUNK_TO >= F.col("end"), F.col("end")).otherwise(cut)
        return F.when(done["at"] >= F.col("end"), done).otherwise(_once(to, lambda t: F.struct(t.alias("at"), F.array_append(done["cuts"], F.struct(done["at"].alias("start"), t.alias("end"))).alias("cuts"))))

    none = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("cuts"))
    folded = F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(most, F.lit(1)).cast("long")), none, step)
    return span_windows(tiles_, spans, key).select(key, "label", F.inline(folded["cuts"]))


def split_point(energy: np.ndarray, samples: int) -> int | None:
    """Where a growing buffer with these block energies is cut, if anywhere: from 6 s on in the middle of the last quiet
    block after 6 s, or, when 20 s have come without any, in the middle of the first of the least energy."""
    skipped = LIVE_FROM // BLOCK
    late = energy[skipped:]
    if samples < LIVE_FROM or not len(late):
        return None
    quiet = late < max(QUIET, QUIET_SHARE * float(np.median(energy)))
    # Quiet blocks come before others, later ones first; others by their energy.
    best = np.lexsort((np.where(quiet, -np.arange(len(late)), late), ~quiet))[0]
    return int(skipped + best) * BLOCK + BLOCK // 2 if quiet[best] or samples >= LIVE_TO else None


def cut_samples(runs: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, start, end, ...) with their ``samples``, from runs (key, offset, samples) of a second or so.

    Runs and spans meet by the second, and only one span's samples come together. What no run covers isn't there; a span
    without any samples has none, and is left out.
    """
    seconds = lambda start, end: F.explode(F.sequence(F.floor(start / RATE), F.floor(F.greatest(end - 1, start) / RATE))).alias("second")
    others = [c for c in spans.columns if c != key]
    each = spans.select(key, F.struct(*others).alias("span"), seconds(F.col("start"), F.col("end")))
    # A run that crosses a second is cut there, so each of its samples is sent for each span once.
    parts = runs.select(key, "offset", "samples", seconds(F.col("offset"), F.col("offset") + F.size("samples")))
    met = parts.join(each, [key, "second"])
    low = F.greatest(F.col("offset"), F.col("span.start"), F.col("second") * RATE)
    high = F.least(F.col("offset") + F.size("samples"), F.col("span.end"), (F.col("second") + 1) * RATE)
    met = met.withColumns({"low": low, "high": high}).where("high > low")
    piece = F.struct("low", F.slice("samples", (F.col("low") - F.col("offset") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")).alias("s"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["s"]))
    return met.groupBy(key, "span").agg(joined.alias("samples")).select(key, "span.*", "samples")


def gate_file(chunks_: DataFrame) -> DataFrame:
    """Chunks (with ``peak`` in sample units) that aren't silent."""
    return chunks_.where(F.col("peak") / 32768.0 >= SILENT_PEAK)


def gate_live(segments: DataFrame) -> DataFrame:
    """Segments (with ``sum_sq`` and ``n``) that aren't silent."""
    return segments.where(F.sqrt(F.col("sum_sq") / F.col("n")) >= SILENT_RMS)


def averaged(x: Column, y: Column, kind: str = "smallint") -> Column:
    """The average, rounded down, of two arrays of samples as far as both go. An average lies between its samples, so it is of
    their ``kind`` too."""
    n = F.least(F.size(x), F.size(y))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: F.shiftright(p.cast("long") + q.cast("long"), 1).cast(kind))


def mix(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tile_idx, samples): the average, rounded down, of two streams' tiles where both have samples; of the wider kind of
    the two."""
    kind = max((d.schema["samples"].dataType.elementType.simpleString() for d in (a, b)), key=("tinyint", "smallint", "int").index)
    both = a.select(*keys, "tile_idx", F.col("samples").alias("x")).join(b.select(*keys, "tile_idx", F.col("samples").alias("y")), [*keys, "tile_idx"])
    return both.select(*keys, "tile_idx", averaged(F.col("x"), F.col("y"), kind).alias("samples"))


def padding(rows: DataFrame, slack: int = PAD_SLACK) -> DataFrame:
    """Adds how much silence a chunk gets: what is missing to the expected length, if that is over ``slack``."""
    short = F.col("expected") - F.col("produced") - F.col("n")
    return rows.withColumn("padding", F.when(short > slack, short).otherwise(0))


def fold_padding(produced: int, n: int, expected: int, slack: int = PAD_SLACK) -> int:
    """The silence that follows a chunk of ``n`` samples after ``produced`` ones, when ``expected`` should have come by then."""
    missing = expected - produced - n
    return missing if missing > slack else 0


def pad_chunks(rows: DataFrame, key: str, slack: int = PAD_SLACK) -> DataFrame:
    """(key, seq, offset, padding, samples) of chunks (key, seq, expected, samples) in order of ``seq``: each followed by as much
    silence as brings the stream to what was expected by then, if it is over ``slack`` behind, and where it begins.

    How far a stream has come depends on all silence before, so the rule goes from chunk to chunk; only their lengths go
    through it together, a few numbers a chunk, and samples are filled where they are.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own, produced, out = own.sort_values("seq"), 0, []
        for n, expected in zip(own["n"].tolist(), own["expected"].tolist(), strict=True):
            silence = fold_padding(produced, n, expected, slack)
            out.append((produced, silence))
            produced += n + silence
        return own[[key, "seq"]].assign(offset=[o for o, _ in out], padding=[p for _, p in out])

    kinds = f"{key} {rows.schema[key].dataType.simpleString()}, seq {rows.schema['seq'].dataType.simpleString()}, offset long, padding long"
    lengths = rows.select(key, "seq", F.col("expected").cast("long").alias("expected"), F.coalesce(F.size("samples"), F.lit(0)).cast("long").alias("n"))
    folded = lengths.groupBy(key).applyInPandas(run, kinds)
    silence = F.array_repeat(F.lit(0).cast("smallint"), F.col("padding").cast("int"))
    return rows.join(folded, [key, "seq"]).select(key, "seq", "offset", "padding", F.concat(F.coalesce("samples", F.array().cast("array<smallint>")), silence).alias("samples"))
