"""From one sample rate to another by a windowed-sinc filter, all phases at once.

A sample of the result depends on a bounded stretch of the source, so any part of a recording can be made from that part and
a margin at either side, and parts are equal to the whole.
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np

#: Zero crossings of the sinc at either side, the Kaiser window's shape, and where the filter begins to close, as a share of
#: the lower of the two rates' halves. Above that half it damps by 60 dB and more.
CROSSINGS, BETA, PASS = 64, 8.0, 0.92


@lru_cache(maxsize=16)
def _phases(rate: int, to: int) -> tuple[np.ndarray, int]:
    """(phases x taps, reach): the filter for each place between two samples that a sample of the result can have."""
    up = to // gcd(rate, to)
    cutoff = min(1.0, to / rate) * PASS
    reach = int(np.ceil(CROSSINGS / cutoff))
    taps = np.arange(-reach + 1, reach + 1)
    at = taps[None, :] - np.arange(up)[:, None] / up
    window = np.i0(BETA * np.sqrt(np.clip(1 - (at / reach) ** 2, 0, None))) / np.i0(BETA)
    made = cutoff * np.sinc(cutoff * at) * window
    return made / made.sum(axis=1, keepdims=True), reach


def resampled_length(n: int, rate: int, to: int) -> int:
    """Samples at ``to`` of ``n`` samples at ``rate``: rounded, but one at least of some sound."""
    return n if rate == to else max(1, round(n * to / rate)) if n else 0


def source_range(start: int, end: int, rate: int, to: int) -> tuple[int, int]:
    """Which samples of the source those from ``start`` to ``end`` of the result depend on; it may begin below 0."""
    if rate == to:
        return start, end
    reach = _phases(rate, to)[1]
    return start * rate // to - reach + 1, (end - 1) * rate // to + reach + 1


def resample(part: np.ndarray, first: int, start: int, end: int, rate: int, to: int, block: int = 4096) -> np.ndarray:
    """Samples ``start`` to ``end`` of the result, from the source's samples ``first`` and on. What isn't there is silent."""
    if rate == to:
        return np.asarray(part[start - first : end - first], np.float64)
    phases, reach = _phases(rate, to)
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    low, high = source_range(start, end, rate, to)
    padded = np.zeros(high - low)
    a, b = max(low, first), min(high, first + len(part))
    if b > a:
        padded[a - low : b - low] = part[a - first : b - first]
    out = np.empty(end - start)
    for at in range(start, end, block):
        n = np.arange(at, min(end, at + block), dtype=np.int64)
        centre, phase = n * down // up, n * down % up
        rows = padded[(centre - reach + 1 - low)[:, None] + np.arange(2 * reach)[None, :]]
        out[at - start : at - start + len(n)] = np.einsum("ij,ij->i", rows, phases[phase])
    return out
