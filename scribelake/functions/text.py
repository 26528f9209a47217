"""Scalar text functions as columns. All but ``collapse_repeats`` stay in the JVM."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and patterns of the keyword rule.
STOPWORDS = (
    "화자 그리고 그래서 그런데 하지만 그러면 그러니까 이제 지금 정말 진짜 그냥 약간 이거 저거 그거 이게 그게 "
    "이렇게 저렇게 그렇게 우리 저희 여기 거기 때문 있는 없는 하는 같은 이런 그런 저런 어떤 네네 아니 근데"
).split()
PARTICLES = "으로 에서 에게 까지 부터 은 는 이 가 을 를 에 의 도 로 와 과".split()
ENDINGS = "니다 어요 아요 해요 했다 한다 하고 해서".split()
WORD = "[가-힣A-Za-z]{2,}"
DEFAULT_TITLE = "제목 없음"

#: What counts as white space, the same set as ``str.isspace``; Java's ``\s`` is ASCII only.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"
_SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(_SPACE_CHARS))


def like(c: Column, pattern: Column | str) -> Column:
    """LIKE that folds ASCII case only, has ``%`` and ``_`` as wildcards and knows no escape character.

    A constant pattern becomes a regular expression, whose case folding in Java is ASCII only: one search, without a
    folded copy of the text. A column of patterns is folded on both sides.
    """
    if isinstance(pattern, str):
        return c.rlike(_like_pattern(pattern))
    fold = lambda x: F.translate(x, _UPPER, _LOWER)
    return F.like(fold(c), fold(pattern), F.lit("\u0001"))


def _like_pattern(pattern: str) -> str:
    inner = pattern.strip("%") if pattern.strip("%") else ""
    start, end = "" if pattern.startswith("%") else r"\A", "" if pattern.endswith("%") else r"\z"
    if not inner and pattern:
        return "(?s)"
    # Between \Q and \E all is literal, but for an \E, which is put between two such pieces.
    literal = lambda t: r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" if t else ""
    parts = [".*" if p.startswith("%") else "." * len(p) if p.startswith("_") else literal(p) for p in re.findall("%+|_+|[^%_]+", inner)]
    return "(?si)" + start + "".join(parts) + end


def like_sql(c: str, pattern: str) -> str:
    return f"translate({c}, '{_UPPER}', '{_LOWER}') LIKE translate('{pattern}', '{_UPPER}', '{_LOWER}')"


_LOOP = re.compile(r"(.{1,30}?)(?:\s*\1){4,}")
_IS_SPACE = np.array([c.isspace() for c in map(chr, range(0x3002))])


def repeating(text: str, longest: int = 30, times: int = 5) -> list[tuple[int, int]]:
    """Stretches (start, end) outside of which nothing can match ``_LOOP``, in order and apart from each other.

    Without white space, a phrase that comes ``times`` times in a row is as many periods of at most ``longest`` characters, or
    it is white space alone. Each stretch has the white space on both sides, as a phrase may begin or end with it.
    """
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _IS_SPACE[np.minimum(chars, len(_IS_SPACE) - 1)]
    at = np.flatnonzero(~space)
    edges = np.concatenate([[-1], at, [len(chars)]])  # white space is between two of them
    wide = np.flatnonzero(np.diff(edges) > times)
    starts, ends = [edges[wide] + 1], [edges[wide + 1]]
    kept = chars[at]
    for period in range(1, min(longest, len(kept) // times) + 1):
        other = np.flatnonzero(kept[period:] != kept[:-period])
        other = np.concatenate([[-1], other, [len(kept) - period]])
        run = np.flatnonzero(np.diff(other) > (times - 1) * period)
        starts.append(edges[other[run] + 1] + 1)  # after the last character before the run
        ends.append(edges[other[run + 1] + period + 1])
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for start, end in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def collapsed(text: str) -> str:
    """``text`` with each match of ``_LOOP`` kept once. Only stretches that repeat are searched."""
    parts, done = [], 0
    for start, end in repeating(text):
        parts += [text[done:start], _LOOP.sub(r"\1", text[start:end])]
        done = end
    return "".join([*parts, text[done:]])


def collapse_repeats(c: Column) -> Column:
    """A phrase of up to 30 characters that comes five times or more in a row is kept once; then stripped.

    A pattern engine tries 30 lengths at every character; numpy compares the text with itself instead, by Arrow batches, and
    the pattern decides only where it repeats.
    """

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else collapsed(t) for t in texts.to_pylist()], pa.string())

    return strip(of(c))


def format_duration(seconds: Column) -> Column:
    """``m:ss`` or ``h:mm:ss``, rounded half up; null is a dash."""
    s = F.floor(seconds + 0.5).cast("long")
    short = F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)
    return F.when(seconds.isNull(), "—").when(s >= 3600, long).otherwise(short)


def format_date(unix_seconds: Column) -> Column:
    """In the session's time zone."""
    return F.date_format(F.timestamp_seconds(unix_seconds), "yyyy.MM.dd HH:mm")


def format_mib(mib: Column) -> Column:
    return F.when(mib >= 1024, F.format_string("%.1f GB", F.round(mib / 1024, 1))).otherwise(F.format_string("%d MB", F.floor(mib + 0.5).cast("long")))


def live_clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)


def count_occurrences(text: Column, needle: Column | str) -> Column:
    """Literal, case-sensitive, without overlaps; an empty needle has none."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.when(F.length(n) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, n, F.lit("")))) / F.greatest(F.length(n), F.lit(1))).cast("int"))


def find_next(text: Column, needle: Column, after: Column) -> Column:
    """1-based place of the first match at or after ``after``, else of the first one; 0 if there is none or no needle.
    Places are code points."""
    at = F.position(needle, text, F.greatest(after, F.lit(1)))
    return F.when(F.length(needle) == 0, 0).when(at > 0, at).otherwise(F.position(needle, text))


def replace_all(text: Column, needle: Column, new: Column) -> Column:
    return F.when(F.length(needle) == 0, text).otherwise(F.replace(text, needle, new))


def replace_one(text: Column, needle: Column, new: Column, at: Column) -> Column:
    """Only if the needle is just there."""
    there = (F.length(needle) > 0) & (F.substring(text, at, F.length(needle)) == needle)
    return F.when(there, F.overlay(text, new, at, F.length(needle))).otherwise(text)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def file_stem(path: Column) -> Column:
    """The last part without its last suffix; a name that only starts with a dot has none."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def title_or_default(title: Column) -> Column:
    return F.coalesce(F.nullif(strip(title), F.lit("")), F.lit(DEFAULT_TITLE))


def live_title(unix_seconds: Column) -> Column:
    return F.concat(F.lit("실시간 전사 "), F.date_format(F.timestamp_seconds(unix_seconds), "yyyy-MM-dd HH:mm"))


def audio_name(now: Column, path: Column) -> Column:
    return F.concat_ws("-", F.floor(now).cast("long").cast("string"), basename(path))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` becomes the value of that name; a null value and an unknown name become nothing. The template is cut once, so
    braces in a value stay as they are."""
    place = r"\{(\w+)\}"
    known = F.create_map(*(c for name, value in values.items() for c in (F.lit(name), F.coalesce(value.cast("string"), F.lit(""))))) if values else F.create_map().cast("map<string,string>")
    filled = F.transform(F.regexp_extract_all(template, F.lit(place), F.lit(1)), lambda name: F.coalesce(F.element_at(known, name), F.lit("")))
    return F.array_join(F.zip_with(F.split(template, place, -1), filled, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit("")))), "")


def parse_query(query: Column, key: str) -> Column:
    """The first value of a key; a blank one counts as absent."""
    found = F.regexp_extract(query, rf"(?:^|[?&]){re.escape(key)}=([^&#]+)", 1)
    return F.nullif(F.url_decode(F.replace(found, F.lit("+"), F.lit(" "))), F.lit(""))


def parse_body(body: Column, schema: str) -> Column:
    """A JSON body's fields; what isn't JSON, or not of the type, is null."""
    return F.from_json(body, schema, {"mode": "PERMISSIVE"})


def toggle(chosen: Column, one: Column) -> Column:
    """A set of ids with one id added or taken away."""
    return F.when(F.array_contains(chosen, one), F.array_except(chosen, F.array(one))).otherwise(F.array_union(chosen, F.array(one)))


def toggle_all(chosen: Column, everything: Column) -> Column:
    """None if all are chosen (and there are any), else all of them too."""
    full = (F.size(everything) > 0) & F.forall(everything, lambda x: F.array_contains(chosen, x))
    return F.when(full, F.array_except(chosen, everything)).otherwise(F.array_union(chosen, everything))


def pick_device(wanted: Column, available: Column) -> Column:
    """The wanted one if it is there, else the first, else none."""
    return F.coalesce(F.when(F.array_contains(available, wanted), wanted), F.get(available, F.lit(0)), F.lit(""))


def device_kinds(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(names, lambda x: F.split_part(x, F.lit("."), F.lit(1)))))


def audio_devices(listing: Column) -> Column:
    return F.regexp_extract_all(listing, F.lit(r'"([^"]+)" \(audio\)'), F.lit(1))
