"""Format-preserving pseudonyms for private values (DataFrame functions only).

Values are found by pattern and validated (Luhn, octet range, calendar, check digits mod 97). A value's variable
characters then go through a keyed four-round Feistel network over its own format: each half is shifted, character by
character within its class (digit, lower case, upper case), by a keystream that SHA-256 derives from key, kind, round
and the other half. So the mapping is a permutation of the format, separators and case stay, and equal values stay
linked across documents. Checksums are set anew, so a pseudonym is as valid as what it replaces.
"""

from __future__ import annotations

import os
import secrets
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 4
#: The DAY_HIGH x DAY_LOW = 73,049 days from FIRST_DAY to 2099-12-31, all that the pattern knows, are permuted.
FIRST_DAY, DAY_HIGH, DAY_LOW = "1900-01-01", 4297, 17
#: Where the session names the key, and where that is kept otherwise.
KEY_SETTING, KEY_VARIABLE = "spark.scribelake.pseudonym.secret", "SCRIBELAKE_PSEUDONYM_SECRET"
#: Letters that move among themselves, besides digits and ASCII letters: first and last code point. Other letters stay.
LETTERS = {
    "latin small": (0xE0, 0xF6), "latin capital": (0xC0, 0xD6), "greek small": (0x3B1, 0x3C1), "greek capital": (0x391, 0x3A1), "cyrillic capital": (0x410, 0x42F), "cyrillic small": (0x430, 0x44F),
    "hebrew": (0x5D0, 0x5EA), "arabic": (0x628, 0x63A), "devanagari": (0x915, 0x939), "thai": (0xE01, 0xE2E), "hiragana": (0x3042, 0x3093), "katakana": (0x30A2, 0x30F3), "han": (0x4E00, 0x9FA5), "hangul": (0xAC00, 0xD7A3),
}
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999

_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: In this order; the first that matches at a place wins there.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "iban": _B + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _E,
    "date": _B + r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}" + _E,
    "ssn": _B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _E,
    "phone": r"(?:(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?|(?<![\p{L}\p{N}]))(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _E
    + r"|(?<![\p{L}\p{N}+])\+(?=(?:[ ./()-]{0,2}[0-9]){8,15}" + _E + r")[1-9][0-9]{0,2}(?:[ ./-]?\(?[0-9]{1,6}\)?){1,6}" + _E,
    "ip": r"(?<![\p{L}\p{N}.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![\p{L}\p{N}]|\.[0-9])",
    "card": _B + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _E,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = tuple(PATTERNS)


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digest(key: str, tweak: str, i: Column, other: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), i.cast("string"), F.lit("|"), other.cast("string")), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _wide(c: Column, k: Column) -> Column:
    """A letter moved by ``k`` within its alphabet of LETTERS, looked up in one array; any other character as it is."""
    alphabets = F.expr("array(" + ", ".join(f"named_struct('first', {a}L, 'n', {b - a + 1}L)" for a, b in LETTERS.values()) + ")")
    point = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long")
    place = lambda a: (point - a["first"] + k) % a["n"] + a["first"]
    holds = lambda a: (point >= a["first"]) & (point < a["first"] + a["n"])
    new = F.transform(F.filter(alphabets, holds), lambda a: F.decode(F.unhex(F.lpad(F.hex(place(a)), 4, "0")), "UTF-16BE"))
    return F.coalesce(F.get(new, F.lit(0)), c)


def _shift(text: Column, digest: Column, letters: bool) -> Column:
    """Each digit, ASCII letter or, if wanted, letter of LETTERS moved within its class by its own place in a keystream;
    others stay."""

    def one(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        # A digest serves 14 places; after them the stream goes on with the digest of the digest and a block number.
        block = F.floor((i - 1) / 14).cast("int")
        stream = F.when(block == 0, digest).otherwise(F.sha2(F.concat(digest, block.cast("string")), 256))
        k = F.conv(F.substring(stream, (i - 1) % 14 * 4 + 1, F.lit(4)), 16, 10).cast("long")
        moved = lambda first, n: F.char((F.ascii(c) - ord(first) + k) % n + ord(first))
        near = F.when(c.between("0", "9"), moved("0", 10)).when(c.between("a", "z"), moved("a", 26)).when(c.between("A", "Z"), moved("A", 26))
        return near.when(c < "\x80", c).otherwise(_wide(c, k)) if letters else near.otherwise(c)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), one), ""))


def _rounds(a: Column, b: Column, change) -> Column:
    """Feistel: by turns, half ``a`` and half ``b`` become ``change(i, half, other)``. The half whose turn it is comes first, so
    all rounds are one expression; after an even number of them the halves are in their places."""
    step = lambda s, i: F.struct(s["b"].alias("a"), change(i, s["a"], s["b"]).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.alias("a"), b.alias("b")), step)


def permute_text(text: Column, key: str, tweak: str, letters: bool = False) -> Column:
    """Feistel over a string's two halves. Classes and places of characters stay, so it is a permutation of the format."""
    half = F.floor(F.length(text) / 2).cast("int")
    change = lambda i, mine, other: _let(_digest(key, tweak, i, other), lambda d: _shift(mine, d, letters))
    return _let(_rounds(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)), change), lambda s: F.concat(s["a"], s["b"]))


def permute_pair(high: Column, low: Column, highs: int, lows: int, key: str, tweak: str) -> Column:
    """Feistel over the numbers 0..highs x lows - 1, as a struct (a, b) of high and low part."""
    change = lambda i, mine, other: (mine + _number(_digest(key, tweak, i, other))) % F.when(i % 2 == 0, highs).otherwise(lows)
    return _rounds(high.cast("long"), low.cast("long"), change)


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum; ``doubled``: 0 if the last digit is doubled (a body without its check digit), 1 if the one before."""
    place = lambda i: F.substring(digits, -i - 1, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == doubled, (place(i) * 2) % 10 + F.when(place(i) > 4, 1).otherwise(0)).otherwise(place(i))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """Of digits and upper-case letters, letters counting 10 to 35."""
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: code(F.substring(text, i, F.lit(1)))), F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _email(m: Column, key: str) -> Column:
    """All before the last two labels of the domain, so that the domain's owner stays."""
    tail = F.regexp_extract(m, r"(?:@|\.)([^@.]+\.[^@.]+)$", 0)
    return F.concat(permute_text(F.substring(m, F.lit(1), F.length(m) - F.length(tail)), key, "email", letters=True), tail)


def _iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country, body = F.substring(m, 1, 2), F.substring(m, F.lit(5), F.length(m))

    def made(new: Column) -> Column:
        check = 98 - mod97(F.concat(F.regexp_replace(new, " ", ""), country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

    valid = mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1
    return F.when(valid, _let(permute_text(body, key, "iban"), made)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    day = F.datediff(m.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    new = _let(permute_pair(F.floor(day / DAY_LOW), day % DAY_LOW, DAY_HIGH, DAY_LOW, key, "date"), lambda s: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAY_LOW + s["b"]).cast("int")), "yyyy-MM-dd"))
    return F.when(day.between(0, DAY_HIGH * DAY_LOW - 1), new).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # areas 001 to 899 without 666

    def text(s: Column) -> Column:
        at = F.floor(s["a"] / 99)
        parts = (F.when(at >= 665, at + 2).otherwise(at + 1), 3), (s["a"] % 99 + 1, 2), (s["b"] + 1, 4)
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in parts))

    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, _let(permute_pair(index * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"), text)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}[ .-]?", 0)
    return F.concat(country, permute_text(F.substring(m, F.length(country) + 1, F.length(m)), key, "phone"))


def _ip(m: Column, key: str) -> Column:
    octet = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("int")
    text = lambda s: F.concat_ws(".", *((F.floor(x / 256) if top else x % 256).cast("string") for x in (s["a"], s["b"]) for top in (1, 0)))
    return _let(permute_pair(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536, key, "ip"), text)


def _card(m: Column, key: str) -> Column:
    """All digits but the last, which is Luhn's check digit and set anew."""
    made = lambda new: F.concat(new, ((F.lit(10) - luhn_sum(_digits(new), 0) % 10) % 10).cast("string"))
    return F.when(luhn_sum(_digits(m), 1) % 10 == 0, _let(permute_text(F.substring(m, F.lit(1), F.length(m) - 1), key, "card"), made)).otherwise(m)


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "ip": _ip, "card": _card}


def kind_of(match: Column) -> Column:
    """Which pattern a match is of, told by its shape."""
    out = F.when(match.contains("@"), "email").when(match.rlike("^[A-Z]"), "iban").when(match.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date").when(match.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    return out.when(match.rlike(r"^\+|^\(|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"), "phone").when(match.rlike(r"^[0-9]+\."), "ip").otherwise("card")


def pseudonym(match: Column, key: str) -> Column:
    """What stands for a match; a match that isn't valid (check digit, calendar) stands as it is."""

    def made(kind: Column) -> Column:
        out = F.when(kind == KINDS[0], _MAKERS[KINDS[0]](match, key))
        for k in KINDS[1:]:
            out = out.when(kind == k, _MAKERS[k](match, key))
        return out

    return _let(kind_of(match), made)


def session_key(spark: SparkSession) -> str:
    """The secret of ``KEY_SETTING``, else of the environment's ``KEY_VARIABLE``, else one drawn at random and kept for the
    session's life, with a warning: then values stay linked within the session only, and nobody can turn them back. There is
    no built-in key."""
    key = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    if not key:
        warnings.warn(f"no {KEY_SETTING} is set: pseudonyms will not agree with those of other sessions", stacklevel=2)
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text", out: str = "pii_values") -> DataFrame:
    """``docs`` with private values of ``text_col`` replaced, and with ``out``: (kind, pseudonym) in text order.

    A map over rows: no shuffle, and every other column passes through. A null text stays null and an empty one empty,
    both with no values; very long texts are searched whole; repeated rows give equal results; an empty table stays empty;
    a column that is named like ``out`` already is replaced. ``key`` is a secret that isn't empty: whoever has it can turn
    pseudonyms back, and the same key gives the same pseudonyms everywhere. The plan holds it, so plans are as secret.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col(text_col)
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    value = lambda m: _let(pseudonym(m, key), lambda p: F.struct(F.when(p == m, F.lit(None)).otherwise(kind_of(m)).alias("kind"), p.alias("value")))

    def rebuilt(values: Column) -> Column:
        new = F.array_join(F.zip_with(F.split(text, ANY, -1), values["value"], lambda gap, v: F.concat(gap, F.coalesce(v, F.lit("")))), "")
        return F.struct(F.when(F.size(values) > 0, new).otherwise(text).alias("text"), F.filter(values, lambda v: v["kind"].isNotNull()).alias("values"))

    none = F.array().cast("array<struct<kind:string,value:string>>")
    made = _let(F.coalesce(F.transform(found, value), none), rebuilt)
    rows = docs.withColumn(out, made)
    return rows.withColumn(text_col, F.col(out)["text"]).withColumn(out, F.col(out)["values"])
