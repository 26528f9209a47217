import random
import re
import time

from pyspark.sql import functions as F

from scribelake.functions import text as X

LOOP = re.compile(r"(.{1,30}?)(?:\s*\1){4,}")


def made(own):
    letters = own.choice(["ab ", "ab \n", "a \t\n　", "ab가\U0001f600 ", "abcdefgh \n"])
    some = lambda n: "".join(own.choice(letters) for _ in range(n))
    gap = lambda: "".join(own.choice(" \n\t") for _ in range(own.choice([0, 0, 1, 3])))
    parts = []
    for _ in range(own.randint(1, 8)):
        word = some(own.randint(1, 33))
        parts.append("".join(word + gap() for _ in range(own.choice([1, 1, 2, 4, 5, 6, 8]))))
    return "".join(parts)


def test_like_the_pattern_on_the_whole_text(spark):
    own = random.Random(8)
    texts = [made(own) for _ in range(3000)] + ["", " ", "a", "a" * 5, " " * 5, "\n" * 9, " \n" * 5, ("x" * 31) * 5, ("x" * 30 + "y") * 6, "　ab" * 5 + "ab"]
    want = [LOOP.sub(r"\1", t) for t in texts]
    assert [X.collapsed(t) for t in texts] == want
    assert sum(t != w for t, w in zip(texts, want, strict=True)) > 1000
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[-300:], None])], "i int, t string").select("i", X.collapse_repeats(F.col("t")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in rows} == dict(enumerate([*(w.strip() for w in want[-300:]), None]))


def test_time_is_not_that_of_thirty_lengths_at_every_character():
    own = random.Random(9)
    text = " ".join("".join(own.choice("abcdefghijklmnop") for _ in range(own.randint(2, 9))) for _ in range(60_000))

    def timed(f):
        start = time.perf_counter()
        return f(text), time.perf_counter() - start

    (got, here), (want, there) = timed(X.collapsed), timed(lambda t: LOOP.sub(r"\1", t))
    assert got == want and here * 4 < there
