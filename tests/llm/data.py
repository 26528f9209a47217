"""Small tables with every awkward case."""

import random

#: Extra columns have names that the operators use themselves.
CLASHING = ("shingle", "owner", "rank", "size", "score", "held_out", "label", "id", "fp", "word", "mark", "at", "part", "pii_values", "media", "train", "points", "level", "copies")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def documents(spark, rows=None, partitions=3):
    """Nulls in every column, an empty and a blank text, repeated rows, equal ids, a long text, and extra columns whose
    names the operators use themselves."""
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).repartition(partitions)


def row(i, text, source="src0", lang="en"):
    return (i, text, lang, source, None if text is None else len(text), *["x"] * len(CLASHING))


def words(seed, n):
    own = random.Random(seed)
    return " ".join(own.choice("the and Of ered tion ouble sher, an. in réeux ächlich".split()) + own.choice(["", "", "s", "ing"]) for _ in range(n))


def awkward():
    rows = [row(i, words(i, 20 + i), f"src{i % 4}") for i in range(1, 25)]
    rows += [row(30, None), row(31, ""), row(32, " \n\t "), row(None, words(99, 30), None), row(None, None, None, None), row(33, words(1, 21)), row(34, words(34, 3000), "src1")]
    rows += [row(40, "same same text", "src2")] * 2 + [row(41, "one text"), row(41, "another text")]
    rows += [row(50, "日本語 текст ~ 🙂🙂 ﬁ x"), row(51, "word"), row(52, "two words"), row(53, "a" * 5000)]
    return rows


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
