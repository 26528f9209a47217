"""The filter audit against a plain walk through every order."""

import random
from itertools import permutations

from scribelake.llm import audit
from tests.llm import data

FILTERS = "ABCDE"


def plain(docs, labels):
    """(part, order, step) -> the counts, document by document."""
    smallest, marks = {}, {}
    for i, text, *_ in docs:
        if i is not None:
            smallest[text or ""] = min(smallest.get(text or "", i), i)
    for i, good, toxic in labels:
        was = marks.get(i, (False, False))
        marks[i] = (was[0] or good == 1, was[1] or toxic == 1)
    parts = {}
    for i, text, lang, *_ in docs:
        t = text or ""
        w = t.encode().split()
        fails = {f for f, c in zip(FILTERS, (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and smallest[t] < i), strict=True) if c}
        parts.setdefault(lang or "", []).append((fails, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys(FILTERS, 0)
        for order in permutations(FILTERS):
            left = list(range(len(rows)))
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in rows[k][0]]
                redundant = sum(f in rows[k][0] for k in range(len(rows)) if k not in left)
                left = [k for k in left if f not in rows[k][0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(r[0] == {f} for r in rows), sum(rows[k][1] for k in gone), sum(rows[k][2] for k in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def check(spark, docs, labels):
    got = audit.audit_filters(data.documents(spark, docs), data.labels(spark, labels)).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in got}) == len(got)
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in got)
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got} == plain(docs, labels)


def test_awkward_rows_and_labels(spark):
    check(spark, data.awkward(), [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (34, 1, 0), (40, 0, 1), (53, 1, 1), (999, 1, 1)])


def test_every_set_of_failures(spark):
    """Texts that fail each of the 16 sets of the first four, most of them copied, in two parts and one that is null."""
    docs, own = [], random.Random(1)
    for mask in range(16):
        words = [f"w{own.randrange(9) if mask & 2 else k}x" for k in range(50 if mask & 1 else 260)]
        if mask & 4:
            words = [w.upper() for w in words]
        text = " ".join(words) + (" %" if mask & 8 else "") + f" end{mask}"
        for k in range(own.randrange(1, 4)):
            docs.append(data.row(own.randrange(10**6), text, lang=own.choice(["en", "fr", None, ""])))
    check(spark, docs, [(d[0], own.randrange(2), own.randrange(2)) for d in docs[::2]])


def test_long_texts_and_a_large_group(spark):
    """A text of a hundred thousand words, and four hundred copies with null and equal ids among them."""
    docs = [data.row(1, data.words(1, 100_000))] + [data.row(None if k % 7 == 0 else k // 2, "copy " * 210) for k in range(400)]
    check(spark, docs, [(3, 1, 1)])


def test_empty_tables(spark):
    assert audit.audit_filters(data.documents(spark, []), data.labels(spark, [(1, 1, 1)])).collect() == []
    check(spark, data.awkward()[:5], [])


def test_edges_and_steps(spark):
    assert audit.edges(spark).count() == 80
    assert audit.steps(spark).count() == 600
    assert audit.steps(spark).select("before", "filter").distinct().count() == 80
