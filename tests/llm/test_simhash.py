import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from scribelake.llm import simhash
from scribelake.llm.components import connected_components
from tests.llm.data import SCHEMA, awkward, documents, row, words


def plain_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    """Component by fingerprint, over all pairs."""
    nodes, parent = sorted(set(prints)), {}
    for n in nodes:
        parent[n] = n

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(b)] = find(a)
    return {n: find(n) for n in nodes}


def check(spark, rows, docs):
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    part = plain_components([f for _, f in prints])
    heads = defaultdict(list)
    for i, f in prints:
        if i is not None:
            heads[part[f]].append(i)
    want = Counter((i, f"{f:016x}", min(heads[part[f]], default=None)) for i, f in prints)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()) == want


def test_like_all_pairs(spark):
    rows = awkward()
    base = words(7, 120).split()
    for i in range(100, 160):  # near copies and copies of them
        own = list(base)
        own[i % 100] = f"w{i}"
        rows.append(row(i, " ".join(own)))
    check(spark, rows, documents(spark, rows))


def test_native_hash_agrees(spark):
    assert spark.sql("select xxhash64('one two three') as h").first()["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"one two three", 42)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_connect_all_near_fingerprints(spark, radius):
    own = random.Random(radius)
    prints = [own.getrandbits(64) for _ in range(30)]
    for _ in range(120):
        f = own.choice(prints)
        for _ in range(own.randint(1, 3)):
            f ^= 1 << own.randrange(64)
        prints.append(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = simhash.links(spark.createDataFrame([(signed(f),) for f in set(prints)], "fp long"), radius)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > radius).isEmpty()
    parts = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = plain_components(prints, radius)
    for a in set(prints):
        for b in set(prints):
            assert (parts.get(signed(a), signed(a)) == parts.get(signed(b), signed(b))) == (want[a] == want[b])


def test_components_of_chains_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1001), (1001, 1000), (None, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(chain).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0] and len(roots) == 303
    assert connected_components(chain.limit(0)).count() == 0


def test_keep_one_of_each_group(spark):
    rows = awkward()
    part = plain_components([plain_fingerprint(r[1]) for r in rows])
    first = {}
    for r in rows:
        if r[0] is not None:
            group = part[plain_fingerprint(r[1])]
            if group not in first or (r[0], plain_fingerprint(r[1])) < first[group]:
                first[group] = (r[0], plain_fingerprint(r[1]))
    kept = simhash.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    got = kept.collect()
    assert Counter((r["doc_id"], plain_fingerprint(r["text"])) for r in got if r["doc_id"] is not None) == Counter(first.values())
    assert sum(r["doc_id"] is None for r in got) == sum(r[0] is None for r in rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_a_very_long_text_counts_every_shingle():
    text = words(8, 80_000)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
