"""Queries on values that only larger tables have, against their SQL."""

import datetime

import duckdb
import numpy as np

from scribelake.operators import signal
from scribelake.plans.queries import ORACLES, QUERIES
from tests.test_signal import plain_chunks

START = datetime.datetime(2024, 1, 1)


def events(spark, folder, rows):
    """Writes ``events`` (event_id, user_id, event_type, value), a minute apart."""
    full = [(i, START + datetime.timedelta(minutes=n), user, kind, value, "{}") for n, (i, user, kind, value) in enumerate(rows)]
    spark.createDataFrame(full, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    own = duckdb.connect()
    own.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = own.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(map(tuple, got.select(*columns).collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)
    return rows


def test_mixed_values_beyond_sixteen_bits(spark, tmp_path):
    """Rare high values: their averages are no 16-bit samples."""
    high = [i for i in range(60_000) if (i * 7919) % 60_001 - 30_000 > 29_900][:20]
    rows = same_as_sql(spark, events(spark, tmp_path, [(i, i % 3, "view", 700.0 + i % 7) for i in high]), "j7_mix_streams")
    assert max(r[3] for r in rows) > 32_767 and len(rows) == 20


def test_mix_is_of_the_wider_kind(spark):
    kinds = "k int, tile_idx long, samples array<{}>"
    narrow = spark.createDataFrame([(1, 0, [32_767, -32_768, -1])], kinds.format("smallint"))
    wide = spark.createDataFrame([(1, 0, [2**31 - 1, -(2**31), 0])], kinds.format("int"))
    got = signal.mix(narrow, wide, ["k"])
    assert got.first()["samples"] == [(32_767 + 2**31 - 1) // 2, (-32_768 - 2**31) // 2, -1]
    assert got.schema["samples"].dataType.elementType.simpleString() == "int"
    assert signal.mix(narrow, narrow, ["k"]).schema["samples"].dataType.elementType.simpleString() == "smallint"
    assert signal.mix(wide, wide, ["k"]).first()["samples"] == [2**31 - 1, -(2**31), 0]


def test_turns_as_close_as_the_last_bits_tell(spark, tmp_path):
    """Fragments half way between the vectors of the turns before and after, and others whose vectors the JVM's own cosine
    would round apart from SQL's."""
    roots, rows = {}, []
    for i in range(7 * 1009):
        roots.setdefault((i * i % 1009, i % 7 == 3), i)
    known = sorted({r for r, fragment in roots if fragment and (r, False) in roots})
    for n, middle in enumerate(known):
        for gap in (g for g in range(1, 60) if (middle - g, False) in roots and (middle + g, False) in roots):
            ids = (roots[middle - gap, False], roots[middle, True], roots[middle + gap, False])
            rows += [(i, 1000 * n + gap, kind, 2.0 + gap) for i, kind in zip(ids, ("click", "view", "error"), strict=True)]
    got = same_as_sql(spark, events(spark, tmp_path, rows), "j5_nearest_turn")
    assert len(got) == len(rows) / 3 > 2000 and {r[2] for r in got} == {1, 3}


def test_blocks_not_tiles_meet_spans(spark):
    """A block's tiles are one row before the join, and a second's half windows are one row after it; tiles that aren't there are
    silent, spans may begin off the grid."""
    rng = np.random.default_rng(5)
    sums = rng.integers(1, 10**6, 9_000).astype(float) * 160
    gone = set(rng.choice(9_000, 900, replace=False).tolist()) | set(range(4_000, 4_050))
    sums[sorted(gone)] = 0
    tiles = spark.createDataFrame([(1, t, float(sums[t])) for t in range(9_000) if t not in gone], "k int, tile_idx long, sum_sq double")
    spans = [(0, 800_000, 1), (801_120, 1_439_999, 2)]
    got = signal.chunks(tiles, spark.createDataFrame([(1, *s) for s in spans], "k int, start long, end long, label int"), "k")
    want = [(a, b) for start, end, _ in spans for a, b in plain_chunks(sums, start, end)]
    assert sorted((r["start"], r["end"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join Inner") : plan.index("LogicalRDD")]
