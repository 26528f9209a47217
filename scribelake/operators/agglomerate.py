"""Clusters of a recording's turns where those are too many for one task.

Average linkage has a property that spreads it: two groups that are each other's nearest are merged sooner or later whatever
happens elsewhere, so all such pairs are merged in the same round. Nearest partners are found by blocks: each two blocks of
groups meet in one task, which tells for every group its best partner among them. Merges are noted with their heights, and
the rule that ends clustering is applied to the notes, highest first, so the result is that of merging one pair at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelake.operators.speakers import MAX_SPEAKERS, MERGE, cluster
from scribelake.sources.shared import durable

#: Recordings of up to so many groups are finished in one task, and so many groups are a block.
LOCAL, BLOCK = 2_000, 2_000


def _pair_hash(id_: int, others: np.ndarray) -> np.ndarray:
    """The same for a pair whichever comes first."""
    low, high = np.minimum(id_, others).astype(np.uint64), np.maximum(id_, others).astype(np.uint64)
    with np.errstate(over="ignore"):
        z = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high + np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x94D049BB133111EB)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(2)).astype(np.int64)


def nearest_partners(groups: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(key, id, partner, mean) of groups (key, id, v: the sum of its vectors, n): the other group of the recording with the
    highest mean cosine, of equals the one whose pair comes first by a hash, so that of many alike many are each other's first.
    A pair is compared in one task only, and so has one value. A task holds two blocks, and hands on one row for each of
    their groups."""
    counts = groups.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = groups.join(F.broadcast(counts), key).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(key, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "v", "n")

    def best(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        ids, n = own["id"].to_numpy(), own["n"].to_numpy(float)
        v = np.stack(own["v"].to_list()) / n[:, None]
        mean = v @ v.T
        if own["low"].iloc[0] != own["high"].iloc[0]:
            side = own["own"].to_numpy()
            mean[side[:, None] == side[None, :]] = -np.inf
        mean = np.maximum(mean, mean.T)
        np.fill_diagonal(mean, -np.inf)
        top = mean.max(axis=1)
        found = np.flatnonzero(np.isfinite(top))
        partner, tie = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for i in found.tolist():
            alike = np.flatnonzero(mean[i] == top[i])
            ties = _pair_hash(ids[i], ids[alike])
            partner[i], tie[i] = ids[alike[ties.argmin()]], ties.min()
        return pd.DataFrame({key: own[key].to_numpy()[found], "id": ids[found], "partner": partner[found], "mean": top[found], "tie": tie[found]})

    kind = groups.schema[key].dataType.simpleString()
    found = dealt.groupBy(key, "low", "high").applyInPandas(best, f"{key} {kind}, id long, partner long, mean double, tie long")
    order = F.struct("mean", -F.col("tie"), -F.least("id", "partner"), -F.greatest("id", "partner"))
    return found.groupBy(key, "id").agg(F.max_by("partner", order).alias("partner"), F.max("mean").alias("mean"))


def merge_round(groups: DataFrame, key: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(the groups after all pairs of mutual nearest have merged, those pairs: (key, a, b, height), a < b)."""
    best = durable(nearest_partners(groups, key, block))
    back = best.select(F.col(key).alias("of"), F.col("id").alias("b"), F.col("partner").alias("a"))
    pairs = best.join(back, (F.col(key) == F.col("of")) & (F.col("id") == F.col("a")) & (F.col("partner") == F.col("b"))).where("a < b").select(key, "a", "b", F.col("mean").alias("height"))
    pairs = durable(pairs)
    heads = groups.join(pairs.select(F.col(key).alias("of"), F.col("a").alias("head"), F.col("b").alias("id_b")), (F.col(key) == F.col("of")) & (F.col("id") == F.col("id_b")), "left")
    heads = heads.select(key, F.coalesce("head", "id").alias("id"), F.struct(F.col("id").alias("at"), "v").alias("part"), "n")
    both = F.transform(F.array_sort(F.collect_list("part")), lambda p: p["v"])
    total = F.when(F.size(both) == 2, F.zip_with(F.get(both, F.lit(0)), F.get(both, F.lit(1)), lambda x, y: x + y)).otherwise(F.get(both, F.lit(0)))
    return heads.groupBy(key, "id").agg(total.alias("v"), F.sum("n").alias("n")), pairs


def all_merges(ids: np.ndarray, sums: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """(a, b, height) of every merge down to one group, one pair at a time, the nearest first."""
    sums, sizes, alive, out = np.array(sums, float), np.array(sizes, float), np.ones(len(ids), bool), []
    mean = (sums / sizes[:, None]) @ (sums / sizes[:, None]).T
    np.fill_diagonal(mean, -np.inf)
    while alive.sum() > 1:
        i, j = sorted(np.unravel_index(int(mean.argmax()), mean.shape))
        out.append((int(ids[i]), int(ids[j]), float(mean[i, j])))
        sums[i], sizes[i], alive[j] = sums[i] + sums[j], sizes[i] + sizes[j], False
        mean[j], mean[:, j] = -np.inf, -np.inf
        others = alive.copy()
        others[i] = False
        mean[i, others] = (sums[others] / sizes[others, None]) @ (sums[i] / sizes[i])
        mean[others, i] = mean[i, others]
    return out


def cut(ids: np.ndarray, merges: list[tuple[int, int, float, int]], threshold: float, most: int) -> np.ndarray:
    """A label for each id, in order of the groups' first ids: merges (a, b, height, round) count, highest first, while they
    reach ``threshold`` or there are more than ``most`` groups."""
    # A merge is never higher than those it is made of, but for rounding.
    height: dict[int, float] = {}
    noted = []
    for nth, (a, b, h, _) in enumerate(sorted(merges, key=lambda m: (m[3], -m[2], m[0], m[1]))):
        height[a] = h = min(h, height.get(a, np.inf), height.get(b, np.inf))
        noted.append((-h, nth, a, b))
    root = {int(i): int(i) for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left = len(root)
    for h, _, a, b in sorted(noted):
        if -h < threshold and left <= most:
            break
        a, b = sorted((find(a), find(b)))
        root[b], left = a, left - 1
    return np.unique([find(int(i)) for i in ids], return_inverse=True)[1]


def cluster_turns(vectors: DataFrame, key: str, *, threshold: float = MERGE, most: int = MAX_SPEAKERS, local: int = LOCAL, block: int = BLOCK) -> DataFrame:
    """(key, id, label) of unit vectors (key, id, v), ids distinct in a recording: as ``speakers.cluster`` labels them, in order of
    id, but for pairs that are exactly as near.

    Recordings of up to ``local`` vectors are clustered in a task each. Larger ones go through rounds, in which no task holds
    more than two blocks; a round merges a good part of all groups (a tenth to a third in tests), and what is left at ``local`` is finished in one task. Only
    the notes of a recording's merges, three numbers for each vector, come together. An empty table gives an empty result.
    """
    kind = vectors.schema[key].dataType.simpleString()
    labelled = f"{key} {kind}, id long, label int"
    counts = durable(vectors.groupBy(key).agg(F.count("*").alias("vectors")))

    def small(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        return pd.DataFrame({key: own[key], "id": own["id"], "label": cluster(np.stack(own["v"].to_list()), threshold, most)})

    few = counts.where(F.col("vectors") <= local).select(key)
    out = vectors.join(few, key, "left_semi").select(key, "id", "v").groupBy(key).applyInPandas(small, labelled)
    many = counts.where(F.col("vectors") > local).select(key)
    if many.isEmpty():
        return out

    large = durable(vectors.join(many, key, "left_semi").select(key, F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.lit(1).cast("long").alias("n")))
    groups, notes, number = large, [], 0
    while not (waiting := durable(groups.groupBy(key).count().where(F.col("count") > local).select(key))).isEmpty():
        merged, pairs = merge_round(groups.join(waiting, key, "left_semi"), key, block)
        groups = durable(merged.unionByName(groups.join(waiting, key, "left_anti")))
        notes.append(pairs.withColumn("round", F.lit(number)))
        number += 1

    def finish(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        made = all_merges(own["id"].to_numpy(), np.stack(own["v"].to_list()), own["n"].to_numpy())
        rows = [(own[key].iloc[0], a, b, h, number + i) for i, (a, b, h) in enumerate(made)]
        return pd.DataFrame(rows, columns=[key, "a", "b", "height", "round"])

    noted = groups.groupBy(key).applyInPandas(finish, f"{key} {kind}, a long, b long, height double, round int")
    for n in notes:
        noted = noted.unionByName(n)

    def label(name: tuple, ids: pd.DataFrame, merges: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(ids["id"].to_numpy())
        steps = list(merges[["a", "b", "height", "round"]].itertuples(index=False, name=None))
        return pd.DataFrame({key: [name[0]] * len(own), "id": own, "label": cut(own, steps, threshold, most)})

    return out.unionByName(large.select(key, "id").groupBy(key).cogroup(noted.groupBy(key)).applyInPandas(label, labelled))
