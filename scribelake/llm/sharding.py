"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A row descends region -> rack -> shard. At each level every child draws ``-ln(u) / weight`` from the row's key and the
child's name, and the smallest draw wins, so a child gets rows in proportion to the weight below it. A draw depends on
nothing but key, child and weight: a change of weight moves rows only into or out of the subtrees whose weight changed.
A shard that is added opens a region of its own, so that the only new draw is its own and rows move into it alone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribelake.llm.common import draw, fresh


@dataclass(frozen=True)
class Tree:
    """Regions of racks of (shard number, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(shards: int, shards_per_rack: int = 4, racks_per_region: int = 2) -> Tree:
        """``shards`` of weight 1, filling racks and regions in order."""
        racks = [tuple((i, 1.0) for i in range(a, min(a + shards_per_rack, shards))) for a in range(0, shards, shards_per_rack)]
        return Tree(tuple(tuple(racks[a : a + racks_per_region]) for a in range(0, len(racks), racks_per_region)))

    @property
    def size(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own."""
        return replace(self, regions=(*self.regions, (((self.size, weight),),)))


def _pick(seed: int, key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """What belongs to the child (name, weight, value) with the smallest weighted draw; ties go to the first."""
    draws = [F.struct((-F.log(draw(F.lit(seed), key, F.lit(name))) / F.lit(weight)).alias("d"), F.lit(i).alias("i"), value.alias("v")) for i, (name, weight, value) in enumerate(children)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["v"]


def shard_of(key: Column, tree: Tree, seed: int = 7) -> Column:
    """The shard of a key: one draw for each region, then only the draws inside the winner."""
    weight = lambda racks: sum(w for rack in racks for _, w in rack)
    live = [(r, region) for r, region in enumerate(tree.regions) if weight(region) > 0]
    region = _pick(seed, key, [(f"r{r}", weight(racks), F.lit(r)) for r, racks in live])

    def below(r: int, racks) -> Column:
        shard = lambda k, rack: _pick(seed, key, [(f"r{r}/k{k}/s{s}", w, F.lit(s)) for s, w in rack if w > 0])
        some = [(k, rack) for k, rack in enumerate(racks) if weight([rack]) > 0]
        rack = _pick(seed, key, [(f"r{r}/k{k}", weight([rack]), F.lit(k)) for k, rack in some])
        return _case(rack, [(k, shard(k, rows)) for k, rows in some])

    return _case(region, [(r, below(r, racks)) for r, racks in live])


def _case(chosen: Column, ways: list[tuple[int, Column]]) -> Column:
    if len(ways) == 1:
        return ways[0][1]
    out = F.when(chosen == ways[0][0], ways[0][1])
    for value, column in ways[1:]:
        out = out.when(chosen == value, column)
    return out


def assign_shards(docs: DataFrame, tree: Tree, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, slots: int = 1024) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the tree decide; ``grown_shard`` is the shard after one more is added. ``size`` is the
    text's UTF-8 bytes plus 8 (a null text: 8, and the checksum of no bytes, 0). ``slot`` numbers a shard's rows from 0
    without gaps. Each shard is cut into ``slots`` parts by a hash of id and text, so rows of one id are in many; the rows of each
    part are counted first, at most shards x slots counts are broadcast, and only a part's rows, without their texts, are
    ever sorted together. Rows with a null id have the key ``null`` and so share a shard; repeated rows get slots of their own,
    in no defined order among them. A very long text is only measured and summed up. An empty table gives an empty result;
    extra columns are ignored.
    """
    key = F.col(id_col).cast("string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    checksum = F.crc32(F.encode(text, "UTF-8"))
    shard, part = shard_of(key, tree, seed).cast("int"), F.pmod(F.xxhash64(key, checksum), F.lit(slots))
    counts = docs.select(shard.alias("shard"), part.alias("part")).groupBy("shard", "part").count()
    starts = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("start"))
    rows = docs.select(
        F.col(id_col), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), checksum.alias("text_crc32"), F.lit("key").alias("law"),
        shard.alias("shard"), part.alias("part"), shard_of(key, tree.grown(), seed).cast("int").alias("grown_shard"),
    )
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.col(id_col), "size", "text_crc32"))
    rows = rows.withColumn("rank", rank).join(F.broadcast(starts), ["shard", "part"])
    return rows.select(id_col, "size", "text_crc32", "law", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
