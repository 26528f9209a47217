"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribelake.llm.common import durable, join_counted


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``links`` (a, b), longs; nodes of one component share a root.

    In each round every node moves to its smallest neighbour or stays, and links are drawn anew between where their ends
    have moved, until none is left. "Smallest" is by a hash, so that chains in id order shrink by a constant share too:
    the rounds are logarithmic in the nodes. Moves are minima, combined before the shuffle, and nodes with over a thousandth
    of the links are joined by broadcast, so a hub is no hot key; links and moves never leave the executors. A self-link, a repeated link or a null end adds nothing; without links there are no rows.
    """
    mixed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    links = durable(links.where("a <> b").select("a", "b").distinct())
    moves = []
    while not links.isEmpty():
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(mixed("b")).alias("to"), F.count("*").alias("n"))
        move = durable(least.select(F.col("a").alias("node"), F.least(mixed("a"), F.col("to"))["n"].alias("root"), "n"))
        moves.append(move.drop("n"))
        total = links.count()
        one = join_counted(links, move.select(F.col("node").alias("a"), F.col("root").alias("x"), "n"), "a", "n", total).select("b", "x")
        two = join_counted(one, move.select(F.col("node").alias("b"), F.col("root").alias("y"), "n"), "b", "n", total)
        links = durable(two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[-1]
    for move in reversed(moves[:-1]):
        later = out.select(F.col("node").alias("at"), F.col("root").alias("end"))
        out = move.join(later, move["root"] == later["at"], "left").select("node", F.coalesce("end", "root").alias("root"))
        out = durable(out)
    return out
