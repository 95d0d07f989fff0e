"""Connected components of an edge table, without ever holding it on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, save

#: Nodes of many rows in a join are fewer than HOT; below FEW rows a node is never one.
HOT, FEW = 50_000, 200


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges``.

    Rounds of large-star and small-star: every round hangs neighbours on the
    smallest node in sight and halves distances, until nothing moves.  Each
    round's edges are written to the shared folder, so lineage stays short.
    Loops and repeated edges are harmless; edges with a null end count for
    nothing.  A hub's neighbours are never gathered: minima combine on the map
    side, and those of nodes with many neighbours, of which there are few, come
    back by a broadcast (:func:`with_least`).  Superseded rounds are deleted.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # large star: larger neighbours hang on the smallest node around
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = save(with_least(both, F.least(F.min("v"), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        # small star: a node and its smaller neighbours hang on the smallest of them
        tied = with_least(large, F.min("v"))
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(tied.select("u", F.col("m").alias("v")))
        new = save(small.distinct(), "edges")
        drop(large, e)
        # done when every node hangs on a root: no one is both above and below another
        roots = new.select(F.col("v").alias("u")).distinct()
        if new.join(roots, "u", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).union(new.select("v", "v").distinct())
        e = new


def with_least(edges: DataFrame, least: Column) -> DataFrame:
    """``u, v, m`` of every row of ``edges``; ``m`` is ``least`` of the rows of its ``u``.

    Nodes with more than a ``HOT``-th of all rows, of which there are fewer than
    ``HOT``, get theirs by a broadcast and are not shuffled; the others are
    joined in the usual way.
    """
    low = save(edges.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("n")), "least")
    many = max(FEW, edges.count() // HOT)
    hot = F.broadcast(low.where(F.col("n") > many).select("u", F.col("m").alias("__hot")))  # fewer than HOT rows
    marked = edges.join(hot, "u", "left")
    cold = marked.where("__hot is null").select("u", "v").join(low.where(F.col("n") <= many).select("u", "m"), "u")
    return cold.select("u", "v", "m").union(marked.where("__hot is not null").select("u", "v", F.col("__hot").alias("m")))
