"""Distributed connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links reach, for every id of edges(src, dst).

    In each round every vertex points to the one of itself and its neighbours that comes
    first in an order by hash, new in each round; pointers are doubled twice, and the edges
    are rewritten to what their ends point to. Loops and repeated edges go. In expectation
    a constant share of the vertices goes each round, for long chains as well, so that the
    rounds grow with the logarithm of the graph; they end when no edge is left. Each
    round's pointers and edges are written as Parquet: a checkpoint would hand the sizes
    estimated for its joins on to the next round's, and they would grow beyond all
    bounds. Each table is deleted after its last reader; the result alone stays. At last
    each component is named after its smallest id. Ids with only a loop map to themselves;
    links with a null end are left out; no edges give no rows.
    """
    some = edges.where("src is not null and dst is not null")
    left = written(some.selectExpr("least(src, dst) a", "greatest(src, dst) b").distinct())
    root, rounds = None, 0
    while True:
        rank = lambda c, salt=rounds: F.struct(F.xxhash64(F.lit(salt), c).alias("h"), F.col(c).alias("v"))
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(rank("b")).alias("first"))
        step = written(to.select(F.col("a").alias("v"), F.least(rank("a"), F.col("first"))["v"].alias("to")))
        to = step
        for _ in range(2):
            on = to.select(F.col("v").alias("w"), F.col("to").alias("further"))
            to = to.join(on, F.col("to") == F.col("w")).select("v", F.col("further").alias("to"))
        to = written(to)
        discard(step)
        ends = to.select(F.col("v").alias("w"), F.col("to").alias("b_to"))
        moved = left.join(to, F.col("a") == F.col("v")).join(ends, F.col("b") == F.col("w"))
        moved = written(moved.where("to <> b_to").selectExpr("least(to, b_to) a", "greatest(to, b_to) b").distinct())
        discard(left)
        if root is None:
            root = to.select(F.col("v").alias("id"), F.col("to").alias("component"))
        else:
            further = written(root.join(to, F.col("component") == F.col("v"), "left").select("id", F.coalesce("to", "component").alias("component")))
            discard(root)
            discard(to)
            root = further
        left, rounds = moved, rounds + 1
        if left.isEmpty():
            break
    discard(left)
    names = root.groupBy("component").agg(F.min("id").alias("name")).withColumnRenamed("component", "of")
    out = written(root.join(names, F.col("component") == F.col("of")).select("id", F.col("name").alias("component")))
    discard(root)
    return out
