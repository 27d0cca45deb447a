"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per node and a join back, so a node with very many neighbours costs no more than its rows; no list
of neighbours is formed. Tables are written between steps: a lost executor costs a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._store import Workspace


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """edges (a, b) with a > b. Large star: the larger neighbours of each node go to its least neighbour; small star: the smaller ones, and it, do."""
    if small:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        moved = near.join(least, "u").filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, work: Workspace, name: str = "stars") -> DataFrame:
    """(node, root) for every node of edges (a long, b long): root is the least node that can be reached."""
    now = work.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), f"{name}0")
    mark, turn = None, 0
    while True:
        turn += 1
        now = work.save(_stars(_stars(now, False), True), f"{name}{turn}")
        work.drop(f"{name}{turn - 1}")
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
