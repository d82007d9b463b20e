"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges(a long, b long); component is the smallest node reachable.

    Each step is a grouped minimum, combined before the shuffle and written, and a join with it: as the minimum is a
    table by then, the join may split a hot node. The edges of a step are a table in the shared folder, deleted
    once the next step has read it. The number of steps grows with the logarithm of the longest path. Loops and
    repeated edges count for nothing.
    """
    tables = S.Scratch(edges.sparkSession)
    now = tables.settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    step = 0
    last = "edges"
    while state[0]:
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = tables.settle(star(both, tables.settle(large_least(both), f"least-{step}")).where("u > v").distinct(), f"large-star-{step}", (last, f"least-{step}"))
        least = tables.settle(large.groupBy("u").agg(F.min("v").alias("m")), f"small-least-{step}")
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        last = f"small-star-{step}"
        now, before = tables.settle(small, last, (f"large-star-{step}", f"small-least-{step}")), state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def large_least(both: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours."""
    return both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def star(both: DataFrame, least: DataFrame) -> DataFrame:
    """Each node's larger neighbours, joined to the smallest node it knows."""
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge tables; a star forest maps to itself."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
