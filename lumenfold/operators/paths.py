"""Joins on paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import ancestors, repo_path


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, left_path, right_id, right_path): equal paths, or one below the other.

    left(left_id, left_path), right(right_id, right_path). Two equi joins over the ancestors of either side
    take the place of a condition that would compare all pairs.
    """
    a = left.withColumn("left_path", repo_path(F.col("left_path"))).where(F.col("left_path").isNotNull())
    b = right.withColumn("right_path", repo_path(F.col("right_path"))).where(F.col("right_path").isNotNull())
    below = a.withColumn("_k", F.explode(ancestors(F.col("left_path")))).join(b, F.col("_k") == F.col("right_path")).drop("_k")
    above = b.withColumn("_k", F.explode(ancestors(F.col("right_path")))).join(a, F.col("_k") == F.col("left_path")).where(F.col("left_path") != F.col("right_path")).drop("_k")
    return below.unionByName(above)


def nearest_ancestor(items: DataFrame, owners: DataFrame) -> DataFrame:
    """items(item_id, path) with owner: the deepest of owners(path) that is the item's path or above it."""
    o = owners.select(F.col("path").alias("owner")).distinct()
    up = items.select("item_id", F.explode(ancestors(F.col("path"))).alias("owner"))
    found = up.join(o, "owner").groupBy("item_id").agg(F.max_by("owner", F.length("owner")).alias("owner"))
    return items.join(found, "item_id", "left")


def conflicts(claims: DataFrame) -> DataFrame:
    """(claim_id, kind, others): with how many claims of other writers on its path each of claims(claim_id, writer, worktree, branch, path) conflicts.

    The same worktree is a write-lock-conflict, the same branch elsewhere a branch-write-conflict, another branch a
    merge-risk. Claims are counted by worktree and branch of a path before the join, so a path that many claim doesn't
    give all pairs of them.
    """
    w, b = F.col("worktree").alias("_w"), F.col("branch").alias("_b")
    own = claims.groupBy("path", w, b, "writer").agg(F.count("*").alias("_own"))
    whole = own.groupBy("path", "_w", "_b").agg(F.sum("_own").alias("_n"))
    j = claims.join(whole, "path").join(own, ["path", "_w", "_b", "writer"], "left")
    kind = F.when(F.col("worktree") == F.col("_w"), "write-lock-conflict").when(F.col("branch") == F.col("_b"), "branch-write-conflict").otherwise("merge-risk")
    j = j.select("claim_id", kind.alias("kind"), (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("_n")).where("_n > 0")
    return j.groupBy("claim_id", "kind").agg(F.sum("_n").alias("others"))
