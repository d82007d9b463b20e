"""Run stores: filters, ranking, retention and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching_runs(runs: DataFrame, tag: str | None = None, **equal) -> DataFrame:
    """runs that have all given values and, if asked, the tag."""
    for column, value in equal.items():
        if value is not None:
            runs = runs.where(F.col(column) == value)
    return runs.where(F.array_contains("tags", tag)) if tag is not None else runs


def newest(runs: DataFrame, most: int, time: str = "started_at", key: str = "run_id") -> DataFrame:
    """The `most` newest runs; ties by key."""
    return runs.orderBy(F.desc(time), key).limit(most)


def newest_per(runs: DataFrame, by: list[str], most: int = 1, time: str = "started_at", key: str = "run_id") -> DataFrame:
    """The `most` newest runs of each group; Spark cuts groups to that before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(time), F.col(key)))
    return runs.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def last_failure(runs: DataFrame, among: int = 50) -> DataFrame:
    """The newest failed run among the `among` newest runs."""
    return newest(newest(runs, among).where("status = 'failed'"), 1)


def prune_runs(runs: DataFrame, as_of: Column, max_runs=50, max_per_tool=20, max_failed=20, max_days=14) -> DataFrame:
    """(run_id, action): keep or delete, for runs(run_id, tool, status, started_at, pinned).

    A run goes if it isn't among the newest max_runs or is older than max_days; but it stays if it is pinned,
    among the newest max_failed failed ones, or the newest max_per_tool of its tool. A null limit is none. No
    rank over all rows is made: what is among the newest is a limit, and the rest is what it doesn't hold.
    """

    def among(rows: DataFrame, flag: str) -> DataFrame:
        return rows.select("run_id", F.lit(True).alias(flag))

    out = runs
    parts = {"recent": None if max_runs is None else newest(runs, max_runs), "failure": None if max_failed is None else newest(runs.where("status = 'failed'"), max_failed), "of_tool": None if max_per_tool is None else newest_per(runs, ["tool"], max_per_tool)}
    for flag, rows in parts.items():
        out = out.withColumn(flag, F.lit(True)) if rows is None else out.join(among(rows, flag), "run_id", "left")
    is_failed = F.col("status") == "failed"
    old = F.lit(False) if max_days is None else F.coalesce(F.col("started_at") < as_of - F.make_dt_interval(F.lit(max_days)), F.lit(False))
    remove = F.col("recent").isNull() | old
    keep = F.coalesce("pinned", F.lit(False)) | (is_failed & F.col("failure").isNotNull()) | F.col("of_tool").isNotNull()
    return out.select("run_id", F.when(remove & ~keep, "delete").otherwise("keep").alias("action"))


def prune_evidence(runs: DataFrame, as_of: Column, per_id: int = 20, max_days: int = 30) -> DataFrame:
    """(run_id, action) for evidence runs(run_id, proof_id, status, started_at, pinned): the newest per_id of an id stay at any age."""
    top = newest_per(runs, ["proof_id"], per_id).select("run_id", F.lit(True).alias("top"))
    fails = newest_per(runs.where("status <> 'passed'"), ["proof_id"], per_id).select("run_id", F.lit(True).alias("fail"))
    out = runs.join(top, "run_id", "left").join(fails, "run_id", "left")
    old = F.coalesce(F.col("started_at") < as_of - F.make_dt_interval(F.lit(max_days)), F.lit(False))
    remove = old | F.col("top").isNull()
    keep = F.coalesce("pinned", F.lit(False)) | F.col("top").isNotNull() | F.col("fail").isNotNull()
    return out.select("run_id", F.when(remove & ~keep, "delete").otherwise("keep").alias("action"))


def first_of_each(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The row of least ordinal for each key."""
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*columns), ordinal).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the rows of changes in place of those that have their key."""
    return table.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)
