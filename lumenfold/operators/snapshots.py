"""Views of a ledger kept as snapshots: only events after a snapshot's positions are folded on.

A snapshot is one table, so that state and positions are written together: (kind, writer, path, time, id), with the last
claim, release and resolve of each writer and path, and rows of kind `position`: path is a stream, id its last number.
All of these are maxima, so a snapshot and what follows it fold to the same as all events at once, in any split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("kind", "writer", "path")
SNAPSHOT = "kind string, writer string, path string, time timestamp_ntz, id long"


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.max(F.struct("time", "id")).alias("at")).select(*KEY, "at.time", "at.id")


def positions(snapshot: DataFrame) -> DataFrame:
    """(stream, last): how far a snapshot has read each stream."""
    return snapshot.where("kind = 'position'").select(F.col("path").alias("stream"), F.col("id").alias("last"))


def later(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """events(stream, seq, ...) that a snapshot hasn't read."""
    return events.join(positions(snapshot), "stream", "left").where(F.col("last").isNull() | (F.col("seq") > F.col("last"))).drop("last")


def advanced(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """The snapshot after events(stream string, seq, event_id, ts, kind, writer, path); events that it has read change nothing.

    Kinds are claim, release and resolve, others only move the position. A null stream is never known as read.
    """
    new = later(events, snapshot)
    kept = new.where(F.col("kind").isin("claim", "release", "resolve"))
    writer = F.when(F.col("kind") != "resolve", F.col("writer"))
    state = kept.select("kind", writer.alias("writer"), "path", F.col("ts").cast("timestamp_ntz").alias("time"), F.col("event_id").alias("id"))
    read = new.where("stream IS NOT NULL").select(F.lit("position").alias("kind"), F.lit(None).cast("string").alias("writer"), F.col("stream").alias("path"), F.lit(None).cast("timestamp_ntz").alias("time"), F.col("seq").cast("long").alias("id"))
    return _newest(snapshot.unionByName(_newest(state)).unionByName(_newest(read)))


def held(snapshot: DataFrame) -> DataFrame:
    """(writer, path, since): what a snapshot says is held: claims later than their writer's release and than the path's resolve."""
    at = F.struct("time", "id")
    own = snapshot.where("kind IN ('claim', 'release')").groupBy("writer", "path").agg(F.max(F.when(F.col("kind") == "claim", at)).alias("claimed"), F.max(F.when(F.col("kind") == "release", at)).alias("released"))
    resolved = snapshot.where("kind = 'resolve'").select("path", at.alias("resolved"))
    later_than = lambda c: F.col(c).isNull() | (F.col(c) < F.col("claimed"))
    j = own.where("claimed IS NOT NULL").join(resolved, "path", "left")
    return j.where(later_than("released") & later_than("resolved")).select("writer", "path", F.col("claimed.time").alias("since"))


def compacted(events: DataFrame, snapshot: DataFrame, keep: int = 250) -> DataFrame:
    """events that must stay beside the snapshot: those that it hasn't read, and the newest `keep` of each stream."""
    n = F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("seq")))
    known = events.withColumn("_n", n).join(positions(snapshot), "stream", "left")
    return known.where((F.col("_n") <= keep) | F.col("last").isNull() | (F.col("seq") > F.col("last"))).drop("_n", "last")
