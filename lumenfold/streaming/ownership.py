"""Ownership kept over a stream of claim, release and resolve events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.sources.stores import shared_folder

OUT = "path string, writer string, held boolean, since timestamp"


class _Holders(StatefulProcessor):
    """Per path: each writer's last claim or release, and the last resolve, each by (ts, event_id).

    An event that is not later than the last of its kind changes nothing, so events may come in any order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "writer string", "ts timestamp, event_id long, kind string")
        self.resolved = handle.getValueState("resolved", "ts timestamp, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        resolved = tuple(self.resolved.get()) if self.resolved.exists() else None
        touched: set[str] = set()
        moved = False
        for events in rows:  # frame by frame: a key's events of a batch are never held together
            events = events.sort_values(["ts", "event_id"]).drop_duplicates(["kind", "writer"], keep="last")
            for kind, writer, ts, event_id in zip(events["kind"], events["writer"], events["ts"], events["event_id"]):
                at = (ts.to_pydatetime(), int(event_id))
                if kind == "resolve":
                    if resolved is None or at > resolved:
                        resolved, moved = at, True
                elif not self.last.containsKey((writer,)) or tuple(self.last.getValue((writer,)))[:2] < at:
                    self.last.updateValue((writer,), (*at, kind))
                    touched.add(writer)
        if moved:
            self.resolved.update(resolved)
            touched.update(k[0] for k in self.last.keys())
        out = []
        for writer in sorted(touched):
            ts, event_id, kind = self.last.getValue((writer,))
            held = kind == "claim" and (resolved is None or (ts, event_id) > resolved)
            out.append((key[0], writer, held, ts))
        yield pd.DataFrame(out, columns=["path", "writer", "held", "since"])

    def close(self) -> None:
        pass


def ownership_changes(events: DataFrame) -> DataFrame:
    """Changes of who holds what, from a stream of events(event_id, ts, kind, writer, path)."""
    return events.groupBy("path").transformWithStateInPandas(statefulProcessor=_Holders(), outputStructType=OUT, outputMode="Update", timeMode="None")


def fold_available(events: DataFrame) -> DataFrame:
    """(writer, path, since) held after all that a stream has now, by way of a change log in the shared folder.

    The stream keeps grouped maxima by (ts, event_id), combined before the shuffle: each writer's last claim or release of a
    path, and a path's last resolve. Holders are worked out once, from the log's last rows. The log and the stream's checkpoint are in spark.checkpoint.dir; in local mode, in a folder of our own where that is
    unset. A stream that has nothing gives nothing.
    """
    spark = events.sparkSession
    root, provider = shared_folder(spark, "ownership"), "spark.sql.streaming.stateStore.providerClass"
    resolve = F.col("kind") == "resolve"
    last = events.groupBy("path", resolve.alias("resolve"), F.when(~resolve, F.col("writer")).alias("writer")).agg(F.max(F.struct("ts", "event_id", "kind")).alias("last"))
    spark.createDataFrame([], last.schema).write.parquet(f"{root}/log/batch=-1")
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/log/batch={number}")  # a batch that runs again replaces itself

    try:
        changes = last.writeStream.outputMode("update").foreachBatch(append)
        changes.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    log = spark.read.schema(last.schema).option("basePath", f"{root}/log").parquet(f"{root}/log")
    log = log.groupBy("path", "resolve", "writer").agg(F.max("last").alias("last"))
    resolved = log.where("resolve").select(F.col("path").alias("_path"), F.struct("last.ts", "last.event_id").alias("_resolved"))
    claims = log.where("NOT resolve AND last.kind = 'claim'").join(resolved, F.col("path").eqNullSafe(F.col("_path")), "left")
    held = F.col("_resolved").isNull() | (F.struct("last.ts", "last.event_id") > F.col("_resolved"))
    return claims.where(held).select("writer", "path", F.col("last.ts").alias("since"))
