"""Leases with timers: a heartbeat extends a session's lease, silence ends it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "session string, state string, at_ms long"


class _Lease(StatefulProcessor):
    """Per session: when it was last seen, and a timer for the end of its lease.

    Heartbeats of a batch count in the order of their times; one that is older than the last is no news. A lease
    that ended between two heartbeats of one batch ends there as well.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0] if self.seen.exists() else None
        before, out = last, []
        times = np.unique(np.concatenate([frame["at_ms"].to_numpy(np.int64) for frame in rows]))
        for at in times[times > last] if last is not None else times:
            if last is None:
                out.append((key[0], "active", int(at)))
            elif at > last + self.ttl:
                out += [(key[0], "expired", last + self.ttl), (key[0], "active", int(at))]
            last = int(at)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl)
            self.handle.registerTimer(last + self.ttl)
            self.seen.update((last,))
        yield pd.DataFrame(out, columns=["session", "state", "at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame([(key[0], "expired", expiredTimerInfo.getExpiryTimeInMs())], columns=["session", "state", "at_ms"])

    def close(self) -> None:
        pass


def lease_changes(heartbeats: DataFrame, ttl_seconds: int = 7200, delay: str = "1 hour") -> DataFrame:
    """(session, state, at): `active` when a lease begins and `expired` when it ends, from heartbeats(session string, at timestamp).

    A lease ends ttl_seconds after the last heartbeat; one exactly then still extends it. On a stream the end is told once
    the watermark, `delay` behind the latest heartbeat of all, has passed it; timers are kept in the checkpoint. A
    batch tells all ends, those in the future too. Rows without a session or a time are left out.
    """
    rows = heartbeats.where("session IS NOT NULL AND at IS NOT NULL").select("session", "at")
    if not heartbeats.isStreaming:
        w = Window.partitionBy("session").orderBy("at")
        ttl = F.make_dt_interval(secs=F.lit(ttl_seconds))
        rows = rows.distinct().withColumns({"_next": F.lead("at").over(w), "_before": F.lag("at").over(w), "_end": F.col("at") + ttl})
        changes = F.array(
            F.when(F.col("_before").isNull() | (F.col("_before") + ttl < F.col("at")), F.struct(F.lit("active").alias("state"), F.col("at").alias("at"))),
            F.when(F.col("_next").isNull() | (F.col("_next") > F.col("_end")), F.struct(F.lit("expired").alias("state"), F.col("_end").alias("at"))),
        )
        return rows.select("session", F.inline(F.array_compact(changes)))
    timed = rows.withWatermark("at", delay).select("session", "at", F.unix_millis("at").alias("at_ms"))
    out = timed.groupBy("session").transformWithStateInPandas(statefulProcessor=_Lease(ttl_seconds * 1000), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
    return out.select("session", "state", F.timestamp_millis("at_ms").alias("at"))
