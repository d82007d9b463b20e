"""The inbox as a stream: messages that nobody acknowledges in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unread(messages: DataFrame, acks: DataFrame, within: str, delay: str = "1 hour") -> DataFrame:
    """messages(message_id, at, ...) without an ack of acks(message_id, acked_at) from `at` to `within` later.

    On batch tables an anti join. On streams a left outer join with watermarks on both sides: a message stays in state
    until both watermarks have passed `within` after it, and is given then, once. Rows that come more than `delay` later
    than others of their side may be dropped: such a message is never given, such an ack changes nothing. Rows without
    an id or a time are in no join and, as messages, are unread in a batch but wait for ever in a stream.
    """
    m, a = messages, acks.select(F.col("message_id").alias("_ack"), F.col("acked_at").alias("_acked_at"))
    fits = (F.col("message_id") == F.col("_ack")) & (F.col("_acked_at") >= F.col("at")) & (F.col("_acked_at") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    if not messages.isStreaming:
        return m.join(a, fits, "left_anti")
    j = m.withWatermark("at", delay).join(a.withWatermark("_acked_at", delay), fits, "leftOuter")
    return j.where(F.col("_ack").isNull()).drop("_ack", "_acked_at")
