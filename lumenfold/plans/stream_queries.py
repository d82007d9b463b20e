"""Streams over events, read to their end: the inbox, leases and chains that arrive out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.plans import catalog as C
from lumenfold.plans import chain_queries
from lumenfold.sources.stores import shared_folder, write_ndjson
from lumenfold.streaming import available, chains, inbox, leases


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = C.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{d}/events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def one_row(spark: SparkSession, root: str) -> DataFrame:
    spark.range(1).write.mode("overwrite").parquet(f"{root}/end")
    return spark.readStream.schema("id long").parquet(f"{root}/end")


# a click is a message that the user's purchase with the next number but two acknowledges
@C.query("SELECT m.event_id AS message_id, m.user_id FROM events m WHERE m.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.event_type = 'purchase' AND a.event_id = m.event_id + 3 AND a.ts BETWEEN m.ts AND m.ts + INTERVAL 900 SECOND)")
def inbox_stream(spark, d):
    root, e = shared_folder(spark, "inbox"), event_stream(spark, d)
    end = one_row(spark, root)
    messages = e.where("event_type = 'click'").select(F.col("event_id").alias("message_id"), F.col("ts").alias("at"), "user_id")
    acks = e.where("event_type = 'purchase'").select((F.col("event_id") - 3).alias("message_id"), F.col("ts").alias("acked_at"))
    stream = inbox.unread(available.closed(messages, "at", end, message_id=-1), available.closed(acks, "acked_at", end, message_id=-1), "900 SECONDS")
    return available.run_available(stream, root).select("message_id", "user_id")


@C.query("""WITH e AS (SELECT DISTINCT user_id::VARCHAR AS session, date_trunc('millisecond', ts) AS t FROM events), g AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS n FROM e WINDOW w AS (PARTITION BY session ORDER BY t))
SELECT session, 'active' AS state, t AS "at" FROM g WHERE p IS NULL OR p + INTERVAL 36000 SECOND < t UNION ALL SELECT session, 'expired', t + INTERVAL 36000 SECOND FROM g WHERE n IS NULL OR n > t + INTERVAL 36000 SECOND""")
def lease_stream(spark, d):
    root, e = shared_folder(spark, "leases"), event_stream(spark, d)
    beats = available.closed(e.select(F.col("user_id").cast("string").alias("session"), F.col("ts").alias("at")), "at", one_row(spark, root), session="end")
    changes = available.run_available(leases.lease_changes(beats, 36_000), root, "update")
    return changes.where("session <> 'end'").select("session", "state", F.col("at").cast("timestamp_ntz").alias("at"))


# every 50th event is lost; the files hold the rest in another order
@C.query(f"WITH {chain_queries._DRAFTS}, n AS (SELECT stream, ordinal, row_number() OVER (PARTITION BY stream ORDER BY ordinal) AS seq, ordinal % 50 = 3 AS lost FROM drafts), g AS (SELECT *, max(CASE WHEN NOT lost THEN seq END) OVER (PARTITION BY stream) AS top, coalesce(lag(lost) OVER (PARTITION BY stream ORDER BY seq), false) AS lost_before FROM n) "
         "SELECT stream::VARCHAR AS stream, seq, CASE WHEN lost THEN 'gap' ELSE 'ok' END AS code FROM g WHERE NOT lost OR (seq < top AND NOT lost_before)")
def chain_stream(spark, d):
    root = shared_folder(spark, "chains")
    sealed = chain_queries.sealed(spark, d).withColumn("stream", F.col("stream").cast("string"))
    # the envelope holds the stream as text either way, so the digests stay right
    write_ndjson(sealed.where("ordinal % 50 <> 3").repartition("id").select("stream", "seq", "id", "type", "ts", "payload", "prev_id", "prev_hash", "hash"), f"{root}/in")
    end = one_row(spark, root)
    events = chains.event_lines(spark, f"{root}/in", 1_000_000)  # all files in one batch, as the last row closes it
    last = end.select(*[{"stream": F.lit("end"), "seq": F.lit(1), "ts": F.lit(available.END_OF_TIME)}.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in events.schema])
    report = available.run_available(chains.chain_report(events.unionByName(last), "3650 days"), root, "update")
    return report.where("stream <> 'end'").select("stream", "seq", "code")
