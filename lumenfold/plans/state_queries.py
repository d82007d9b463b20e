"""Queries of kept state: versions of a store, snapshots of a ledger, hash trees, and JSON documents as leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import hash_tree, json_tree, snapshots
from lumenfold.plans import catalog as C
from lumenfold.sources import versioned
from lumenfold.sources.stores import shared_folder


# documents of nested objects and arrays from conversations, and one in nine cut off
@C.query("""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), ok AS (SELECT * FROM c WHERE conv_id % 9 > 0)
SELECT conv_id, '$.turns[' || k || '].' || 'role' AS path, 'string' AS kind, role AS value FROM ok UNION ALL SELECT conv_id, '$.turns[' || k || '].body.text', 'string', text FROM ok
UNION ALL SELECT conv_id, '$.turns[' || k || '].tags[0]', 'number', turn::VARCHAR FROM ok UNION ALL SELECT conv_id, '$.turns[' || k || '].tags[1][0]', 'boolean', CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END FROM ok
UNION ALL SELECT conv_id, '$.id', 'number', conv_id::VARCHAR FROM (SELECT DISTINCT conv_id FROM ok) UNION ALL SELECT conv_id, '$', 'malformed', '{"id":' || conv_id FROM (SELECT DISTINCT conv_id FROM c WHERE conv_id % 9 = 0)""")
def json_leaves(spark, d):
    string = lambda c: F.to_json(F.array(c))
    turn = F.concat(F.lit('{"role":'), F.regexp_extract(string(F.col("role")), r"(?s)^\[(.*)\]$", 1), F.lit(',"body":{"text":'), F.regexp_extract(string(F.col("text")), r"(?s)^\[(.*)\]$", 1), F.lit('},"tags":['), F.col("turn").cast("string"), F.lit(",["), (F.col("turn") % 2 == 0).cast("string"), F.lit("]]}"))
    per = C.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("s"))
    head = F.concat(F.lit('{"id":'), F.col("conv_id").cast("string"))
    docs = per.select("conv_id", F.when(F.col("conv_id") % 9 == 0, head).otherwise(F.concat(head, F.lit(',"turns":['), F.array_join(F.col("s.t"), ","), F.lit("]}"))).alias("text"))
    return json_tree.leaves(docs, "text", ["conv_id"])


# a user's newest event, in a store whose first version has the first half and whose second one the rest
@C.query("WITH h AS (SELECT max(event_id) // 2 AS m FROM events), o AS (SELECT 1 AS version, user_id, max(event_id) AS event_id FROM events, h WHERE event_id <= m GROUP BY 2 UNION ALL SELECT 2, user_id, max(event_id) FROM events GROUP BY 2) SELECT o.version, o.user_id, o.event_id, e.event_type FROM o JOIN events e USING (event_id)")
def store_versions(spark, d):
    e = C.table(spark, d, "events").select("user_id", "event_id", "event_type")
    half = (e.agg(F.max("event_id")).first()[0] or 0) // 2
    root = shared_folder(spark, "versions")
    versioned.upsert(e.where(F.col("event_id") <= half), root, ["user_id"], "event_id")
    first = versioned.read(spark, root).withColumn("version", F.lit(1))
    versioned.upsert(e.where(F.col("event_id") > half), root, ["user_id"], "event_id")
    return first.unionByName(versioned.read(spark, root).withColumn("version", F.lit(2)))


@C.query(C.ORACLES["ownership_fold"])
def ownership_incremental(spark, d):
    """The ownership fold out of a snapshot of the first two thirds, with the later events folded on."""
    e = C.ownership_events(spark, d).select(F.concat(F.lit("s"), F.col("writer")).alias("stream"), F.col("event_id").alias("seq"), "event_id", "ts", "kind", "writer", "path")
    most = e.agg(F.max("event_id")).first()[0] or 0
    root = shared_folder(spark, "ownership-snapshots")
    versioned.publish(snapshots.advanced(spark.createDataFrame([], snapshots.SNAPSHOT), e.where(F.col("event_id") <= most * 2 // 3)), root)
    snapshot = versioned.read(spark, root)
    versioned.publish(snapshots.advanced(snapshot, snapshots.compacted(e, snapshot)), root)
    return snapshots.held(versioned.read(spark, root))


# the local side lacks the last tenth of each user's events, and has others from the 60th on where the user's number divides by five
@C.query("""WITH e AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS n, md5(event_id::VARCHAR) AS hash FROM events),
l AS (SELECT stream, seq, CASE WHEN stream % 5 = 0 AND seq >= 60 THEN 'other' ELSE hash END AS hash FROM e WHERE seq <= n * 9 // 10), s AS (SELECT e.stream, min(e.seq) AS split FROM e JOIN l ON e.stream = l.stream AND e.seq = l.seq WHERE e.hash <> l.hash GROUP BY 1)
SELECT e.stream, e.seq, CASE WHEN e.seq >= split THEN 'conflict' ELSE 'append' END AS action FROM e LEFT JOIN l ON e.stream = l.stream AND e.seq = l.seq LEFT JOIN s ON s.stream = e.stream WHERE l.seq IS NULL OR l.hash <> e.hash""")
def suffix_sync_by_trees(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("stream")
    e = C.table(spark, d, "events").select(F.col("user_id").alias("stream"), "event_id", F.md5(F.col("event_id").cast("string")).alias("hash"))
    e = e.withColumns({"seq": F.row_number().over(w.orderBy("event_id")).cast("long"), "n": F.count("*").over(w)})
    local = e.where(F.col("seq") <= F.floor(F.col("n") * 9 / 10)).withColumn("hash", F.when((F.col("stream") % 5 == 0) & (F.col("seq") >= 60), "other").otherwise(F.col("hash")))
    return hash_tree.suffix_sync(local.select("stream", "seq", "hash"), e.select("stream", "seq", "hash"))


_NODE = "sha256(string_agg((pos % 64) || '=' || h, chr(10) ORDER BY pos)) AS h"


@C.query(f"""WITH {C.FILES}, l AS (SELECT lang, sha256(rel || chr(10) || coalesce(sha256(text), '-')) AS h, rel FROM f), a AS (SELECT lang, h, row_number() OVER (PARTITION BY lang ORDER BY rel, h) - 1 AS pos FROM l), m AS (SELECT max(pos) AS m FROM a),
b AS (SELECT lang, pos // 64 AS pos, {_NODE} FROM a GROUP BY lang, pos // 64), c AS (SELECT lang, pos // 64 AS pos, {_NODE} FROM b GROUP BY lang, pos // 64), e AS (SELECT lang, pos // 64 AS pos, {_NODE} FROM c GROUP BY lang, pos // 64),
r AS (SELECT lang, h FROM b WHERE (SELECT m FROM m) < 64 UNION ALL SELECT lang, h FROM c WHERE (SELECT m FROM m) BETWEEN 64 AND 4095 UNION ALL SELECT lang, h FROM e WHERE (SELECT m FROM m) BETWEEN 4096 AND 262143)
SELECT n.lang, n.files, r.h AS digest FROM (SELECT lang, count(*) AS files FROM a GROUP BY 1) n JOIN r ON n.lang IS NOT DISTINCT FROM r.lang""")
def folder_digest_trees(spark, d):
    return hash_tree.folder_digests(C.files(spark, d), ["lang"])
