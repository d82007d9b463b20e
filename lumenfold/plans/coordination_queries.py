"""Queries of the event ledger: links, queues, guards, health and closeout, over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import evidence, ledger
from lumenfold.plans import catalog as C

# events linked to the one before; every 50th points wrongly in one of three ways
LINKED = """e0 AS (SELECT user_id AS stream, event_id AS ordinal, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, 'e' || event_id AS id, md5('e' || event_id) AS hash FROM events),
e1 AS (SELECT *, lag(id) OVER (PARTITION BY stream ORDER BY ordinal) AS before, lag(hash) OVER (PARTITION BY stream ORDER BY ordinal) AS hash_before FROM e0),
e AS (SELECT stream, ordinal, CASE WHEN ordinal % 150 = 0 THEN seq + 1 ELSE seq END AS seq, id, hash, CASE WHEN ordinal % 150 = 50 THEN 'e0' ELSE before END AS prev_id, CASE WHEN ordinal % 150 = 100 THEN 'x' ELSE hash_before END AS prev_hash FROM e1)"""


def linked_events(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("stream").orderBy("ordinal")
    e = C.table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("ordinal"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id")).withColumn("hash", F.md5("id"))
    e = e.withColumns({"seq": F.row_number().over(w).cast("long"), "before": F.lag("id").over(w), "hash_before": F.lag("hash").over(w)})
    odd = F.col("ordinal") % 150
    return e.select("stream", "ordinal", F.when(odd == 0, F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"), "id", "hash", F.when(odd == 50, "e0").otherwise(F.col("before")).alias("prev_id"), F.when(odd == 100, "x").otherwise(F.col("hash_before")).alias("prev_hash"))


_BREAKS = """k AS (SELECT *, coalesce(lag(seq) OVER (PARTITION BY stream ORDER BY ordinal), 0) + 1 AS s, lag(id) OVER (PARTITION BY stream ORDER BY ordinal) AS i, lag(hash) OVER (PARTITION BY stream ORDER BY ordinal) AS h FROM e),
b AS (SELECT stream, ordinal, 'sequence' AS code FROM k WHERE seq IS DISTINCT FROM s UNION ALL SELECT stream, ordinal, 'previous-id' FROM k WHERE prev_id IS DISTINCT FROM i UNION ALL SELECT stream, ordinal, 'previous-hash' FROM k WHERE prev_hash IS DISTINCT FROM h)"""


@C.query(f"WITH {LINKED}, {_BREAKS} SELECT * FROM b")
def chain_link_breaks(spark, d):
    return ledger.link_breaks(linked_events(spark, d))


@C.query("""WITH e AS (SELECT user_id AS stream, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), o AS (SELECT * FROM e WHERE event_id % 3 <> 2), last AS (SELECT stream, max(n) AS seq, arg_max(event_id, n) AS id FROM o GROUP BY 1),
dr AS (SELECT stream, event_id AS id, row_number() OVER (PARTITION BY stream ORDER BY event_id) AS k, lag(event_id) OVER (PARTITION BY stream ORDER BY event_id) AS p FROM e WHERE event_id % 3 = 2)
SELECT dr.stream, coalesce(last.seq, 0) + k AS seq, dr.id, coalesce(p, last.id) AS prev_id FROM dr LEFT JOIN last USING (stream)""")
def ledger_append(spark, d):
    from pyspark.sql import Window

    e = C.table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"))
    return ledger.appended(e.where("id % 3 <> 2"), e.where("id % 3 = 2").select("stream", F.col("id").alias("ordinal"), "id"))


# paths grow with the table: an hour of an event type
_CLAIMS = """o AS (SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'click' THEN 'intent' WHEN 'view' THEN 'release' WHEN 'error' THEN 'resolve' END AS kind, 'w' || user_id % 7 AS writer, 'src/' || (event_id // 97) || '/a.ts' AS path,
CASE WHEN event_id % 3 = 0 THEN 'w' || event_id % 7 END AS owner, CASE WHEN event_id % 3 = 1 THEN ['w' || event_id % 7, 'w' || (event_id + 1) % 7] END AS owners FROM events)"""


def path_events(spark: SparkSession, d: str) -> DataFrame:
    w = lambda c: F.concat(F.lit("w"), (c % 7).cast("string"))
    i, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "signup", "claim").when(t == "click", "intent").when(t == "view", "release").when(t == "error", "resolve")
    path = F.concat(F.lit("src/"), F.floor(i / 97).cast("string"), F.lit("/a.ts"))
    return C.table(spark, d, "events").select("event_id", "ts", kind.alias("kind"), w(F.col("user_id")).alias("writer"), path.alias("path"), F.when(i % 3 == 0, w(i)).alias("owner"), F.when(i % 3 == 1, F.array(w(i), w(i + 1))).alias("owners"))


@C.query(f"""WITH {_CLAIMS}, c AS (SELECT path, writer, max(event_id) AS at FROM o WHERE kind = 'claim' GROUP BY ALL), w AS (SELECT o.path, o.writer, min(o.event_id) AS since FROM o LEFT JOIN c ON o.path = c.path AND o.writer = c.writer WHERE o.kind = 'intent' AND (c.at IS NULL OR o.event_id > c.at) GROUP BY ALL)
SELECT path, writer, row_number() OVER (PARTITION BY path ORDER BY since, writer) AS position FROM w""")
def edit_intent_queue(spark, d):
    return ledger.open_intents(path_events(spark, d), ["event_id"])


@C.query(f"""WITH {_CLAIMS}, c AS (SELECT path, writer, max(event_id) AS at FROM o WHERE kind = 'claim' GROUP BY ALL)
SELECT writer, path FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = c.path AND o.event_id > c.at AND ((o.kind = 'release' AND o.writer = c.writer) OR (o.kind = 'resolve' AND CASE WHEN o.owner IS NOT NULL THEN o.owner <> c.writer WHEN o.owners IS NOT NULL THEN list_contains(o.owners, c.writer) ELSE true END)))""")
def ownership_by_resolve_form(spark, d):
    return ledger.owned_by_form(path_events(spark, d), ["event_id"])


_REQ = """c AS (SELECT event_id AS id, 'u' || user_id AS writer, user_id % 3 AS worktree, event_type AS branch, ['inspect', 'edit', 'commit', 'merge', 'push'][event_id % 5 + 1] AS operation,
CASE WHEN event_id % 9 = 0 THEN 'yarn.lock' ELSE 'src/' || (event_id // 61) || '.ts' END AS path FROM events), held AS (SELECT * FROM c WHERE id % 2 = 1 AND operation <> 'inspect'), req AS (SELECT * FROM c WHERE id % 2 = 0)"""
_SINGLE = ledger.SINGLETONS


@C.query(f"""WITH {_REQ}, h AS (SELECT path, worktree, branch, writer, count(*) AS n FROM held GROUP BY ALL),
j AS (SELECT req.id AS request_id, req.operation, CASE WHEN regexp_matches(req.path, '{_SINGLE}') THEN 'global-write-conflict' WHEN req.worktree = h.worktree THEN 'write-lock-conflict' WHEN req.branch = h.branch THEN 'branch-write-conflict' ELSE 'merge-risk' END AS kind, h.n FROM req JOIN h ON req.path = h.path AND req.writer <> h.writer)
SELECT request_id, kind, sum(n)::BIGINT AS conflicts, operation <> 'inspect' AND (kind <> 'merge-risk' OR operation = 'merge') AS blocks FROM j GROUP BY request_id, operation, kind""")
def operation_guard(spark, d):
    i = F.col("event_id")
    path = F.when(i % 9 == 0, "yarn.lock").otherwise(F.concat(F.lit("src/"), F.floor(i / 61).cast("string"), F.lit(".ts")))
    operation = F.element_at(F.array(*map(F.lit, ("inspect", "edit", "commit", "merge", "push"))), (i % 5 + 1).cast("int"))
    c = C.table(spark, d, "events").select(i.alias("request_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("writer"), (F.col("user_id") % 3).alias("worktree"), F.col("event_type").alias("branch"), operation.alias("operation"), path.alias("path"))
    return ledger.guard(c.where("request_id % 2 = 0"), c.where("request_id % 2 = 1"))


@C.query(f"WITH p AS (SELECT page_id, lower(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')) || CASE WHEN page_id % 11 = 0 THEN '/yarn.lock' WHEN page_id % 13 = 0 THEN '/migrations/1.sql' ELSE '' END AS path FROM pages) SELECT path, count(*) AS n FROM p WHERE regexp_matches(path, '{_SINGLE}') GROUP BY 1")
def singleton_paths(spark, d):
    i = F.col("page_id")
    p = F.lower(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""))
    path = F.concat(p, F.when(i % 11 == 0, "/yarn.lock").when(i % 13 == 0, "/migrations/1.sql").otherwise(""))
    return C.table(spark, d, "pages").select(path.alias("path")).where(ledger.singleton(F.col("path"))).groupBy("path").agg(F.count("*").alias("n"))


@C.query("""WITH c AS (SELECT event_id AS claim_id, unnest(['src/a' || event_id % 5 || '.ts', CASE WHEN event_id % 4 = 0 THEN 'src/*.ts' WHEN event_id % 4 = 1 THEN 'src/lib' WHEN event_id % 4 = 2 THEN 'src/a' || event_id % 3 || '.ts' ELSE 'docs/' END]) AS path FROM events), o AS (SELECT claim_id, path, count(*) AS n FROM c GROUP BY ALL),
x AS (SELECT claim_id, path, CASE WHEN regexp_matches(path, '[*?\\[\\]{}]') THEN 'glob' WHEN ends_with(path, '/') OR NOT contains(string_split(path, '/')[-1], '.') THEN 'folder' WHEN n > 1 THEN 'duplicate' END AS error FROM o) SELECT * FROM x WHERE error IS NOT NULL""")
def exact_path_claims(spark, d):
    i = F.col("event_id")
    a = lambda m: F.concat(F.lit("src/a"), (i % m).cast("string"), F.lit(".ts"))
    other = F.when(i % 4 == 0, "src/*.ts").when(i % 4 == 1, "src/lib").when(i % 4 == 2, a(3)).otherwise("docs/")
    return ledger.path_errors(C.table(spark, d, "events").select(i.alias("claim_id"), F.array(a(5), other).alias("paths")))


@C.query(f"WITH {LINKED}, {_BREAKS}, s AS (SELECT DISTINCT stream FROM e), w AS (SELECT DISTINCT user_id AS stream FROM events WHERE event_type = 'error' AND event_id % 4 = 0), g AS (SELECT user_id AS stream, bool_and(event_id % 9 <> 4) AS a FROM events WHERE event_type = 'view' AND user_id % 3 = 0 GROUP BY 1), j AS (SELECT s.stream, s.stream IN (SELECT stream FROM b) AS r, s.stream IN (SELECT stream FROM w) AS b, g.a FROM s LEFT JOIN g ON s.stream = g.stream) SELECT stream, NOT r AND NOT b AND coalesce(a, true) AS ok, NOT r AS can_inspect, NOT r AND NOT b AS can_lock, coalesce(a, NOT r) AS can_write, b OR NOT coalesce(a, true) AS must_wait, r AS must_repair FROM j")
def ledger_health(spark, d):
    e = linked_events(spark, d)
    blockers = C.table(spark, d, "events").where("event_type = 'error' AND event_id % 4 = 0").select(F.col("user_id").alias("stream"))
    guards = C.table(spark, d, "events").where("event_type = 'view' AND user_id % 3 = 0").select(F.col("user_id").alias("stream"), (F.col("event_id") % 9 != 4).alias("allowed"))
    return ledger.health(e, ledger.link_breaks(e), blockers, guards)


@C.query("WITH s AS (SELECT user_id, max(ts) + INTERVAL 7200 SECOND AS expires_at FROM events WHERE event_id % 5 <> 0 GROUP BY 1) SELECT e.event_id AS claim_id, CASE WHEN s.user_id IS NULL OR expires_at < TIMESTAMP '2024-01-30 12:00:00' THEN 'resolve' ELSE 'keep' END AS action FROM events e LEFT JOIN s ON e.user_id = s.user_id WHERE event_type = 'signup'")
def stale_claim_repair(spark, d):
    e = C.table(spark, d, "events")
    sessions = e.where("event_id % 5 <> 0").groupBy(F.col("user_id").alias("session")).agg((F.max("ts") + F.expr("INTERVAL 7200 SECOND")).alias("expires_at"))
    return ledger.stale_claims(e.where("event_type = 'signup'").select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("session")), sessions, F.to_timestamp(F.lit("2024-01-30 12:00:00")))


@C.query("WITH m AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND event_id % 2 = 0) SELECT 'click' AS lane, count(*) FILTER (m.user_id IS NOT NULL) AS released, coalesce(sum(event_id % 4 + 1) FILTER (m.user_id IS NOT NULL), 0)::BIGINT AS paths, count(*) FILTER (m.user_id IS NULL) AS \"left\" FROM events e LEFT JOIN m ON e.user_id = m.user_id WHERE event_type = 'click'")
def lane_closeout(spark, d):
    e = C.table(spark, d, "events")
    paths = F.transform(F.sequence(F.lit(0), F.col("event_id") % 4), lambda k: F.concat(F.lit("src/"), k.cast("string")))
    claims = e.select(F.col("event_type").alias("lane"), F.col("user_id").alias("writer"), paths.alias("paths"))
    return ledger.closeout(claims, "click", e.where("event_type = 'signup' AND event_id % 2 = 0").select(F.col("user_id").alias("writer")))


@C.query("SELECT user_id, arg_max(event_type, event_id) AS state, arg_max(event_type, event_id) NOT IN ('purchase', 'signup') AS is_open FROM events GROUP BY 1")
def worker_last_state(spark, d):
    return ledger.last_states(C.table(spark, d, "events"), "user_id", "event_type", ["event_id"], ("purchase", "signup"))


@C.query("SELECT conv_id AS lane, arg_max(turn, turn) AS message_id FROM conversations WHERE (conv_id * 31 + turn) % 3 <> 0 GROUP BY 1")
def ack_latest(spark, d):
    m = C.table(spark, d, "conversations").select(F.col("conv_id").alias("lane"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("turn").alias("at"))
    acks = m.where((F.col("lane") * 31 + F.col("at")) % 3 == 0).select("message_id")
    return ledger.latest_unread(m, acks).select("lane", (F.col("message_id") - F.col("lane") * 1000).cast("int").alias("message_id"))


@C.query("SELECT user_id, count(*) AS n, sum(event_id % 4 + 1)::BIGINT AS n_paths FROM events WHERE event_type = 'view' GROUP BY 1")
def released_path_counts(spark, d):
    paths = F.sequence(F.lit(0), F.col("event_id") % 4)
    return C.table(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.size(paths)).alias("n_paths"))


@C.query("""WITH e AS (SELECT conv_id AS s, turn AS q, role AS w, md5(text) AS h FROM conversations), o AS (SELECT s, q, w, h FROM e WHERE (s + q) % 6 <> 0), n AS (SELECT s, q, w, CASE WHEN (s + q) % 5 = 0 THEN 'new' ELSE h END AS h FROM e WHERE (s + q) % 7 <> 0),
j AS (SELECT coalesce(o.s || '/' || o.q, n.s || '/' || n.q) AS rel, CASE WHEN n.s IS NULL THEN 'missing' WHEN o.s IS NULL THEN 'extra' WHEN o.h IS DISTINCT FROM n.h THEN 'changed' END AS status FROM o FULL JOIN n ON o.s = n.s AND o.q = n.q) SELECT status, count(*) AS n, count(*) > 0 AS stale FROM j WHERE status IS NOT NULL GROUP BY 1""")
def server_staleness(spark, d):
    e = C.table(spark, d, "conversations")
    k = F.col("conv_id") + F.col("turn")
    rel = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("rel")
    old = e.where(k % 6 != 0).select(rel, F.md5("text").alias("sha256"))
    new = e.where(k % 7 != 0).select(rel, F.when(k % 5 == 0, "new").otherwise(F.md5("text")).alias("sha256"))
    return evidence.hash_diff(old, new).groupBy("status").agg(F.count("*").alias("n")).withColumn("stale", F.col("n") > 0)


# files and folders of a tree that grows with the table; a third of the claims are folders above the files that others ask for
_TREE = """c AS (SELECT event_id AS id, 'u' || user_id % 29 AS writer, user_id % 5 AS worktree, event_type AS branch, ['inspect', 'edit', 'commit', 'merge', 'push'][event_id % 5 + 1] AS operation,
'src/m' || event_id // 40 || CASE WHEN event_id % 3 = 0 THEN '' ELSE '/f' || event_id % 7 || '.ts' END AS path FROM events), held AS (SELECT * FROM c WHERE id % 4 = 1 AND operation <> 'inspect'), req AS (SELECT * FROM c WHERE id % 4 <> 1)"""


@C.query(f"""WITH {_TREE}, t AS (SELECT r.id, h.writer = r.writer AS own, h.worktree = r.worktree AS w, h.branch = r.branch AS b, h.path AS held FROM req r JOIN held h ON r.path = h.path OR starts_with(r.path, h.path || '/') OR starts_with(h.path, r.path || '/')),
s AS (SELECT id, count(*) FILTER (NOT own AND (w OR b)) AS hard, count(*) FILTER (NOT own AND NOT w AND NOT b) AS risks, coalesce(bool_or(own AND w), false) AS owned FROM t GROUP BY 1),
k AS (SELECT path FROM held GROUP BY path, worktree HAVING count(DISTINCT writer) > 1 UNION SELECT path FROM held GROUP BY path, branch HAVING count(DISTINCT writer) > 1), n AS (SELECT count(*) AS n FROM k), here AS (SELECT id, count(DISTINCT held) AS n FROM t WHERE held IN (SELECT path FROM k) GROUP BY 1),
j AS (SELECT r.id, r.operation, coalesce(s.hard, 0) AS hard, coalesce(s.risks, 0) AS merge_risks, CASE WHEN coalesce(s.owned, false) THEN 0 ELSE 1 END AS unowned, n.n - coalesce(here.n, 0) AS elsewhere FROM req r CROSS JOIN n LEFT JOIN s ON s.id = r.id LEFT JOIN here ON here.id = r.id)
SELECT id AS request_id, operation, (operation <> 'inspect' AND hard > 0) OR (operation = 'merge' AND merge_risks > 0) OR (operation = 'commit' AND unowned > 0) AS blocked, hard::BIGINT AS hard, merge_risks::BIGINT AS merge_risks, unowned::BIGINT AS unowned, elsewhere + CASE WHEN operation = 'inspect' THEN hard + merge_risks ELSE 0 END AS global_warnings FROM j""")
def focused_guard(spark, d):
    i = F.col("event_id")
    path = F.concat(F.lit("src/m"), F.floor(i / 40).cast("string"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("/f"), (i % 7).cast("string"), F.lit(".ts"))))
    operation = F.element_at(F.array(*map(F.lit, ("inspect", "edit", "commit", "merge", "push"))), (i % 5 + 1).cast("int"))
    c = C.table(spark, d, "events").select(i.alias("request_id"), F.concat(F.lit("u"), (F.col("user_id") % 29).cast("string")).alias("writer"), (F.col("user_id") % 5).alias("worktree"), F.col("event_type").alias("branch"), operation.alias("operation"), path.alias("path"))
    return ledger.focused_guard(c.where("request_id % 4 <> 1"), c.where("request_id % 4 = 1"))


_NODES = _CLAIMS.replace("'w' || user_id % 7 AS writer", "'n' || user_id % 3 || '.l' || user_id % 5 AS writer").replace("'w' || event_id % 7", "'n' || event_id % 3 || '.l' || event_id % 5").replace("'w' || (event_id + 1) % 7", "'n' || (event_id + 1) % 3 || '.l' || (event_id + 1) % 5")


@C.query(f"""WITH {_NODES}, c AS (SELECT path, writer, max(event_id) AS t FROM o WHERE kind = 'claim' GROUP BY ALL), h AS (SELECT writer, path FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = c.path AND o.event_id > c.t AND ((o.kind = 'release' AND o.writer = c.writer)
OR (o.kind = 'resolve' AND CASE WHEN o.owner IS NOT NULL THEN o.owner <> c.writer WHEN o.owners IS NOT NULL THEN list_contains(o.owners, c.writer) ELSE true END)))), m AS (SELECT * FROM h WHERE split_part(writer, '.', 2) = 'l2')
SELECT count(*) AS initial, count(DISTINCT path) AS released, count(*) FILTER (writer <> 'n1.l2') AS repaired, 0::BIGINT AS remaining, true AS ok FROM m""")
def closeout_run(spark, d):
    i, t = F.col("event_id"), F.col("event_type")
    name = lambda a: F.concat(F.lit("n"), (a % 3).cast("string"), F.lit(".l"), (a % 5).cast("string"))
    kind = F.when(t == "signup", "claim").when(t == "click", "intent").when(t == "view", "release").when(t == "error", "resolve")
    path = F.concat(F.lit("src/"), F.floor(i / 97).cast("string"), F.lit("/a.ts"))
    e = C.table(spark, d, "events").select("event_id", kind.alias("kind"), name(F.col("user_id")).alias("writer"), path.alias("path"), F.when(i % 3 == 0, name(i)).alias("owner"), F.when(i % 3 == 1, F.array(name(i), name(i + 1))).alias("owners"))
    return ledger.closeout_run(e, "event_id", "n1", ledger.closeout_matches(lane="l2"))
