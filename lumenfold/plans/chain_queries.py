"""Queries of hash chains over events: a user's events are a stream, each covered by the digest of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import chain
from lumenfold.plans import catalog as C


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """Events before they are chained; every 17th has no payload."""
    i = F.col("event_id")
    return C.table(spark, d, "events").select(
        F.col("user_id").alias("stream"), i.alias("ordinal"), F.concat(F.lit("e"), i.cast("string")).alias("id"), F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        F.when(i % 17 != 0, F.col("props")).alias("payload"),
    )


def sealed(spark: SparkSession, d: str) -> DataFrame:
    every = drafts(spark, d)
    none = spark.createDataFrame([], "stream long, seq long, id string, hash string")
    return chain.append(none, every)


def tampered(spark: SparkSession, d: str) -> DataFrame:
    """A chain in which one event in a hundred has another payload, one in a hundred is lost and one in a hundred points wrongly."""
    r = F.col("ordinal") % 100
    return sealed(spark, d).where(r != 57).withColumns({"payload": F.when(r == 7, "changed").otherwise(F.col("payload")), "prev_id": F.when(r == 31, "e0").otherwise(F.col("prev_id"))})


def _f(*names: str) -> str:
    return " || ".join(f"CASE WHEN {n} IS NULL THEN '-' ELSE strlen({n}::VARCHAR) || ':' || {n}::VARCHAR END" for n in names)


def _chained(name: str, source: str) -> str:
    """Recursive SQL: source(stream, ordinal, id, type, ts, payload) numbered and chained from 1 on."""
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ordinal) AS seq, lag(id) OVER (PARTITION BY stream ORDER BY ordinal) AS prev_id FROM {source}),
{name} AS (SELECT *, NULL::VARCHAR AS prev_hash, 'sha256:' || sha256({_f(*chain.ENVELOPE)} || '-') AS hash FROM {name}_n WHERE seq = 1
UNION ALL SELECT n.*, c.hash, 'sha256:' || sha256({_f(*[f'n.{c}' for c in chain.ENVELOPE])} || {_f('c.hash')}) FROM {name} c JOIN {name}_n n ON n.stream = c.stream AND n.seq = c.seq + 1)"""


_DRAFTS = "drafts AS (SELECT user_id AS stream, event_id AS ordinal, 'e' || event_id AS id, event_type AS type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, CASE WHEN event_id % 17 <> 0 THEN props END AS payload FROM events)"
_TAMPERED = _DRAFTS + ", " + _chained("sealed", "drafts") + """, bad AS (SELECT stream, ordinal, seq, id, type, ts, CASE WHEN ordinal % 100 = 7 THEN 'changed' ELSE payload END AS payload,
CASE WHEN ordinal % 100 = 31 THEN 'e0' ELSE prev_id END AS prev_id, prev_hash, hash FROM sealed WHERE ordinal % 100 <> 57)"""


@C.query(f"WITH RECURSIVE {_DRAFTS}, {_chained('sealed', 'drafts')} SELECT stream, seq, id, prev_id, prev_hash, hash FROM sealed")
def ledger_sealed(spark, d):
    return sealed(spark, d).select("stream", "seq", "id", "prev_id", "prev_hash", "hash")


@C.query(f"""WITH RECURSIVE {_TAMPERED}, k AS (SELECT *, coalesce(lag(seq) OVER w, 0) + 1 AS s, lag(id) OVER w AS i, lag(hash) OVER w AS h FROM bad WINDOW w AS (PARTITION BY stream ORDER BY ordinal))
SELECT stream, ordinal, 'sequence' AS code FROM k WHERE seq <> s UNION ALL SELECT stream, ordinal, 'previous-id' FROM k WHERE prev_id IS DISTINCT FROM i UNION ALL SELECT stream, ordinal, 'previous-hash' FROM k WHERE prev_hash IS DISTINCT FROM h
UNION ALL SELECT stream, ordinal, 'hash' FROM k WHERE hash <> 'sha256:' || sha256({_f(*chain.ENVELOPE, 'prev_hash')})""")
def ledger_chain_errors(spark, d):
    return chain.chain_errors(tampered(spark, d))


_REPAIRED = f"""WITH RECURSIVE {_TAMPERED}, again AS (SELECT stream, ordinal, id, type, ts, payload FROM bad), {_chained('mended', 'again')}
SELECT m.stream, m.ordinal, m.seq, m.prev_id, m.prev_hash, m.hash, (b.seq, b.prev_id, b.prev_hash, b.hash) IS DISTINCT FROM (m.seq, m.prev_id, m.prev_hash, m.hash) AS changed FROM mended m JOIN bad b ON m.stream = b.stream AND m.ordinal = b.ordinal"""


@C.query(_REPAIRED)
def ledger_rehash(spark, d):
    return chain.rehash(tampered(spark, d)).select("stream", "ordinal", "seq", "prev_id", "prev_hash", "hash", "changed")


@C.query(f"WITH RECURSIVE {_DRAFTS}, {_chained('sealed', 'drafts')}, n AS (SELECT stream, count(*) FILTER (ordinal % 3 <> 2) AS n FROM drafts GROUP BY 1), d2 AS (SELECT stream, ordinal + CASE WHEN ordinal % 3 = 2 THEN 1000000000 ELSE 0 END AS ordinal, id, type, ts, payload FROM drafts), "
         f"{_chained('joined', 'd2')} SELECT b.stream, b.seq, b.id, b.prev_id, b.hash FROM joined b JOIN n ON b.stream = n.stream WHERE b.seq > n.n")
def ledger_chain_append(spark, d):
    every = drafts(spark, d)
    none = spark.createDataFrame([], "stream long, seq long, id string, hash string")
    first = chain.append(none, every.where("ordinal % 3 <> 2"))
    return chain.append(first, every.where("ordinal % 3 = 2")).select("stream", "seq", "id", "prev_id", "hash")
