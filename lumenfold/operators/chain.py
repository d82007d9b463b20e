"""Hash chains: ledgers in which each event's digest covers the digest of the one before.

The envelope is our own: the fields of ENVELOPE in this order, each `-` if null, else its number of UTF-8 bytes, a colon
and itself; a digest is `sha256:` and the SHA-256 of it in hex. Other columns, such as a context, are not covered.

Checking a chain needs no fold: an event is held against its own envelope and against what stands before it. Only
repair and append compute digests one after the other, from the first event that changes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.operators import ledger

ENVELOPE = ("stream", "seq", "id", "type", "ts", "payload", "prev_id")  # and prev_hash, the last
_START, _BODY = "_start", "_body"


def field(value: Column) -> Column:
    v = value.cast("string")
    return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def _digest_of(body: str, prev_hash: str | None) -> str:
    tail = "-" if prev_hash is None else f"{len(prev_hash.encode())}:{prev_hash}"
    return "sha256:" + hashlib.sha256((body + tail).encode()).hexdigest()


def body() -> Column:
    """The envelope without its last field."""
    return F.concat(*[field(F.col(c)) for c in ENVELOPE])


def digest() -> Column:
    """The digest that an event with these columns should have."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(body(), field(F.col("prev_hash"))).cast("binary"), 256))


def chain_errors(events: DataFrame) -> DataFrame:
    """(stream, ordinal, code) of events(stream, ordinal, seq, id, type, ts, payload, prev_id, prev_hash, hash).

    Codes are those of ledger.link_breaks, and `hash` for an event whose digest isn't that of its envelope.
    """
    wrong = events.where(~F.col("hash").eqNullSafe(digest())).select("stream", "ordinal", F.lit("hash").alias("code"))
    return ledger.link_breaks(events).unionByName(wrong)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """prev_hash and hash of rows that come stream by stream in order; the first of a stream brings its prev_hash along."""
    stream, prev, begun = None, None, False
    for batch in batches:
        at = {n: k for k, n in enumerate(batch.schema.names)}
        before, after = [], []
        for s, start, seed, text in zip(*(batch.column(at[c]).to_pylist() for c in ("stream", _START, "prev_hash", _BODY))):
            if start or not begun or s != stream:
                stream, prev, begun = s, seed, True
            before.append(prev)
            prev = _digest_of(text, prev)
            after.append(prev)
        columns = {n: batch.column(k) for n, k in at.items() if n not in (_START, _BODY)}
        columns["prev_hash"], columns["hash"] = pa.array(before, pa.string()), pa.array(after, pa.string())
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _folded(rows: DataFrame) -> DataFrame:
    """rows with their digests, and without the fold's own columns. A stream is one task's, row by row, with one digest in memory."""
    out = T.StructType([f for f in rows.schema if f.name not in (_START, _BODY)])
    return rows.repartition("stream").sortWithinPartitions("stream", "ordinal").mapInArrow(_fold, out)


def rehash(events: DataFrame, renumber: bool = True) -> DataFrame:
    """events, in the columns they have, with seq, prev_id, prev_hash and hash as they should be, and `changed`.

    renumber counts 1..n in the order of `ordinal`; without it the sequence numbers stay and only links and digests
    are mended. Streams without an error, and events before a stream's first one, are left as they are and aren't folded.
    A null stream is a stream of its own; ordinals must differ within a stream.
    """
    w = Window.partitionBy("stream").orderBy("ordinal")
    wanted = {"seq": F.row_number().over(w).cast("long") if renumber else F.col("seq").cast("long"), "prev_id": F.lag("id").over(w), "prev_hash": F.lag("hash").over(w), "hash": digest()}
    columns = events.columns
    rows = events.withColumns({f"_{c}": v for c, v in wanted.items()})
    wrong = F.lit(False)
    for c in wanted:
        wrong |= ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = rows.withColumn("_from", F.min(F.when(wrong, F.col("ordinal"))).over(Window.partitionBy("stream")))
    bad = F.col("_from").isNotNull() & (F.col("ordinal") >= F.col("_from"))
    whole = rows.where(~bad).select(*columns, F.lit(False).alias("changed"))
    old = F.struct(*[F.col(c).alias(c) for c in wanted]).alias("_old")
    # the event before the first wrong one is right, so its digest, read as _prev_hash there, starts the fold
    tail = rows.where(bad).withColumn(_START, F.col("ordinal") == F.col("_from")).withColumn("_old", old)
    tail = tail.withColumns({"seq": F.col("_seq").cast(events.schema["seq"].dataType), "prev_id": F.col("_prev_id"), "prev_hash": F.col("_prev_hash")}).withColumn(_BODY, body())
    mended = _folded(tail.select(*columns, "_old", _START, _BODY))
    changed = F.lit(False)
    for c in wanted:
        changed |= ~F.col(c).eqNullSafe(F.col(f"_old.{c}"))
    return whole.unionByName(mended.select(*columns, changed.alias("changed")))


def append(events: DataFrame, drafts: DataFrame) -> DataFrame:
    """drafts(stream, ordinal, id, type, ts, payload, ...) as events that go on from the last of each stream of events(stream, seq, id, hash).

    They come in the order of `ordinal`, with seq, prev_id, prev_hash and hash; a stream without events starts at 1
    and points at nothing.
    """
    last = events.groupBy("stream").agg(F.max_by(F.struct("seq", "id", "hash"), "seq").alias("_last"))
    last = last.select(F.col("stream").alias("_stream"), "_last")
    w = Window.partitionBy("stream").orderBy("ordinal")
    k = F.row_number().over(w)
    rows = drafts.join(last, F.col("stream").eqNullSafe(F.col("_stream")), "left")
    rows = rows.withColumns({
        "seq": (F.coalesce("_last.seq", F.lit(0)) + k).cast("long"), "prev_id": F.when(k == 1, F.col("_last.id")).otherwise(F.lag("id").over(w)), "prev_hash": F.col("_last.hash"), _START: k == 1, "hash": F.lit(None).cast("string"),
    })
    return _folded(rows.withColumn(_BODY, body()).drop("_stream", "_last"))
