"""What each filter of a cascade removes, alone and after others, in every order.

A counting Bloom sketch of all texts comes first: tasks count cells, the counts are merged, and a text of which a cell
was met only once is unique. Only the rest, possible repeats, is shuffled as whole texts for the smallest id of each.
Every row then is a mask of the filters it fails, and all figures follow from sums over masks: a row with k failing
filters is removed by each of them in 1 / k of the orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

LETTERS, REPEAT = "ABCDE", "E"

SEGMENT = 1 << 16  # cells
CELLS_PER_TEXT, HASHES = 16, 4
#: The sketch that tasks receive, one bit a cell, takes no more than this. Beyond 67 million texts it has fewer than CELLS_PER_TEXT
#: cells for each, so that more unique texts are shuffled; the result is the same.
SKETCH_BYTES = 128 << 20
_FLUSH = 1 << 20  # hashes that a task counts before it emits


def fails() -> dict[str, Column]:
    """Conditions under which a row fails, over text, n_words and n_distinct; the repeat filter is the last letter."""
    text, n, distinct = F.col("text"), F.col("n_words"), F.col("n_distinct")
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text), "D": text.rlike("[#$%&*|]")}


# --- the sketch ----------------------------------------------------------------------------------


def n_segments(n_texts: int) -> int:
    return min(max(-(-n_texts * CELLS_PER_TEXT // SEGMENT), 1), SKETCH_BYTES * 8 // SEGMENT)


def _cells(key: np.ndarray) -> np.ndarray:
    """HASHES cells of a segment for each 64-bit key, sixteen bits of the key each."""
    return (key[:, None] >> np.arange(0, 16 * HASHES, 16, dtype=np.uint64)) & np.uint64(SEGMENT - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, cells, twice) of a task: the cells that it met, and which of them more than once."""

    def emit(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, times = np.unique(np.concatenate(parts), return_counts=True)
        segment = (cell >> np.uint64(16)).astype(np.int32)
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        ends = np.append(first[1:], len(cell))
        low, twice = (cell & np.uint64(0xFFFF)).astype("<u2"), (times > 1).astype(np.uint8)
        for k in range(0, len(first), 1024):
            rows = [(int(segment[a]), low[a:b].tobytes(), twice[a:b].tobytes()) for a, b in zip(first[k : k + 1024], ends[k : k + 1024])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["segment", "cells", "twice"])

    parts, n = [], 0
    for batch in batches:
        segment, key = np.asarray(batch.column(0)).astype(np.uint64), np.asarray(batch.column(1)).astype(np.int64).view(np.uint64)
        cell = np.sort(_cells(key), axis=1)
        # a text counts a cell once, also where two of its hashes fall on it
        keep = np.append(np.ones((len(cell), 1), bool), cell[:, 1:] != cell[:, :-1], axis=1)
        parts.append((segment[:, None] << np.uint64(16) | cell)[keep])
        n += len(key)
        if n >= _FLUSH:
            yield from emit(parts)
            parts, n = [], 0
    if n:
        yield from emit(parts)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, words): a bit for each cell that was counted twice or more, by 64 bits."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, cells, twice in zip(*(c.to_pylist() for c in batch.columns)):
            total = counts.setdefault(segment, np.zeros(SEGMENT, np.uint8))
            at = np.frombuffer(cells, "<u2")
            total[at] = np.minimum(total[at] + 1 + np.frombuffer(twice, np.uint8), 2)
    for segment, total in counts.items():
        words = np.packbits(total > 1, bitorder="little").view("<i8")
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([words])], names=["segment", "words"])


def _addressed(rows: DataFrame, segments: int) -> DataFrame:
    """rows(hash) with the segment and the key of the hash."""
    return rows.withColumns({"segment": F.pmod("hash", F.lit(segments)).cast("int"), "key": F.xxhash64("hash")})


def repeat_sketch(hashes: DataFrame, segments: int) -> DataFrame:
    """(segment, words) of hashes(hash long), merged over all tasks; bounded by SKETCH_BYTES.

    A task emits a segment once for many hashes, so a text that fills a third of the table is one count a task.
    """
    partial = _addressed(hashes.select("hash"), segments).select("segment", "key").mapInArrow(_count, "segment int, cells binary, twice binary")
    return partial.repartition("segment").mapInArrow(_merge, "segment int, words array<long>")


def with_repeatable(rows: DataFrame, sketch: DataFrame, segments: int) -> DataFrame:
    """rows(hash) with `repeatable`: false where the sketch shows that no other row has the text."""
    at = [F.shiftright("key", 16 * i).bitwiseAND(F.lit(SEGMENT - 1)).cast("int") for i in range(HASHES)]
    met = [F.getbit(F.get("words", F.shiftright(p, 6)), p.bitwiseAND(F.lit(63))) == 1 for p in at]
    every = met[0]
    for m in met[1:]:
        every &= m
    return _addressed(rows, segments).join(F.broadcast(sketch), "segment", "left").withColumn("repeatable", F.coalesce(every, F.lit(False))).drop("segment", "key", "words")


# --- masks ---------------------------------------------------------------------------------------


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, hash, digest) of docs(doc_id, text, lang): the filters but the last, a bit each, and two hashes of the text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("trimmed", F.btrim("text", F.lit(" \t\n\x0b\x0c\r")))
    rows = rows.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", "[\\x20\\x09-\\x0D]+")))
    rows = rows.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))})
    mask = F.lit(0)
    for k, condition in enumerate(fails().values()):
        mask += F.when(condition, 1 << k).otherwise(0)
    return rows.select("doc_id", "part", mask.alias("mask"), F.xxhash64("text").alias("hash"), F.unhex(F.sha2("text", 256)).alias("digest"))


def first_ids(docs: DataFrame, sketch: DataFrame, segments: int) -> DataFrame:
    """(digest, first_id) of the texts that docs holds more than once; texts that the sketch clears are not shuffled."""
    text = F.coalesce("text", F.lit(""))
    rows = with_repeatable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash")), sketch, segments)
    groups = rows.where("repeatable").groupBy("text").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return groups.where("n > 1 and first_id is not null").select(F.unhex(F.sha2("text", 256)).alias("digest"), "first_id")


def flags(docs: DataFrame, tables: S.Scratch) -> DataFrame:
    """(doc_id, part, mask) of every row, the repeat filter included, as a settled table."""
    rows = tables.settle(masks(docs), "audit-masks")
    segments = n_segments(rows.count())
    sketch = tables.settle(repeat_sketch(rows, segments), "audit-sketch")
    firsts = tables.settle(first_ids(docs, sketch, segments), "audit-firsts")
    marked = with_repeatable(rows, sketch, segments)
    last = 1 << LETTERS.index(REPEAT)
    judged = marked.where("repeatable").join(firsts, "digest", "left").withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first_id"), last).otherwise(0))
    out = marked.where(~F.col("repeatable")).select("doc_id", "part", "mask").unionByName(judged.select("doc_id", "part", "mask"))
    return tables.settle(out, "audit-flags", drop=("audit-masks", "audit-sketch", "audit-firsts"))


def mask_counts(flagged: DataFrame, labels: DataFrame, tables: S.Scratch) -> DataFrame:
    """(part, mask, n, good, toxic): rows by the filters they fail, and those of them with either label."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    marks = tables.settle(marks.where("doc_id is not null and good + toxic > 0"), "audit-labels")  # written, so that a join may split an id with many rows
    labelled = flagged.join(marks, "doc_id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    every = flagged.groupBy("part", "mask").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return every.unionByName(labelled).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The figures of every order and step from counts(part, mask, n, good, toxic); a part has at most 2 ** len(letters) masks."""
    orders = ["".join(p) for p in permutations(letters)]
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = rows.select("part", "cells", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    rows = rows.select("part", "cells", "filter_order", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bit, before = F.lit(0), F.lit(0)
    for k, letter in enumerate(letters):
        bit += F.when(F.col("letter") == letter, 1 << k).otherwise(0)
        before += F.when(F.instr("filter_order", letter) <= F.col("at"), 1 << k).otherwise(0)
    rows = rows.select("part", "cells", "filter_order", (F.col("at") + 1).alias("step"), bit.alias("bit"), before.alias("before"))

    def total(value, where) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(where(c.mask), value(c)).otherwise(0))

    def now(m):
        return m.bitwiseAND(F.col("bit")) != 0

    def earlier(m):
        return m.bitwiseAND(F.col("before")) != 0

    def removed(m):
        return now(m) & ~earlier(m)

    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: c.n, lambda m: ~now(m) & ~earlier(m)).alias("kept"),
        total(lambda c: c.n, removed).alias("removed"),
        total(lambda c: c.n, lambda m: now(m) & earlier(m)).alias("redundant"),
        total(lambda c: c.n, lambda m: m == F.col("bit")).alias("unique_fails"),
        total(lambda c: c.good, removed).alias("good_lost"),
        total(lambda c: c.toxic, removed).alias("toxic_lost"),
        total(lambda c: (c.n * F.lit(len(orders)) / F.bit_count(c["mask"])).cast("long"), now).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (lang; null and empty are one), order of the five filters and step.

    Null texts are empty. A row without a doc_id never fails the repeat filter, nor makes another fail it, and has
    no label; rows that repeat an id and a text are equally old. Of repeated labels of an id, any 1 counts.
    Other columns are ignored; an empty table has no parts and no rows.
    """
    tables = S.Scratch(docs.sparkSession)
    flagged = flags(docs, tables)
    counts = tables.settle(mask_counts(flagged, labels, tables), "audit-counts", drop=("audit-flags", "audit-labels"))
    return interactions(counts)


ORACLE = r"""
with docs as (
  select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), masks as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(w) < 100 then 1 else 0 end
    + case when 100 * len(list_distinct(w)) < 80 * len(w) then 2 else 0 end
    + case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) then 4 else 0 end
    + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask
  from docs left join marks using (doc_id)
), counts as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masks group by part, mask
), letters as (
  select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as x(f, b)
), orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e where a.b | b.b | c.b | d.b | e.b = 31
), steps as (
  select filter_order, cast(step as int) as step, (select b from letters where f = filter_order[step]) as bit,
    coalesce((select sum(b) from letters where instr(filter_order, f) < step), 0)::int as before
  from orders, range(1, 6) as s(step)
), shares as (
  select part, b as bit, sum(n * 120 // bit_count(mask::int)) as shapley from counts, letters where mask & b <> 0 group by part, b
)
select p.part, filter_order, step,
  coalesce(sum(n) filter (mask & (bit | before) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as toxic_lost,
  coalesce(max(shapley), 0)::bigint as shapley
from counts p cross join steps left join shares using (part, bit) group by p.part, filter_order, step
"""
