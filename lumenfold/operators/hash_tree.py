"""Digests of long sequences as trees of aligned runs: two sides are compared from their roots down to where they differ.

A node is the digest of its up to FANOUT children in order, so no row holds more than a run, whatever the length of
a sequence, and two trees that share a prefix share the nodes that lie in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import ledger
from lumenfold.sources.stores import settled

FANOUT = 64


def _run_digest(fanout: int) -> Column:
    """Of (pos, hash) rows of one run: absent and null hashes are told apart from others."""
    one = F.struct((F.col("pos") % fanout).alias("at"), F.coalesce("hash", F.lit("-")).alias("hash"))
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.concat(x["at"].cast("string"), F.lit("="), x["hash"])), "\n").cast("binary"), 256)


def levels(rows: DataFrame, by: list[str], fanout: int = FANOUT) -> list[DataFrame]:
    """(by, pos, hash) of each level from the rows(by, pos from 0, hash) up to one node a group, each a table."""
    out = [rows.select(*by, F.col("pos").cast("long").alias("pos"), "hash")]
    top = rows.agg(F.max("pos")).first()[0] or 0
    while top > 0 or len(out) == 1:
        out.append(settled(out[-1].groupBy(*by, F.floor(F.col("pos") / fanout).alias("_up")).agg(_run_digest(fanout).alias("hash")).withColumnRenamed("_up", "pos"), f"tree-{len(out)}"))
        top //= fanout
    return out


def first_differences(ours: list[DataFrame], theirs: list[DataFrame], by: list[str], fanout: int = FANOUT) -> DataFrame:
    """(by, pos): the first place at which two trees differ, for each group that differs; a group that one side lacks differs at 0 or its first place.

    From the roots down, only the children of the first node that differs are compared, so a group costs a run a
    level. Trees of unlike height are compared from the top of the lower one.
    """
    height = min(len(ours), len(theirs)) - 1
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    found: DataFrame | None = None
    for k in range(height, -1, -1):
        a, b = ours[k], theirs[k]
        if found is not None:
            up = found.select(*by, F.col("pos").alias("_up"))
            below = lambda t: t.withColumn("_up", F.floor(F.col("pos") / fanout)).join(up, [*by, "_up"], "left_semi").drop("_up")  # noqa: B023, E731
            a, b = below(a), below(b)
        j = a.alias("a").join(b.alias("b"), reduce(lambda x, y: x & y, [*same, F.col("a.pos") == F.col("b.pos")]), "full_outer")
        keys = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in by]
        unlike = F.col("a.pos").isNull() | F.col("b.pos").isNull() | ~F.col("a.hash").eqNullSafe(F.col("b.hash"))
        found = settled(j.where(unlike).select(*keys, F.coalesce("a.pos", "b.pos").alias("pos")).groupBy(*by).agg(F.min("pos").alias("pos")), f"differs-{k}")
    return found


def suffix_sync(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(stream, seq, action) as ledger.suffix_sync has it, of local and remote(stream, seq from 1, hash): events before the first difference of a stream are in no join."""
    trees = [levels(side.select("stream", (F.col("seq") - 1).alias("pos"), "hash"), ["stream"]) for side in (local, remote)]
    differs = first_differences(*trees, ["stream"]).select("stream", (F.col("pos") + 1).alias("_from"))
    suffix = lambda side: side.join(differs, "stream").where(F.col("seq") >= F.col("_from")).drop("_from")
    return ledger.suffix_sync(suffix(local), suffix(remote))


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with `pos`, 0, 1, ... in the order of a group, however many rows a group has.

    Rows are dealt by ranges over (by, order) and counted by range; a running sum over ranges gives the places.
    """
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = settled(dealt.withColumn("_part", F.shiftright("_at", 33)), "numbered")
    group = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*by, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    parts = parts.select(*by, "_part", (F.coalesce(F.sum("_n").over(group), F.lit(0)) - F.col("_low")).alias("_shift"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in by] + [F.col("d._part") == F.col("p._part")]
    j = dealt.alias("d").join(parts.alias("p"), reduce(lambda x, y: x & y, same))
    return j.select(*[F.col(f"d.{c}").alias(c) for c in rows.columns], (F.col("d._at") + F.col("p._shift")).alias("pos"))


def folder_digests(files: DataFrame, by: list[str], fanout: int = FANOUT) -> DataFrame:
    """(by, files, digest) of files(by, rel, text): the root over a folder's files in order of rel, then of content.

    A file's own digest is over its path, its content and whether it has one. No row holds a folder.
    """
    one = F.sha2(F.concat_ws("\n", F.col("rel"), F.when(F.col("text").isNull(), "-").otherwise(F.sha2(F.col("text").cast("binary"), 256))).cast("binary"), 256)
    rows = numbered(files.select(*by, "rel", one.alias("hash")), by, ["rel", "hash"])
    tree = levels(settled(rows.select(*by, "pos", "hash"), "folder-files"), by, fanout)
    count = tree[0].groupBy(*by).agg(F.count("*").alias("files"))
    root = tree[-1].select(*[F.col(c).alias(f"_{c}") for c in by], F.col("hash").alias("digest"))
    return count.join(root, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])).select(*by, "files", "digest")
