"""Merkle manifest of a table: a tree for each key over its rows in order, and a tree over the keys' roots.

Rows get their places by one range partitioning, a count for each part and a running sum over parts. Aligned blocks of
FANOUT ** DEPTH rows then hold each of their levels as one string of hex digests: fixed-width substrings of it are hashed
into the parents' string, and what stands left and right of a node in its run is its segment of a proof. The roots
of the blocks are the nodes of the next tier, and the roots of the keys those of the last tree, built by the same code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

FANOUT, DEPTH = 8, 4
BLOCK = FANOUT**DEPTH
WIDTH = 64  # of a digest in hex
RUN = FANOUT * WIDTH
ROW_BYTES = 128  # about what a row takes in the shuffle that orders them
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_SEGMENTS = "array<struct<left:binary,right:binary>>"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest)).cast("binary")


def _hash(data: Column) -> Column:
    """SHA-256 as hex, as bytes: substrings of bytes need no search for characters."""
    return F.sha2(data, 256).cast("binary")


# --- leaves and places ---------------------------------------------------------------------------


def leaf_of(*values: Column) -> Column:
    """Digest of the values, each `-` if null, else its number of UTF-8 bytes, a colon and itself."""
    parts = []
    for v in values:
        v = v.cast("string")
        parts.append(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, leaf, tampered) of docs; key sorts like lang with null first, tampered is null where the row is as it was."""
    doc_id, text, lang = F.col("doc_id").cast("long"), F.col("text"), F.col("lang").cast("string")
    head = (doc_id, F.col("source"), lang, F.col("n_chars"))
    chosen = (F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0) & text.rlike("[A-Z]")
    return docs.select(
        F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang)).alias("key"),
        doc_id.alias("doc_id"),
        leaf_of(*head, text).alias("leaf"),
        F.when(chosen, leaf_of(*head, F.translate(text, UPPER, LOWER))).alias("tampered"),
    )


def placed(rows: DataFrame, order: list[str], n: int, tables: S.Scratch, name: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """rows(key, ...) with `pos`, their place from 0 in the key's order, and `total`, the key's rows.

    Rows equal in all of `order` are told apart by where they stand, so that a range can end between them.
    """
    tasks = S.n_tasks(rows.sparkSession, n * ROW_BYTES)
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(tasks, "key", *order, "tie").sortWithinPartitions("key", *order, "tie").drop("tie")
    dealt = tables.settle(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), name, drop)
    parts = dealt.groupBy("key", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    key = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("key", "part", (before - F.col("low")).alias("shift"), F.sum("n").over(key).alias("total"))
    return dealt.join(parts, ["key", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


# --- blocks and tiers ----------------------------------------------------------------------------


def _parents(level: Column) -> Column:
    """The string of the level above: every RUN bytes, fewer in the last run, become their digest."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * RUN + 1, F.lit(RUN)), 256)), "").cast("binary")


def with_levels(blocks: DataFrame) -> DataFrame:
    """blocks(nodes, levels) with level0 to level<DEPTH>, null above its root, and `top`, the root's digest."""
    out = blocks.withColumn("level0", F.array_join(F.transform("nodes", lambda x: F.lower(F.hex(x.leaf))), "").cast("binary"))
    for k in range(DEPTH):
        out = out.withColumn(f"level{k + 1}", F.when(F.col("levels") > k, _parents(F.col(f"level{k}"))))
    return out.withColumn("top", F.coalesce(*(F.col(f"level{k}") for k in range(DEPTH, -1, -1))))


def _segments(pos: Column) -> Column:
    """Left and right siblings of the node at `pos`, level by level up to its block's root."""
    found, at = [], (pos % BLOCK).cast("int")
    for k in range(DEPTH):
        node = F.floor(at / FANOUT**k).cast("int")
        inside, run = node % FANOUT, node - node % FANOUT
        level = F.col(f"level{k}")
        left = F.substring(level, run * WIDTH + 1, inside * WIDTH)
        right = F.substring(level, (node + 1) * WIDTH + 1, (FANOUT - 1 - inside) * WIDTH)
        found.append(F.struct(F.coalesce(left, F.lit(b"")).alias("left"), F.coalesce(right, F.lit(b"")).alias("right")))
    return F.slice(F.array(*found), F.lit(1), F.col("levels"))


def tiers(nodes: DataFrame, payload: list[str], tables: S.Scratch, name: str, drop: tuple[str, ...] = ()) -> list[DataFrame]:
    """Blocks from the nodes(key, pos, total, leaf, ...) up to one block a key: (key, block, total, levels, nodes) of each tier."""
    found: list[DataFrame] = []
    while True:
        small = sum(((F.col("total") > FANOUT**k).cast("int") for k in range(DEPTH)), F.lit(0))
        grouped = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("key", "block", "total")
        rows = grouped.agg(F.sort_array(F.collect_list(F.struct("pos", "leaf", *payload))).alias("nodes"))
        found.append(tables.settle(rows.withColumn("levels", F.when(F.col("total") > BLOCK, DEPTH).otherwise(small)), f"{name}-{len(found)}", drop))
        if (found[-1].agg(F.max("total")).first()[0] or 0) <= BLOCK:
            return found
        nodes = with_levels(found[-1]).select("key", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.unhex(F.col("top").cast("string")).alias("leaf"))
        payload, drop = [], ()


def down(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """(key, block, above, ...) for the blocks of the lowest tier, from above(key, block 0, above, ...): the segments over each block."""
    for tier in found[:0:-1]:
        rows = with_levels(tier).join(above, ["key", "block"])
        carried = [c for c in above.columns if c not in ("key", "block", "above")]
        over = F.transform("nodes", lambda x: F.struct(x.pos.alias("block"), F.concat(_segments(x.pos), F.col("above")).alias("above")))
        above = rows.select("key", *carried, F.inline(over))
    return above


def fold(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and the siblings left and right of its path lead to."""
    return F.aggregate(segments, leaf, lambda acc, s: _hash(F.concat(s.left, acc, s.right)))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs(doc_id, source, lang, n_chars, text).

    Rows of a lang stand by doc_id, null first, then by leaf; rows equal throughout are told apart by their place and
    each has its own proof. A null or empty text is a leaf like others, a null lang is a key of its own before the empty
    one. Rows without an id are not tampered with. Other columns are ignored; an empty table gives no rows and no root. A
    task holds one block, at most BLOCK rows of digests.
    """
    tables = S.Scratch(docs.sparkSession)
    rows = tables.settle(leaves(docs), "merkle-leaves")
    found = tiers(placed(rows, ["doc_id", "leaf"], rows.count(), tables, "merkle-places", ("merkle-leaves",)), ["doc_id", "tampered"], tables, "merkle-tier", ("merkle-places",))
    subroots = tables.settle(with_levels(found[-1]).select(F.lit("").alias("key"), F.col("key").alias("name"), F.unhex(F.col("top").cast("string")).alias("leaf")), "merkle-subroots")
    keys = tiers(placed(subroots, ["name"], subroots.count(), tables, "merkle-keys", ("merkle-subroots",)), ["name"], tables, "merkle-root", ("merkle-keys",))
    root = with_levels(keys[-1]).select("key", "block", F.array().cast(NO_SEGMENTS).alias("above"), F.col("top").alias("root"))
    over = with_levels(keys[0]).join(down(keys, root), ["key", "block"])
    of_key = F.transform("nodes", lambda x: F.struct(x["name"].alias("key"), _hex(x.leaf).alias("subroot"), F.concat(_segments(x.pos), F.col("above")).alias("above")))
    above = over.select("root", F.inline(of_key)).withColumn("block", F.lit(0).cast("long"))
    blocks = with_levels(found[0]).join(down(found, tables.settle(above, "merkle-above")), ["key", "block"])
    proved = F.transform("nodes", lambda x: F.struct(x.doc_id.alias("doc_id"), x.leaf.alias("leaf"), x.tampered.alias("tampered"), F.concat(_segments(x.pos), F.col("above")).alias("siblings")))
    digests = F.transform(
        proved,
        lambda x: F.struct(
            x.doc_id.alias("doc_id"),
            _hex(x.leaf).cast("string").alias("leaf"),
            F.sha2(F.aggregate(x.siblings, F.lit(b""), lambda acc, s: F.concat(acc, s.left, s.right)), 256).alias("proof_sha256"),
            fold(_hex(F.coalesce(x.tampered, x.leaf)), x.siblings).cast("string").alias("folded_root"),
        ),
    )
    out = blocks.select(F.col("subroot").cast("string").alias("subroot"), F.col("root").cast("string").alias("root"), F.inline(digests))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# --- SQL -----------------------------------------------------------------------------------------


def _oracle(levels: int = 8) -> str:
    """SQL by levels: one row a node, parents by grouping eight rows; a tree higher than `levels` is more than it can build."""

    def value(x: str) -> str:
        return f"case when {x} is null then '-' else strlen({x}::varchar) || ':' || {x}::varchar end"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(value, ("d.doc_id", "source", "lang", "n_chars", text))) + ")"

    def tree(name: str, base: str) -> list[str]:
        """Nodes of each level with whether their key goes on, from base(key, pos, h)."""
        out = [f"{name}0 as (select key, pos, h, count(*) over (partition by key) > 1 as more from {base})"]
        for k in range(levels):
            out.append(f"{name}{k + 1} as (select key, pos, h, count(*) over (partition by key) > 1 as more from (select key, pos // 8 as pos, sha256(string_agg(h, '' order by pos)) as h from {name}{k} where more group by key, pos // 8))")
        out.append(f"{name}_top as ({' union all '.join(f'select key, h from {name}{k} where not more' for k in range(levels + 1))})")
        return out

    def walk(name: str, start: str, carry: str) -> list[str]:
        """Siblings of each node of start(key, pos, fold, proof, ...) level by level."""
        out = [f"{name}_walk0 as (select * from {start})"]
        for k in range(levels):
            left = f"coalesce((select string_agg(s.h, '' order by s.pos) from {name}{k} s where s.more and s.key = w.key and s.pos // 8 = w.pos // 8 and s.pos < w.pos), '')"
            right = left.replace("s.pos < w.pos", "s.pos > w.pos")
            more = f"exists (select 1 from {name}{k} s where s.more and s.key = w.key)"
            out.append(f"{name}_side{k} as materialized (select w.*, {left} as l, {right} as r, {more} as goes from {name}_walk{k} w)")
            out.append(f"{name}_walk{k + 1} as (select {carry}, key, case when goes then pos // 8 else pos end as pos, proof || l || r as proof, case when goes then sha256(l || fold || r) else fold end as fold from {name}_side{k})")
        return out

    return "with " + ",\n".join(
        [
            "bits as (select n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as v from (select unnest(range(256))::bigint as n))",
            "crc as (select list(v order by n) as t from bits)",
            "ids as (select doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 3 = 0 as chosen from (select distinct doc_id from documents where doc_id is not null), crc)",
            f"leaves as (select d.doc_id, lang, coalesce('=' || lang, '') as key, {leaf('text')} as h, case when chosen then {leaf('translate(text, ' + repr(UPPER) + ', ' + repr(LOWER) + ')')} end as bad from documents d left join ids on ids.doc_id = d.doc_id)",
            "base as (select *, row_number() over (partition by key order by doc_id nulls first, h) - 1 as pos from leaves)",
            *tree("t", "base"),
            "roots as (select '' as key, key as name, row_number() over (order by key) - 1 as pos, h from t_top)",
            *tree("r", "roots"),
            "start as (select doc_id, h as leaf, key as lang_key, key, pos, coalesce(bad, h) as fold, '' as proof from base)",
            *walk("t", "start", "doc_id, leaf, lang_key"),
            f"upper_start as (select doc_id, leaf, lang_key, '' as key, r.pos, fold, proof from t_walk{levels} w join roots r on r.name = w.lang_key)",
            *walk("r", "upper_start", "doc_id, leaf, lang_key"),
        ]
    ) + (
        "\nselect w.doc_id, leaf, s.h as subroot, t.h as root, sha256(proof) as proof_sha256, fold as folded_root, fold = t.h as verified "
        f"from r_walk{levels} w join roots s on s.name = w.lang_key cross join r_top t"
    )


ORACLE = _oracle()
