"""Tables of globs as an index: a glob meets only the paths that share its literal parts.

A glob's anchor is all that it fixes at once: its first folders before a wildcard, its file name or the name's beginning,
and its extension. The few shapes of anchors that a table has (how many folders, how long a beginning) are worked out first,
and a path offers one key for each, so both sides meet in an equi join and the pattern is tried on what is left. Only
a glob that fixes nothing is held against all paths of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.sources.stores import settled

#: `**` is any characters, `*` any but a slash. PLAIN reads `?` as one character; SCOPE reads it as itself and `dir/**` as the folder too.
PLAIN, SCOPE = "plain", "scope"


def pattern(glob: Column, dialect: str = PLAIN) -> Column:
    """The glob as a pattern over a whole path."""
    literal = r"([.+?^$(){}|\[\]\\])" if dialect == SCOPE else r"([.+^$(){}|\[\]\\])"
    body = F.regexp_replace(glob, literal, r"\\$1")
    if dialect == PLAIN:
        body = F.replace(body, F.lit("?"), F.lit("[^/]"))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\*\*", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*")
    whole = F.concat(F.lit("^"), body, F.lit(r"\z"))
    if dialect == PLAIN:
        return whole
    # what stands before the last `/**` of a scope is a folder's name, wildcards included
    folder = F.regexp_replace(F.substr(glob, F.lit(1), F.length(glob) - 3), r"([.*+?^$(){}|\[\]\\])", r"\\$1")
    return F.when(F.endswith(glob, F.lit("/**")), F.concat(F.lit("^"), folder, F.lit(r"(?:/[\s\S]*)?\z"))).otherwise(whole)


#: Parts into which the paths under an anchor without a name are dealt, as there may be many of them.
DEALT = 16


def anchor(glob: Column, dialect: str = PLAIN) -> tuple[Column, Column]:
    """The shape of what a glob fixes (folders, length of the name's beginning or -1 for a whole name, whether an extension), and its key."""
    wild = "*?" if dialect == PLAIN else "*"
    head = F.regexp_extract(glob, f"^((?:[^{wild}/]*/)*)", 1)
    name = F.regexp_extract(glob, r"([^/]*)\z", 1)
    begin = F.regexp_extract(name, f"^([^{wild}]*)", 1)
    size = F.when(~name.rlike(f"[{wild}]"), -1).when(name.contains("**"), 0).otherwise(F.length(begin))
    extension = F.when(size >= 0, F.regexp_extract(glob, rf"\.([^./{wild}]+)\z", 1)).otherwise("")
    if dialect == SCOPE:
        below = F.endswith(glob, F.lit("/**"))
        head = F.when(below & (glob != "/**"), F.left(glob, F.length(glob) - 2)).when(below, "").otherwise(head)
        size, extension = F.when(below, 0).otherwise(size), F.when(below, "").otherwise(extension)
    folders = F.length(head) - F.length(F.replace(head, F.lit("/"), F.lit("")))
    shape = F.struct(folders.alias("folders"), size.alias("name"), (extension != "").alias("extension"))
    return shape, _key(shape, F.left(head, F.length(head) - 1), F.when(size == 0, "").otherwise(begin), extension)


def _key(shape: Column, folder: Column, name: Column, extension: Column) -> Column:
    return F.concat_ws("\u0001", shape["folders"].cast("string"), shape["name"].cast("string"), folder, name, extension)


def key(path: Column, shape: Column) -> Column:
    """The key under which a glob with an anchor of the shape may fit the path; null if none can."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    extension = F.when(shape["extension"], F.regexp_extract(path, r"\.([^./]+)\z", 1)).otherwise("")
    offered = _key(shape, F.array_join(F.slice(parts, F.lit(1), shape["folders"]), "/"), F.when(shape["name"] < 0, name).otherwise(F.left(name, shape["name"])), extension)
    return F.when((F.size(parts) >= shape["folders"]) & (F.length(name) >= shape["name"]) & (~shape["extension"] | (extension != "")), offered)


def matches(paths: DataFrame, globs: DataFrame, by: list[str], path: str = "rel", dialect: str = PLAIN) -> DataFrame:
    """The distinct (by, path) of `paths` beside each row of globs(by, glob, ...) that fits; nulls fit nothing.

    A glob has one anchor and a path has a key once, so no pair comes twice.
    """
    extra = [c for c in globs.columns if c not in (*by, "glob")]
    shape, anchored = anchor(F.col("glob"), dialect)
    part = F.explode(F.sequence(F.lit(0), F.when(shape["name"] == 0, DEALT - 1).otherwise(0)))
    g = globs.where(F.col("glob").isNotNull()).select(*by, *extra, anchored.alias("_key"), pattern(F.col("glob"), dialect).alias("_pattern"), part.alias("_part"))
    shapes = globs.where(F.col("glob").isNotNull()).select(*by, shape.alias("_shape")).distinct()
    p = paths.where(F.col(path).isNotNull()).select(*by, path).distinct()
    if by:
        p = p.join(F.broadcast(shapes), by)
    else:  # a few numbers
        had = [F.struct(F.lit(s.folders).alias("folders"), F.lit(s.name).alias("name"), F.lit(s.extension).alias("extension")) for (s,) in shapes.collect()]
        p = p.withColumn("_shape", F.explode(F.array(*had))) if had else p.limit(0).withColumn("_shape", F.struct(F.lit(0).alias("folders"), F.lit(0).alias("name"), F.lit(False).alias("extension")))
    dealt = F.when(F.col("_shape.name") == 0, F.pmod(F.xxhash64(path), F.lit(DEALT))).otherwise(0).cast("int")
    p = p.select(*by, path, key(F.col(path), F.col("_shape")).alias("_key"), dealt.alias("_part"))
    return p.join(g, [*by, "_key", "_part"]).where(F.regexp_like(F.col(path), F.col("_pattern"))).select(*by, path, *extra)


def first_match(paths: DataFrame, globs: DataFrame, by: list[str], values: list[str], path: str = "rel", dialect: str = PLAIN) -> DataFrame:
    """All rows of `paths` with `values` of the fitting glob of globs(by, ordinal, glob, values) with the least ordinal, null where none fits."""
    once = globs.groupBy(*by, "glob").agg(F.min(F.struct("ordinal", *values)).alias("_best"))  # of equal globs, only the first can count
    best = matches(paths, once, by, path, dialect)
    best = best.groupBy(*by, path).agg(F.min("_best").alias("_best")).select(*by, path, *[F.col(f"_best.{v}").alias(v) for v in values])
    return paths.join(settled(best, "first-match"), [*by, path], "left")  # written, so that the join may split a path with many rows


def last_values(paths: DataFrame, overrides: DataFrame, path: str = "rel", dialect: str = PLAIN) -> DataFrame:
    """(path, key, value): for each key of overrides(ordinal, glob, key, value), the value of the last fitting row that has one."""
    once = overrides.where("value IS NOT NULL").groupBy("glob", "key").agg(F.max(F.struct("ordinal", "value")).alias("_last"))  # of equal globs, only the last can count
    found = matches(paths, once, [], path, dialect)
    return found.groupBy(path, "key").agg(F.max("_last").alias("_last")).select(path, "key", F.col("_last.value").alias("value"))
