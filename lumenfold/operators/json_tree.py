"""JSON at any depth: documents as rows of leaves, by exploding variants level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depth(json: Column) -> Column:
    """How many containers lie in one another at most, brackets inside strings not counted."""
    brackets = F.regexp_extract_all(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', ""), F.lit(r"([\[\]{}])"), 1)
    first = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, b):
        now = acc["now"] + F.when(b.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(brackets, first, step, lambda acc: acc["most"])


def leaves(rows: DataFrame, json: str, by: list[str]) -> DataFrame:
    """(by, path, kind, value): each value of rows(by, json text) that is no container, or an empty one.

    A path is `$` with `.key` and `[position]`; kinds are string, number, boolean, null, object and array; the value is
    text, null for null. A text that is no JSON, or repeats a key in an object, is one row of kind `malformed`; a null
    text is none. One pass without a shuffle, unrolled to the deepest nesting that the table has.
    """
    t = rows.where(F.col(json).isNotNull()).select(*by, F.col(json).alias("_json"))
    levels = t.agg(F.max(depth(F.col("_json")))).first()[0] or 0
    parsed = t.withColumn("_v", F.try_parse_json("_json"))
    out = parsed.where("_v IS NOT NULL").select(*by, F.lit("$").alias("path"), F.col("_v"))
    spark = rows.sparkSession
    for _ in range(levels):
        shape = F.schema_of_variant("_v")
        inner = out.withColumn("_c", F.when(shape.startswith("OBJECT") | shape.startswith("ARRAY"), F.col("_v")))
        each = inner.lateralJoin(spark.tvf.variant_explode_outer(F.col("_c").outer()))
        here = F.col("pos").isNotNull()
        part = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        out = each.select(*by, F.when(here, F.concat("path", part)).otherwise(F.col("path")).alias("path"), F.when(here, F.col("value")).otherwise(F.col("_v")).alias("_v"))
    shape = F.schema_of_variant("_v")
    kind = (
        F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("number")
    )
    whole = out.select(*by, "path", kind.alias("kind"), F.col("_v").cast("string").alias("value"))
    bad = parsed.where("_v IS NULL").select(*by, F.lit("$").alias("path"), F.lit("malformed").alias("kind"), F.col("_json").alias("value"))
    return whole.unionByName(bad)


def at_path(json: Column, path: str) -> Column:
    """The text of the value at `$.a.b[0]`, null where there is none, or where the text is no JSON; a container is its JSON."""
    return F.try_variant_get(F.try_parse_json(json), path, "string")


def strings(rows: DataFrame, json: str, by: list[str]) -> DataFrame:
    """(by, value): the distinct string values, at any depth, of each row's JSON; keys are no values."""
    return leaves(rows, json, by).where("kind = 'string'").select(*by, "value").distinct()


def export_targets(packages: DataFrame) -> DataFrame:
    """(package, target): the relative files that the `exports` of packages(package, text) name, at any depth, without `./`."""
    exports = packages.select("package", at_path(F.col("text"), "$.exports").alias("exports"))
    # a lone string comes out of its document without quotes
    quoted = F.when(F.col("exports").rlike(r"^\s*[{\[]"), F.col("exports")).otherwise(F.to_json(F.array("exports")))
    found = strings(exports.select("package", quoted.alias("exports")), "exports", ["package"])
    return found.where(F.startswith(F.col("value"), F.lit("./"))).select("package", F.substr("value", F.lit(3)).alias("target")).distinct()
