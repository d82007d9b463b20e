"""Layered configuration, globs and boundaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """`**` is any characters, `*` any but a slash, `?` one but a slash; everything else stands for itself."""
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return "^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + r"\z"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def overlaid(base: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """base with rows of overlay in place of its own by key, and then the rest of overlay."""
    layers = base.withColumn("_layer", F.lit(0)).unionByName(overlay.withColumn("_layer", F.lit(1)))
    columns = [c for c in base.columns if c != key]
    return layers.groupBy(key).agg(F.max_by(F.struct(*columns), "_layer").alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def merged(settings: DataFrame, by: list[str], layer: Column) -> DataFrame:
    """(by, key, value): the value of the last layer that sets it, from settings(by, key, value)."""
    return settings.where(F.col("value").isNotNull()).groupBy(*by, "key").agg(F.max_by("value", layer).alias("value"))


def boundary_violations(imports: DataFrame, policies: list[dict]) -> DataFrame:
    """(rel, specifier, message): imports(rel, specifier) below a policy's roots that it forbids and doesn't allow."""
    hits = []
    for p in policies:
        under = F.lit(False)
        for root in p["roots"]:
            under |= (F.col("rel") == root) | F.startswith(F.col("rel"), F.lit(root.rstrip("/") + "/"))
        bad = under & matches_any(F.col("specifier"), p["forbidden"]) & ~matches_any(F.col("specifier"), p.get("allowed", []))
        hits.append(F.when(bad, F.lit(p["message"])))
    found = imports.select("rel", "specifier", F.array_compact(F.array(*hits)).alias("messages"))
    return found.select("rel", "specifier", F.explode("messages").alias("message"))


def fail_fast(findings: DataFrame) -> DataFrame:
    """findings of the first file, in order of rel, that has any: findings are gathered by file and the first file is taken."""
    columns = [c for c in findings.columns if c != "rel"]
    per = findings.where(F.col("rel").isNotNull()).groupBy("rel").agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    return per.orderBy("rel").limit(1).select("rel", F.explode("_rows").alias("_row")).select("rel", *[F.col(f"_row.{c}").alias(c) for c in columns])


def merged_sets(settings: DataFrame, by: list[str]) -> DataFrame:
    """(by, key, values): the union, sorted, of what all layers of settings(by, key, values array) list."""
    one = settings.select(*by, "key", F.explode("values").alias("value")).distinct()
    return one.groupBy(*by, "key").agg(F.array_sort(F.collect_list("value")).alias("values"))


def merged_registry(layers: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, version): of layers(layer, ordinal, schema_version, key, ...), each key's row of the last layer at its first place, and the highest version."""
    columns = [c for c in layers.columns if c not in (key, "layer", "ordinal", "schema_version")]
    rows = layers.groupBy(key).agg(F.max_by(F.struct(*columns), "layer").alias("_row"), F.min_by("ordinal", "layer").alias("ordinal"))
    return rows.select(key, "ordinal", *[F.col(f"_row.{c}").alias(c) for c in columns]), layers.agg(F.max("schema_version").alias("schema_version"))
