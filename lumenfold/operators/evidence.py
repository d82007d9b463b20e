"""Evidence: content hashes, registries that should agree, and claims that should hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import literals


def hash_diff(old: DataFrame, new: DataFrame, key: str = "rel", digest: str = "sha256") -> DataFrame:
    """(key, status): missing, changed or extra in new; a change breaks parity like what is missing, extras don't."""
    joined = old.select(key, F.col(digest).alias("_old"), F.lit(1).alias("_a")).join(new.select(key, F.col(digest).alias("_new"), F.lit(1).alias("_b")), key, "full_outer")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return joined.select(key, status.alias("status")).where(F.col("status").isNotNull())


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def drift(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, field, left, right): fields of rows with one key that differ."""
    r = right.select(*key, *[F.col(c).alias(f"_{c}") for c in fields])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("left"), F.col(f"_{c}").cast("string").alias("right")) for c in fields])
    return left.join(r, key).select(*key, F.inline(F.filter(pairs, lambda p: ~p["left"].eqNullSafe(p["right"]))))


def claim_violations(claims: DataFrame, definitions: DataFrame, latest: DataFrame) -> DataFrame:
    """(claim_id, code): what is wrong with each claim(claim_id).

    definitions(claim_id, required_sha), latest(claim_id, status, sha): a claim must be defined, have a run,
    and that run must have passed with the required content. A claim with a run gets an `accepted` row as well.
    """
    j = claims.select("claim_id").distinct().join(definitions.withColumn("_d", F.lit(True)), "claim_id", "left").join(latest.withColumn("_r", F.lit(True)), "claim_id", "left")
    no_run = F.col("_r").isNull()
    codes = F.array(
        F.when(F.col("_d").isNull(), "undefined"),
        F.when(no_run, "never-run"),
        F.when(~no_run & (F.col("status") != "passed"), "not-passed"),
        F.when(~no_run & F.col("_d").isNotNull() & ~F.col("sha").eqNullSafe(F.col("required_sha")), "stale"),
        F.when(~no_run, "accepted"),
    )
    return j.select("claim_id", F.explode(F.array_compact(codes)).alias("code"))


def content_fingerprint(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, fingerprint): digest of a group's files as sorted rows of path, content hash and length.

    Rows are put together for each group, as the digest is one over all of them in order; so a group must be a folder
    of a bounded number of files, and what grows is the number of folders.
    """
    row = F.concat(F.col("rel"), F.lit("\u0001"), F.sha2(F.col("text").cast("binary"), 256), F.lit("\u0001"), F.octet_length("text").cast("string"), F.lit("\n"))
    return files.groupBy(*by).agg(F.count("*").alias("n"), F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "").cast("binary"), 256)).alias("fingerprint"))


def count_labels(rows: DataFrame, labels) -> DataFrame:
    """(label, n): how many rows have each label of an array column."""
    return rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def literal_owners(contracts: DataFrame, files: DataFrame, tokens: bool = False) -> DataFrame:
    """(item_id, rel): files whose text contains a contract's text, with `tokens` as one that stands alone; all contracts are looked for in one pass (see literals)."""
    found = literals.occurrences(files.select("rel", "text"), contracts.select(F.col("item_id").alias("literal_id"), F.col("text").alias("literal")), tokens=tokens)
    return found.select(F.col("literal_id").alias("item_id"), "rel")
