"""Stores of runs, events and registries as JSON lines, and collections of files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import ancestors


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; one of our own only in local mode, where they are one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
    return f"{base.rstrip('/')}/lumenfold/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written into the shared folder and read from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collected(*parts: DataFrame) -> DataFrame:
    """Files of several reads, each once, in order of rel; of files with one rel, the first read's counts."""
    out = parts[0].withColumn("_part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_part", F.lit(k)))
    columns = [c for c in out.columns if c not in ("rel", "_part")]
    first = out.groupBy("rel").agg(F.min_by(F.struct(*columns), "_part").alias("_row")).select("rel", *[F.col(f"_row.{c}").alias(c) for c in columns])
    return first.orderBy("rel")


def below(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files at or below any of roots(root), by an equi join over their ancestors; all files if there is no root."""
    if roots.isEmpty():
        return files
    r = roots.select(F.col("root").alias("_root")).distinct()
    hit = files.select("rel", F.explode(ancestors(F.col("rel"))).alias("_root")).join(r, "_root").select("rel").distinct()
    return files.join(hit, "rel", "left_semi")


def package_scope(files: DataFrame, manifests: DataFrame, name: str) -> DataFrame:
    """files below the folder of the manifest(rel, text) whose `[package]` section has the name."""
    own = F.regexp_extract("text", r'(?s)\[package\][^\[]*?\bname\s*=\s*"([^"]+)"', 1)
    roots = manifests.where(own == name).select(F.regexp_replace("rel", r"/?[^/]*$", "").alias("root"))
    return below(files, roots.where("root <> ''")) if not roots.isEmpty() else files.limit(0)


def changed_files(files: DataFrame, changes: DataFrame, kinds: str = "ACMR") -> DataFrame:
    """files named in changes(kind, rel) of one of the kinds: added, copied, modified, renamed."""
    wanted = changes.where(F.col("kind").substr(1, 1).isin(*kinds)).select("rel").distinct()
    return files.join(wanted, "rel", "left_semi")


def write_ndjson(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls included; a table without rows gives no line."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, read strictly: a line that doesn't fit fails the read. Empty lines count for nothing."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def first_root_wins(stores: list[DataFrame], key: str, default_storage: str = "runs") -> DataFrame:
    """Runs of several roots; of runs with one key, the one of the first root counts, with a storage if it has none."""
    out = stores[0].withColumn("_root", F.lit(0))
    for k, s in enumerate(stores[1:], 1):
        out = out.unionByName(s.withColumn("_root", F.lit(k)))
    columns = [c for c in out.columns if c not in (key, "_root")]
    rows = out.groupBy(key).agg(F.min_by(F.struct(*columns), "_root").alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])
    return rows.withColumn("storage", F.coalesce("storage", F.lit(default_storage)))


def by_manifest(manifest: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Runs in the manifest's order(ordinal); entries whose run is gone are left out."""
    return manifest.select(key, "ordinal").join(runs, key)


def exported(manifest: DataFrame, most: int = 20) -> DataFrame:
    """The first entries of a manifest, in its own order."""
    return manifest.orderBy("ordinal").limit(most)


def attestation(runs: DataFrame) -> DataFrame:
    """(run_id, document): a run's attestation as JSON, fields in a fixed order."""
    body = F.struct(F.lit(1).alias("schemaVersion"), F.col("run_id").alias("runId"), F.col("status").alias("status"), F.sha2(F.concat_ws("|", F.col("run_id").cast("string"), "status"), 256).alias("digest"))
    return runs.select("run_id", F.to_json(body).alias("document"))


def report(findings: DataFrame) -> DataFrame:
    """(ok, n, errors, warnings, document): one row that sums up findings(severity), with the report as JSON."""
    count = lambda s: F.count_if(F.col("severity") == s)
    out = findings.agg(F.count("*").alias("n"), count("error").alias("errors"), count("warning").alias("warnings")).withColumn("ok", F.col("errors") == 0)
    return out.withColumn("document", F.to_json(F.struct("ok", "n", "errors", "warnings")))


def sorted_manifest(manifest: DataFrame, changes: DataFrame, key: str, time: str) -> DataFrame:
    """The manifest with changes put in by key and newest first; its ordinal follows that order within each day.

    A day is a window of its own, so no task ranks the whole manifest.
    """
    from pyspark.sql import Window

    rows = manifest.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes).withColumn("day", F.to_date(time))
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("day").orderBy(F.desc(time), key)))


def read_index(claims: DataFrame) -> DataFrame:
    """(path, writers, claims): the index that readers use, built anew from claims(path, writer)."""
    per = claims.groupBy("path", "writer").agg(F.count("*").alias("c"))
    return per.groupBy("path").agg(F.count("*").alias("writers"), F.sum("c").alias("claims"))


def reset(spark: SparkSession, path: str) -> bool:
    """Delete a store; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scoped(files: DataFrame, mode: str, entries: DataFrame | None = None, manifests: DataFrame | None = None, package: str | None = None) -> DataFrame:
    """The files a scan covers: `all`, the `files` at or below entries(rel), a `diff` of changes(kind, rel), or a `package`'s."""
    if mode == "files":
        return below(files, entries.select(F.col("rel").alias("root")))
    if mode == "diff":
        return changed_files(files, entries)
    if mode == "package":
        return package_scope(files, manifests, package)
    if mode == "all":
        return files
    raise ValueError(f"unknown scope: {mode}")


def artifact_files(files: DataFrame, extensions: tuple[str, ...], most: int = 500) -> DataFrame:
    """The first `most` files, in order of rel, that have one of the extensions: the cap is part of the inventory."""
    ext = F.regexp_extract("rel", r"(\.[^./]+)$", 1)
    return files.where(ext.isin(*extensions)).orderBy("rel").limit(most)


def expected_fingerprint(expected: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """(by, n, missing, fingerprint) over expected(by, rel), a bounded list for each group: digest of rel, hash and length as JSON rows, nulls for absent files."""
    j = expected.join(files.select("rel", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").alias("bytes")), "rel", "left")
    row = F.struct("rel", "sha256", "bytes")
    out = j.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("sha256").isNull()).alias("missing"), F.array_sort(F.collect_list(row)).alias("rows"))
    return out.select(by, "n", "missing", F.sha2(F.to_json("rows", {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


def write_runs(runs: DataFrame, path: str, by: str = "tool") -> None:
    """Runs as JSON lines in a folder for each value of `by`."""
    runs.write.mode("overwrite").partitionBy(by).json(path)
