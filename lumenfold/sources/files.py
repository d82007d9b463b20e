"""Relations of files and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED_DIRS = (".git", "node_modules", "target", "dist", "build", ".venv", "__pycache__")


def read_files(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED_DIRS, forced: str | None = None) -> DataFrame:
    """files(root, rel, ext, text) below root, without ignored folders unless they are the one asked for."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = root.rstrip("/").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in prefix) + "/", "")
    files = raw.select(F.lit(root).alias("root"), rel.alias("rel"), F.decode("content", "UTF-8").alias("text"))
    hidden = F.exists(F.split("rel", "/"), lambda part: part.isin(*ignored))
    keep = ~hidden | F.startswith(F.col("rel"), F.lit(forced)) if forced else ~hidden
    return files.where(keep).withColumn("ext", F.regexp_extract("rel", r"(\.[^./]+)$", 1))


def only_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    """files named in changed(rel)."""
    return files.join(changed.select("rel").distinct(), "rel", "left_semi")


def status_paths(status: DataFrame) -> DataFrame:
    """rel of status lines(line): what follows the two-letter code, the new name of a rename, without quotes."""
    name = F.element_at(F.split(F.substring("line", 4, 1 << 30), " -> "), -1)
    return status.where(F.length("line") > 3).select(F.regexp_replace(name, '^"|"$', "").alias("rel")).distinct()


def lines(files: DataFrame) -> DataFrame:
    """lines(rel, line_no, line), line_no from 1. An empty text is one empty line; a null text has none."""
    return files.select("rel", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line")).select("rel", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def documents_as_files(documents: DataFrame) -> DataFrame:
    """files(rel, text, lang) of the documents table: source/doc_id.lang, `unknown` for a source or a language that is null."""
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    return documents.select(F.concat(known("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), known("lang")).alias("rel"), "text", "lang", "source", "doc_id")
