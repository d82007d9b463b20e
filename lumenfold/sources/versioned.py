"""A store of versions: a write publishes a new one as a whole or not at all, and readers of older ones aren't disturbed.

A store is a folder: `data/<write>/` has the Parquet files of a write, `versions/<number>.json` names the files of a
version. Files count once a version names them, so those of a task that ran twice, or of a write that failed, never show.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "lumenfold-versioned"


class Conflict(RuntimeError):
    """Another write has published since the version that this one builds on."""


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _create(store: pafs.FileSystem, name: str, content: bytes) -> None:
    """Write a file that must not be there yet. On a local or mounted store the system sees to that; elsewhere one writer at a time must."""
    if isinstance(store, pafs.LocalFileSystem):
        try:
            with open(name, "xb") as f:
                f.write(content)
        except FileExistsError as e:
            raise Conflict(name) from e
        return
    if store.get_file_info(name).type != pafs.FileType.NotFound:
        raise Conflict(name)
    with store.open_output_stream(f"{name}.{uuid.uuid4().hex}") as f:
        f.write(content)
    store.move(f.name, name)


def versions(path: str) -> list[int]:
    """The numbers of the versions that are kept, oldest first."""
    store, root = _folder(path)
    found = store.get_file_info(pafs.FileSelector(f"{root}/versions", allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))


def _manifest(path: str, version: int) -> dict:
    store, root = _folder(path)
    with store.open_input_stream(f"{root}/versions/{version:012d}.json") as f:
        return json.loads(f.read())


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, base: int, schema: T.StructType):
        self.path, self.base, self.schema, self.id = path, base, schema, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = _folder(self.path)
        store.create_dir(f"{root}/data/{self.id}", recursive=True)
        name, rows, out = f"data/{self.id}/{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            if out is None:
                out = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=store, compression="zstd")
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
        return Part(name if out is not None else "", rows)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _folder(self.path)
        store.create_dir(f"{root}/versions", recursive=True)
        parts = [m for m in messages if m is not None and m.rows]
        manifest = {"files": sorted(m.name for m in parts), "rows": sum(m.rows for m in parts), "schema": self.schema.json(), "parent": self.base}
        try:
            _create(store, f"{root}/versions/{self.base + 1:012d}.json", json.dumps(manifest).encode())
        except Conflict:
            self.abort(messages)
            raise

    def abort(self, messages: list[Part | None]) -> None:
        store, root = _folder(self.path)
        if store.get_file_info(f"{root}/data/{self.id}").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/data/{self.id}")


class VersionedStore(DataSource):
    """`df.write.format(FORMAT).mode("append").option("path", ...).option("base", n).save()` publishes df as version n + 1."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options["base"]), schema)


def publish(df: DataFrame, path: str, base: int | None = None) -> int:
    """Write df as the version after `base`, by default after the newest; Conflict if there is one already. Returns its number."""
    spark = df.sparkSession
    spark.dataSource.register(VersionedStore)
    base = base if base is not None else max(versions(path), default=0)
    try:
        df.write.format(FORMAT).mode("append").option("path", path).option("base", base).save()
    except Exception as e:
        if "Conflict" in str(e):
            raise Conflict(f"{path}: version {base + 1} is there already") from e
        raise
    return base + 1


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the store, by default the newest; its files are read as they are named there, whatever is published later."""
    manifest = _manifest(path, version if version is not None else max(versions(path)))
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    base = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return spark.read.schema(schema).parquet(*[f"{base}/{name}" for name in manifest["files"]]) if manifest["files"] else spark.createDataFrame([], schema)


def upsert(rows: DataFrame, path: str, key: list[str], order: str) -> int:
    """Publish the newest version with `rows` in it: of rows with one key the one that is last in `order` stays, of ties the new one.

    Rows without a key value are one key. The first upsert makes the store. Conflict if another write comes in between.
    """
    base = max(versions(path), default=0)
    every = rows.withColumn("_new", F.lit(1))
    if base:
        every = read(rows.sparkSession, path, base).withColumn("_new", F.lit(0)).unionByName(every)
    columns = [c for c in rows.columns if c not in key]
    best = every.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(order, "_new")).alias("_row"))
    return publish(best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in columns]).select(*rows.columns), path, base)


def vacuum(path: str, keep: int = 2) -> list[str]:
    """Forget all but the newest `keep` versions and delete the files that none of these names; returns the files' names."""
    store, root = _folder(path)
    kept = versions(path)[-keep:] if keep else []
    used = {name for v in kept for name in _manifest(path, v)["files"]}
    for v in versions(path)[: -keep or None]:
        store.delete_file(f"{root}/versions/{v:012d}.json")
    found = store.get_file_info(pafs.FileSelector(f"{root}/data", recursive=True, allow_not_found=True))
    gone = sorted(f.path for f in found if f.type == pafs.FileType.File and f.path[len(root) + 1 :] not in used)
    for name in gone:
        store.delete_file(name)
    return [name[len(root) + 1 :] for name in gone]
