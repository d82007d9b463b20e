"""What the operators share: scratch tables, Arrow text blocks, and word hashes in numpy.

Texts stay in Arrow's own buffers: a block is one uint8 array with document offsets, cut from a batch so
that the numpy temporaries of a task stay bounded whatever the batch size is.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of a block; its numpy temporaries, several times as large, should fit into a processor cache.
BLOCK_BYTES = 1 << 18
#: Bytes of a shuffle that a task takes, where their number is known beforehand.
TASK_BYTES = 128 << 20


# --- scratch tables ------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, where they are one, a folder of our own if none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", base) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return base


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lumenfold/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return that table: it cuts the lineage there.

    The shuffle files behind df are of no more use then, so they may go.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Settled tables of one operator by name, so that each can be deleted once the next no longer reads it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def settle(self, df: DataFrame, name: str, drop: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
        """Write df, in folders by the columns `by`, and return the table; then delete the tables named in `drop`, which df was the last to read."""
        path = scratch(self.spark, name)
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        self.paths[name] = path
        self.drop(*drop)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_of_id(id_col: Column) -> Column:
    """crc32 of the id written as decimal text; of a null id, that of the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def n_tasks(spark: SparkSession, n_bytes: int = 0) -> int:
    """Tasks for a shuffle of so many bytes: the session's number, or more if a task would get above TASK_BYTES."""
    return max(-(-n_bytes // TASK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# --- Arrow text blocks ---------------------------------------------------------------------------


@dataclass
class Block:
    """Some rows of a batch: buf holds their texts one after the other, off where each starts."""

    rows: pa.RecordBatch
    buf: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return len(self.off) - 1


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying; null counts as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    if column.null_count:  # a null may still cover bytes
        length = np.diff(off)
        if (gone := np.asarray(column.is_null()) & (length > 0)).any():
            raw = raw[np.repeat(~gone, length)]
            off = np.concatenate(([0], np.cumsum(np.where(gone, 0, length))))
    return raw, off - off[0]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks of at most `most` text bytes, or one longer text each."""
    for batch in batches:
        raw, off = text_view(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, len(off) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            to = min(to, n)
            yield Block(batch.slice(at, to - at), raw[off[at] : off[to]], off[at : to + 1] - off[at])
            at = to


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i+1]] for each i."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


# --- word hashes ---------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", _UNBASE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each buf[start:end]."""
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_ranges(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words `[^\\x20\\x09-\\x0D]+`; words of text i are first[i]:first[i+1]."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = _SPACE[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    before[edge] = after[edge - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(buf: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first): see word_ranges; A-Z are lower-cased if asked."""
    starts, ends, first = word_ranges(buf, off)
    return (range_hash(_LOWER[buf] if lower else buf, starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-word window inside a text, number of windows of each text)."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    if not count.sum():
        return np.zeros(0, np.uint64), count
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = total * _BASE + hashes[k : len(hashes) - n + 1 + k]
    at = np.repeat(first[:-1], count) + ragged(count)
    return mix(total[at]), count


def ragged(count: np.ndarray) -> np.ndarray:
    """0..count[0]-1, 0..count[1]-1 and so on."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)


def fields(rows: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [rows.column(rows.schema.get_field_index(n)) for n in names]
