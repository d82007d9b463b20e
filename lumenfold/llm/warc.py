"""WARC archives compressed with a shared Zstandard dictionary.

A dictionary is built from a bounded sample of the records to be archived. Each archive starts with a
skippable frame that embeds it; every record is a frame of its own, so one record can be read alone. Equal
payloads of MIN_REVISIT bytes or more are stored once: Spark decides by digest which record keeps the payload,
the others become revisit records. Tasks write to the shared folder under a name of their own attempt, and
only the manifest, made of finished tasks, says which archives count.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared as S

MIN_REVISIT = 1000
DICT_BYTES = 64 << 10
#: The dictionary's sample: so many records, and so many bytes of each.
SAMPLE_RECORDS, SAMPLE_LONGEST = 400, 64 << 10
LEVEL = 3
#: A writer starts a new archive beyond so many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: Fixed values of the format: skippable frame that holds a dictionary, ordinary frame, revisit profile.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of too few or too small samples, their own bytes serve as one."""
    if not any(samples):
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def sample_records(pages: DataFrame) -> list[bytes]:
    """At most SAMPLE_RECORDS payloads, drawn by hash; of one above SAMPLE_LONGEST bytes, that many from a place drawn by hash."""
    total = pages.count()
    if not total:
        return []
    draw = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) / float(1 << 30)
    html = F.col("html").cast("binary")
    at = F.pmod(F.xxhash64("html"), F.greatest(F.octet_length(html) - SAMPLE_LONGEST, F.lit(0)) + 1) + 1
    drawn = pages.where(draw < min(1.0, 1.5 * SAMPLE_RECORDS / total)).select(F.substr(html, at.cast("int"), F.lit(SAMPLE_LONGEST)).alias("part"))
    return [bytes(r[0]) for r in drawn.where("part IS NOT NULL").limit(SAMPLE_RECORDS).toLocalIterator()]


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages(page_id, url, html) with digest, size and holder: the page_id whose record keeps the payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keyed = keyed.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    large = keyed.where(F.col("size") >= min_revisit)
    holders = large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    holders = S.settle(holders.where("n > 1").select("digest", "holder"), "warc-holders")  # a table, so that the join may split a hot digest
    joined = large.join(holders, "digest", "left")
    # small payloads can't be revisits; kept out of the join, equal ones don't meet in one task
    joined = joined.unionByName(keyed.where(F.col("size") < min_revisit).withColumn("holder", F.lit(None).cast("long")))
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("holder")) & F.col("holder").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "digest", "size", F.when(revisit, F.col("holder")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"))


def _record_id(page_id: int | None, what: str = "") -> str:
    """The same for the same record, so that a task that runs again writes the same bytes; records without a page_id are told apart by what they hold."""
    return f"<urn:uuid:{uuid.UUID(int=page_id % (1 << 128)) if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, what)}>"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path on it; Hadoop's names of stores are read as Arrow's."""
    for theirs, ours in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://"), ("dbfs:/", "file:///dbfs/")):
        if path.startswith(theirs):
            path = ours + path[len(theirs) :].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def record_bytes(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes | None) -> bytes:
    """One WARC record. A revisit keeps the digest and length of the payload it leaves out."""
    body = HTTP_HEAD + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, f'{url} {digest}')}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """The columns of RECORDS; of a response, length and digest are those of the payload read."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(field["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    number = lambda name: int(field[name]) if name in field else None
    url = field.get("WARC-Target-URI")
    url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    if field["WARC-Type"] == "revisit":
        return number("X-Page-Id"), url, number("X-Payload-Length"), field["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", number("X-Refers-To-Page"), None
    return number("X-Page-Id"), url, len(payload), hashlib.sha1(payload).hexdigest(), "response", None, payload


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", DICT_MAGIC, len(packed)) + packed if dictionary else b""


def write_archives(records: DataFrame, path: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of decide() below path; the manifest of the archives, already settled."""
    spark = records.sparkSession
    shared = spark.sparkContext.broadcast(dictionary)  # DICT_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        trained = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained)
        task, k, out, done = TaskContext.get(), 0, None, []
        for batch in batches:
            columns = S.fields(batch, "page_id", "url", "digest", "size", "refers_to", "payload")
            for row in zip(*columns):
                if out is None:
                    name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{k}.warc.zst"
                    out, n, size = store.open_output_stream(name), 0, 0
                    size += out.write(dictionary_frame(shared.value)) or 0
                frame = press.compress(record_bytes(*(x.as_py() for x in row)))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= archive_bytes:
                    out.close()
                    done.append((name, n, size))
                    k, out = k + 1, None
        if out is not None:
            out.close()
            done.append((name, n, size))
        base = path[: len(path) - len(folder)] if path.endswith(folder) else ""
        yield pa.RecordBatch.from_arrays([pa.array([base + d[0] for d in done], pa.string()), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2))], names=["path", "records", "bytes"])

    return S.settle(records.mapInArrow(run, MANIFEST), "warc-manifest")


def frames(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive one after the other; memory holds one of them."""
    buffer = stream.read(8)
    trained = None
    if len(buffer) == 8 and struct.unpack("<I", buffer[:4])[0] == DICT_MAGIC:
        held = stream.read(struct.unpack("<I", buffer[4:])[0])
        if held[:4] == struct.pack("<I", FRAME_MAGIC):
            held = zstandard.ZstdDecompressor().decompress(held)
        trained, buffer = zstandard.ZstdCompressionDict(held), b""
    open_up = zstandard.ZstdDecompressor(dict_data=trained)
    frame, parts = open_up.decompressobj(), []
    while True:
        buffer = buffer or stream.read(chunk)
        if not buffer:
            if parts:
                raise EOFError("the archive ends inside a record")
            return
        parts.append(frame.decompress(buffer))
        buffer = b""
        if frame.eof:
            buffer = frame.unused_data
            yield b"".join(parts)
            frame, parts = open_up.decompressobj(), []


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """RECORDS of all archives of a manifest; without payload, that column is null."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _store(path)
                with store.open_input_stream(name) as stream:
                    rows, held = [], 0
                    for raw in frames(stream):
                        row = parse_record(raw)
                        rows.append(row if payload else (*row[:-1], None))
                        held += len(raw) if payload else 200
                        if held >= 8 << 20:
                            yield _batch(rows, names, kinds)
                            rows, held = [], 0
                    yield _batch(rows, names, kinds)

    spread = manifest.select("path").repartition(S.n_tasks(manifest.sparkSession), "path")
    return spread.mapInArrow(run, RECORDS)


def _batch(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def archive(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write every row of pages(page_id, url, html) and return the manifest.

    A null html is an empty payload. Of equal payloads of MIN_REVISIT bytes or more the row with the largest
    page_id is the response; repeated rows of that page_id are responses too. A null page_id is smaller than
    any other; if all are null, all rows are responses. Other columns are ignored; an empty table makes an
    empty manifest.
    """
    path = path or S.scratch(spark, "warc")
    return write_archives(decide(pages), path, build_dictionary(sample_records(pages)))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM h
"""
