import hashlib

import duckdb
from pyarrow import fs as pafs

from lumenfold.llm import queries as Q
from lumenfold.llm import warc as W

PAGES = "page_id long, url string, html string, digest string"


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    with duckdb.connect() as c:
        c.sql(f"create view pages as select * from '{d}/pages.parquet'")
        want = sorted(c.sql(W.ORACLE).fetchall())
    assert sorted(map(tuple, Q.op4_warc(spark, d).collect())) == want


def test_round_trip_of_odd_pages(spark):
    big, other = "<p>größe</p>" * 100, "x" * 1500
    rows = [(1, "http://a/%0A b", big, "z"), (5, "http://b\r\nc", big, "z"), (3, None, big, "z"), (None, "http://n", big, "z"), (7, "u", None, "z"), (8, "", "", "z"), (9, "u", "small", "z"), (10, "u", "small", "z"), (11, "u", "\r\n\r\n" * 2 + other, "z"), (11, "u", other, "z"), (11, "u", other, "z"), (None, "m", other + "!", "z"), (None, "m", other + "!", "z"), (12, "long", "ab " * 1_000_000, "z")]
    pages = spark.createDataFrame(rows, PAGES)
    manifest = W.archive(spark, pages)
    got = W.read_archives(manifest).collect()
    assert manifest.groupBy().sum("records").first()[0] == len(rows) == len(got)
    assert sorted((str(r.page_id), str(r.url), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), str(u), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, u, h, _ in rows)
    kinds = sorted(((r.page_id or 0), r.record_type, r.refers_to) for r in got if r.payload_bytes == len(big.encode()))
    assert kinds == [(0, "revisit", 5), (1, "revisit", 5), (3, "revisit", 5), (5, "response", None)]
    assert all(r.record_type == "response" for r in got if r.payload_bytes != len(big.encode()))
    assert all(bytes(r.payload).decode() == next(h or "" for i, u, h, _ in rows if (i, u, len((h or "").encode())) == (r.page_id, r.url, r.payload_bytes)) for r in got if r.record_type == "response")


def test_archive_starts_with_the_dictionary_and_rolls_over(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    dictionary = W.build_dictionary(W.sample_records(pages))
    manifest = W.write_archives(W.decide(pages), W.S.scratch(spark, "t"), dictionary, archive_bytes=20_000).collect()
    assert len(manifest) > 2 and sum(r.records for r in manifest) == pages.count()
    store, name = pafs.FileSystem.from_uri(manifest[0].path)
    raw = store.open_input_stream(name).read()
    assert raw.startswith(W.dictionary_frame(dictionary)) and len(dictionary) > 1000


def test_empty_table(spark):
    pages = spark.createDataFrame([], PAGES)
    manifest = W.archive(spark, pages)
    assert manifest.count() == 0 and W.read_archives(manifest).collect() == []


def test_dictionary_of_long_pages_and_same_bytes_again(spark):
    pages = spark.createDataFrame([(k, "u", f"<p>{k} " + "some words of a long page " * 4000, "z") for k in range(12)] + [(None, "u", "no id", "z")], PAGES)
    samples = W.sample_records(pages)
    assert len(samples) == 13 and max(map(len, samples)) == W.SAMPLE_LONGEST and W.build_dictionary(samples)
    assert W.record_bytes(None, "u", "d", 1, None, b"x") == W.record_bytes(None, "u", "d", 1, None, b"x") != W.record_bytes(None, "v", "d", 1, None, b"x")
