"""Sections of manifests: odd lines, files side by side, and long files."""

import time

from lumenfold.operators import audits

SCHEMA = "rel string, text string"


def _entries(spark, *texts):
    rows = audits.section_entries(spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], SCHEMA).coalesce(1)).collect()
    return sorted((r.rel, r.line_no, r.section, r.key, r.value) for r in rows)


def test_odd_lines(spark):
    text = '﻿x = 0\na=1\r\n [[ t.u ]] \r\n"q.r" = v = w \t\n[]\nb =\n[c] # no head\nd e = 1\n = 2\n[g] \nk = é \nk = a b\n[h]'
    assert _entries(spark, text) == [("f0", 2, "", "a", "1"), ("f0", 4, "t.u", '"q.r"', "v = w"), ("f0", 6, "t.u", "b", ""), ("f0", 11, "g", "k", "é")]


def test_a_section_ends_with_its_file(spark):
    got = _entries(spark, "a = 1", "[s]\nb = 2\n[t]", "c = 3\n[u]\nd = 4", None, "", "\n", "e = 5")
    assert got == [("f0", 1, "", "a", "1"), ("f1", 2, "s", "b", "2"), ("f2", 1, "", "c", "3"), ("f2", 3, "u", "d", "4"), ("f6", 1, "", "e", "5")]


def test_blocks_of_texts_and_batches_of_entries(spark, monkeypatch):
    texts = [f"[s{k}]\n" + "\n".join(f"k{i} = {k}" for i in range(k % 5)) for k in range(40)]
    batch = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "rel long, text string").toArrow().to_batches()
    monkeypatch.setattr(audits, "BLOCK", 50)
    monkeypatch.setattr(audits, "ENTRIES", 3)
    got = [tuple(r.values()) for out in audits._sections(iter(batch)) for r in out.to_pylist()]
    assert got == [(k, i + 2, f"s{k}", f"k{i}", str(k)) for k in range(40) for i in range(k % 5)]


def test_a_long_manifest_takes_no_square_of_its_lines(spark):
    n = 30_000
    files = spark.createDataFrame([("f", "[s]\n" + "\n".join(f"k{i} = {i}" for i in range(n)))], SCHEMA)
    began = time.perf_counter()
    got = audits.section_entries(files).agg({"line_no": "sum", "section": "min", "key": "count"}).first()
    assert time.perf_counter() - began < 30
    assert (got["sum(line_no)"], got["min(section)"], got["count(key)"]) == (n * (n + 3) // 2, "s", n)
