"""The store of versions: whole writes, undisturbed readers, conflicts and cleaning up."""

import os

import pytest
from pyspark.sql import functions as F

from lumenfold.sources import versioned as V

RUN = "run_id string, started long, status string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names]


def test_versions_and_readers(spark, tmp_path):
    path = f"{tmp_path}/s"
    assert V.versions(path) == []
    first = [(f"r{i}", i, "ok") for i in range(50)]
    assert V.publish(spark.createDataFrame(first, RUN).repartition(5), path) == 1
    old = V.read(spark, path)
    assert V.upsert(spark.createDataFrame([("r1", 99, "failed"), ("new", 5, None), ("r2", 1, "too old"), ("r3", 3, "tie")], RUN), path, ["run_id"], "started") == 2
    want = {r[0]: r for r in first} | {"r1": ("r1", 99, "failed"), "new": ("new", 5, None), "r3": ("r3", 3, "tie")}
    assert rows(V.read(spark, path)) == sorted(want.values())
    assert rows(old) == rows(V.read(spark, path, 1)) == sorted(first)
    assert V.versions(path) == [1, 2]


def test_a_failed_write_leaves_no_version_and_no_files(spark, tmp_path):
    path = f"{tmp_path}/s"
    V.publish(spark.createDataFrame([("a", 1, "ok")], RUN), path)
    before = files(path)
    broken = spark.range(1000, numPartitions=4).select(F.col("id").cast("string").alias("run_id"), F.when(F.col("id") == 999, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("started"), F.lit("x").alias("status"))
    with pytest.raises(Exception, match="stop"):
        V.publish(broken, path)
    assert V.versions(path) == [1] and files(path) == before and rows(V.read(spark, path)) == [("a", 1, "ok")]


def test_two_writers_on_one_version(spark, tmp_path):
    path = f"{tmp_path}/s"
    one = spark.createDataFrame([("a", 1, "ok")], RUN)
    V.publish(one, path)
    V.publish(one, path, base=1)
    before = files(path)
    with pytest.raises(V.Conflict):
        V.publish(spark.createDataFrame([("b", 1, "ok")], RUN), path, base=1)
    assert V.versions(path) == [1, 2] and files(path) == before


def test_empty_tables_null_keys_and_vacuum(spark, tmp_path):
    path = f"{tmp_path}/s"
    assert V.publish(spark.createDataFrame([], RUN), path) == 1 and rows(V.read(spark, path)) == []
    V.upsert(spark.createDataFrame([(None, 1, "x"), (None, 2, "y"), ("a", None, "z")], RUN), path, ["run_id"], "started")
    assert sorted(map(str, rows(V.read(spark, path).fillna("-")))) == ["('-', 2, 'y')", "('a', None, 'z')"]
    V.upsert(spark.createDataFrame([("b", 1, "x")], RUN), path, ["run_id"], "started")
    newest = {tuple(map(str, r)) for r in V.read(spark, path).collect()}
    gone = V.vacuum(path, keep=1)
    assert gone and V.versions(path) == [3] and {tuple(map(str, r)) for r in V.read(spark, path).collect()} == newest
    assert len(files(path)) > 0 and V.vacuum(path, keep=1) == []
    V.vacuum(path, keep=0)
    assert V.versions(path) == [] and files(path) == []
