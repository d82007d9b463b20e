"""Every registered query with SQL against that SQL, on the smallest tables."""

import duckdb
import pytest

from lumenfold.plans import catalog

TABLES = "nation customer supplier part orders lineitem events documents pages benchmark labels conversations region"
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    with duckdb.connect() as c:
        for t in TABLES.split():
            c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
        yield c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = sql.sql(catalog.ORACLES[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_entry_module_without_the_corpus_operators():
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'corpus_pipeline'", name="corpus_pipeline")
        return real(name, *args, **kwargs)

    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    builtins.__import__ = missing
    try:
        assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)
    finally:
        builtins.__import__ = real


def test_no_cartesian_product_in_the_path_join(spark):
    plan = catalog.path_overlap_join(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
