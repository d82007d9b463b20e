"""Running a stream over all that it has now, with its results by batch in a table."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: A time after all others: a row with it moves the watermark past every other row, so that nothing waits for more.
END_OF_TIME = "2200-01-01 00:00:00"


@contextmanager
def state_in_files(spark: SparkSession):
    """The state store that keeps timers and maps, while a stream runs."""
    before = spark.conf.get(_STATE_STORE, None)
    spark.conf.set(_STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STATE_STORE, before) if before else spark.conf.unset(_STATE_STORE)


def run_available(rows: DataFrame, root: str, mode: str = "append") -> DataFrame:
    """(rows' columns, batch): what a streaming frame has given so far, in this run and in earlier ones with the same `root`.

    The log and the checkpoint are folders below root; a batch that runs again replaces its own part of the log.
    """
    spark = rows.sparkSession
    schema = rows.schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/log/batch=-1")

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/log/batch={number}")

    with state_in_files(spark):
        rows.writeStream.outputMode(mode).foreachBatch(append).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).option("basePath", f"{root}/log").parquet(f"{root}/log")


def closed(rows: DataFrame, time: str, end: DataFrame, **values) -> DataFrame:
    """A stream and, from the stream `end` of one row, a row that has END_OF_TIME as its time, `values` and nulls elsewhere.

    Keys of a join need a value, one that no other row has: rows with null keys are filtered out before the watermark.
    """
    filled = {time: F.to_timestamp(F.lit(END_OF_TIME)), **{c: F.lit(v) for c, v in values.items()}}
    last = end.select(*[filled.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in rows.schema])
    return rows.unionByName(last)
