"""Runs of a stream over what has arrived: every row is read, then the stream stops."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def state_store(spark: SparkSession):
    """Keyed state with timers needs a store that can list keys by prefix; a query keeps the store that it was started with."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def to_folder(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Appends what the stream yields of all that has arrived to Parquet files and reads these; a run after a failure goes on from the checkpoint and adds nothing twice."""
    spark = stream.sparkSession
    with state_store(spark):
        q = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)
