"""Streams of filing events: the first row of a key, weekly counts, upserts by batch."""

import datetime as dt

import pytest

from spreadlake.sources.versioned import VersionedTable
from spreadlake.streaming import filings

SCHEMA = "symbol string, accession long, filed_at timestamp, items string"
AT = dt.datetime(2024, 1, 1, 12)
ROWS = [("a", 1, AT, "x"), ("a", 1, AT, "again"), ("a", 2, AT + dt.timedelta(days=6), "y"), ("b", 3, AT + dt.timedelta(days=8), "z")]


@pytest.fixture
def stream(spark, tmp_path):
    for i, rows in enumerate((ROWS[:2], ROWS[2:], [("b", 3, AT + dt.timedelta(days=8), "late copy"), ("c", 4, AT + dt.timedelta(days=60), "far")])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def drained(df, tmp_path, mode):
    q = df.writeStream.format("parquet" if mode == "append" else "memory").queryName("t").option("checkpointLocation", f"{tmp_path}/ck").outputMode(mode).trigger(availableNow=True)
    (q.start(f"{tmp_path}/out") if mode == "append" else q.start()).awaitTermination()


def test_insert_ignore(spark, stream, tmp_path):
    drained(filings.insert_ignore_stream(stream, ["accession"]), tmp_path, "append")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r["accession"] for r in got) == [1, 2, 3, 4]


def test_weekly_counts(spark, stream, tmp_path):
    drained(filings.weekly_counts(stream), tmp_path, "append")
    got = {(str(r["week"]), r["symbol"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("2024-01-01", "a"): 3, ("2024-01-08", "b"): 2}  # the last week is still open


def test_upsert(spark, stream, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/table", spark.createDataFrame([], SCHEMA).schema, "filed_at")
    filings.upsert_stream(stream, table, ["accession"], f"{tmp_path}/ck").awaitTermination()
    got = {r["accession"]: r["items"] for r in table.read().collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == "y" and got[4] == "far"
