"""Tables with versions, caches that resume, and guards of fetches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spreadlake.sources import tables, versioned

DAYS = [("a", "2020-01-05", 1.0), ("b", "2020-01-06", 2.0), ("a", "2020-02-03", 3.0), ("a", "2022-03-01", 4.0)]


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame(DAYS, "symbol string, d string, close double").select("symbol", F.to_date("d").alias("day"), "close")
    t = versioned.VersionedTable(spark, f"{tmp_path}/prices", df.schema, "day")
    t.append(df)
    return t, df


def rows(df):
    return sorted((r["symbol"], str(r["day"]), r["close"]) for r in df.collect())


def test_append_and_restore(table):
    t, df = table
    before = t.snapshot()
    t.append(df.limit(1))
    t.delete(F.col("symbol") == "b")
    assert t.read().count() == 4 and t.read(before).count() == 4 and t.read(before + 1).count() == 5
    t.restore(before)
    assert rows(t.read()) == sorted(DAYS)
    with pytest.raises(ValueError, match="unknown columns"):
        t.append(df.withColumn("other", F.lit(1)))


def test_upsert_rewrites_its_months_only(table):
    t, df = table
    _, (old,), _ = t._list()
    t.upsert(df.where("close = 3").withColumn("close", F.lit(30.0)), ["symbol", "day"])
    _, parts, _ = t._list()
    assert parts[0]["folder"] == old["folder"] and parts[0]["months"] == ["2020-01", "2022-03"] and parts[1]["months"] == ["2020-02"]
    t.insert_ignore(df.withColumn("close", F.lit(-1.0)), ["symbol", "day"])
    assert rows(t.read()) == [("a", "2020-01-05", 1.0), ("a", "2020-02-03", 30.0), ("a", "2022-03-01", 4.0), ("b", "2020-01-06", 2.0)]


def test_update_else_insert(table):
    t, df = table
    new = df.where("symbol = 'b'").withColumn("close", F.lit(9.0)).unionByName(df.limit(1).withColumn("symbol", F.lit("z")))
    t.update_else_insert(new, ["symbol", "day"], ["close"])
    assert ("b", "2020-01-06", 9.0) in rows(t.read()) and t.read().count() == 5


def test_columns_retention_compaction(table):
    t, df = table
    v = t.add_columns({"volume": "bigint"})
    assert t.add_columns({"volume": "bigint"}) == v and t.read().where("volume is null").count() == 4
    t.compact("2022-03-31", 90, ["symbol", "day"])
    assert t.read().count() == 4
    t.retain("2022-02-20", 730)
    assert [r[1] for r in rows(t.read())] == ["2020-02-03", "2022-03-01"]
    t.vacuum()
    assert len(t.versions()) == 1 and t.read().count() == 2
    found = {r["rule"]: r["n"] for r in versioned.violations(df, {"dear": F.col("close") > 2, "volume": F.lit(None).cast("boolean")}).collect()}
    assert found == {"dear": 2, "volume": 0}


def test_second_writer_of_a_version_fails(table):
    t, _ = table
    version, parts, schema = t._list()
    t._commit(version + 1, parts, schema)
    with pytest.raises(Exception, match="already exists"):
        t._commit(version + 1, parts, schema)


def test_csv_cache_asks_for_what_it_lacks(spark, tmp_path):
    asked = []

    def fetch(todo):
        names = sorted(r["symbol"] for r in todo.collect())
        asked.append(names)
        return spark.createDataFrame([(n, 1) for n in names if n != "none"], "symbol string, n int")

    want = lambda *n: spark.createDataFrame([(x,) for x in n], "symbol string")
    for symbols in (("a", "none"), ("a", "b", "none"), ("a", "b")):
        got = tables.resume_csv(spark, f"{tmp_path}/cache", want(*symbols), fetch, "symbol string, n int")
    assert asked == [["a", "none"], ["b"], []] and sorted((r["symbol"], r["n"]) for r in got.collect()) == [("a", 1), ("b", 1), ("none", None)]


def test_retry_and_outage():
    waits, calls = [], []

    def fetch(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("away")
        return x

    assert tables.fetch_with_retry(fetch, 5, sleep=waits.append) == 5 and waits == tables.retry_waits() == [15.0, 30.0]
    with pytest.raises(OSError):
        tables.fetch_with_retry(lambda: 1 / 0 if False else (_ for _ in ()).throw(OSError("down")), sleep=waits.append)
    tables.guard_mass_failure(49, 0), tables.guard_mass_failure(500, 1)
    with pytest.raises(RuntimeError):
        tables.guard_mass_failure(50, 0)


def test_stored_view_is_written_anew_when_gone(spark, tmp_path):
    from spreadlake import adapters
    from spreadlake.sources.folders import Files

    spark.createDataFrame([(1, dt.datetime(2020, 1, 7), 10.0, 2.0)], "l_partkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "b")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    t = adapters.Tables(spark, str(tmp_path))
    first = t.prices
    assert [tuple(r) for r in first.collect()] == [("b", dt.date(2020, 1, 6), 5.0, 2)] and t.prices.inputFiles() == first.inputFiles()
    folder = next(v for k, v in adapters._written.items() if k[1] == str(tmp_path))
    Files(spark, folder).delete(folder)
    assert t.prices.count() == 1 and t.prices.inputFiles() != first.inputFiles()
