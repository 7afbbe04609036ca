"""Streams with keyed state in the order of time: late rows, a restart, and the batch form over the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spreadlake.operators.simulate import hysteresis
from spreadlake.streaming import ordered, runs

AT = dt.datetime(2024, 1, 1)
SCHEMA = "lead string, lag string, at timestamp, id long, z double"


def arrive(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{number}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def scores(n, seed):
    rng = random.Random(seed)
    pairs = [("a", "b"), ("b", "a"), ("c", "d")]
    rows = [(*rng.choice(pairs), AT + dt.timedelta(minutes=rng.randint(0, 4000)), i, rng.choice((None, float("nan"), *(rng.gauss(0, 1.5) for _ in range(6))))) for i in range(n)]
    return sorted(rows, key=lambda r: r[2])


def test_hysteresis_with_late_rows_and_a_restart(spark, tmp_path):
    rows = scores(300, 1)
    rng = random.Random(2)
    # Within a batch rows come in any order, and some come up to two hours late, in the next batch.
    parts = [rows[:100], rows[100:200], rows[200:]]
    for k in (0, 1):
        end = max(r[2] for r in parts[k])
        late = [r for r in parts[k] if r[2] > end - dt.timedelta(minutes=100) and rng.random() < 0.5]
        parts[k] = [r for r in parts[k] if r not in late]
        parts[k + 1] = parts[k + 1] + late
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"
    for k, part in enumerate(parts):  # a run for each, which goes on from the one before
        rng.shuffle(part)
        arrive(spark, f"{tmp_path}/in", k, part)
        got = runs.to_folder(ordered.hysteresis_stream(stream(spark, f"{tmp_path}/in"), ["lead", "lag"], "at", "id", "z", 1.5, 0.5, late="2 hours", slot_ms=600_000), out, ck)
    much_later = [("x", "y", AT + dt.timedelta(days=30), 9000, 0.0)]
    arrive(spark, f"{tmp_path}/in", 3, much_later)
    too_late = [("a", "b", AT + dt.timedelta(minutes=5), 9001, -9.0)]
    arrive(spark, f"{tmp_path}/in", 4, too_late)
    for _ in range(2):  # the second run finds nothing new
        got = runs.to_folder(ordered.hysteresis_stream(stream(spark, f"{tmp_path}/in"), ["lead", "lag"], "at", "id", "z", 1.5, 0.5, late="2 hours", slot_ms=600_000), out, ck)
    w = W.partitionBy("lead", "lag").orderBy("at", "id")
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("sig", hysteresis(F.col("z"), F.lit(1.5), F.lit(0.5), w))
    have = sorted((r["id"], r["sig"]) for r in got.collect())
    assert have == sorted((r["id"], r["sig"]) for r in batch.collect())
    assert {s for _, s in have} == {0, 1}


def cooled(rows, days):
    last, out = {}, {}
    for a, b, at, i, _ in sorted(rows, key=lambda r: (r[2], r[3])):
        key = tuple(sorted((a, b)))
        out[i] = int(key not in last or at - last[key] >= dt.timedelta(days=days))
        if out[i]:
            last[key] = at
    return out


def test_cooldown(spark, tmp_path):
    rng = random.Random(4)
    pairs = [("a", "b"), ("b", "a"), ("c", "d")]
    rows = sorted(((*rng.choice(pairs), AT + dt.timedelta(hours=rng.randint(0, 1500)), i, None) for i in range(120)), key=lambda r: r[2])
    rows += [("q", "r", AT + dt.timedelta(days=1), 500, None), ("q", "r", AT + dt.timedelta(days=3), 501, None), ("r", "q", AT + dt.timedelta(days=4), 502, None)]  # exactly two days later, and one
    for k, part in enumerate((rows[:40] + rows[120:], rows[40:80], rows[80:120], [("x", "y", AT + dt.timedelta(days=200), 900, None)])):
        arrive(spark, f"{tmp_path}/in", k, part)
        got = runs.to_folder(ordered.cooldown_stream(stream(spark, f"{tmp_path}/in"), "at", "id", 2, late="1 hour", slot_ms=3_600_000), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert {r["id"]: r["evaluated"] for r in got.collect()} == cooled(rows, 2)


def test_rows_without_a_time(spark, tmp_path):
    arrive(spark, f"{tmp_path}/in", 0, [("a", "b", None, 1, -2.0), ("a", None, AT, 2, -2.0), ("a", None, AT, 3, -1.0), ("z", "z", AT + dt.timedelta(days=9), 4, None)])
    got = runs.to_folder(ordered.hysteresis_stream(stream(spark, f"{tmp_path}/in"), ["lead", "lag"], "at", "id", "z", 1.5, 0.5), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert sorted((r["id"], r["sig"]) for r in got.collect()) == [(2, 1), (3, 1)]


@pytest.mark.parametrize("key", ["spark.sql.streaming.stateStore.providerClass"])
def test_session_stays_as_it_was(spark, key):
    before = spark.conf.get(key)
    with runs.state_store(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key) == before
