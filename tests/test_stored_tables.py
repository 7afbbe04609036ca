"""Stored tables that streams, sources and folds change: exactly once, across months, and no more than is needed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spreadlake.operators.intervals import merged_windows, overlap_join, uncovered
from spreadlake.sources import bars, tables
from spreadlake.sources.folds import FoldCache
from spreadlake.sources.versioned import VersionedTable
from spreadlake.streaming import filings

SCHEMA = "symbol string, accession long, filed_at timestamp, items string"
AT = dt.datetime(2024, 1, 5, 12)


def day(n):
    return AT + dt.timedelta(days=n)


def table(spark, folder, schema=SCHEMA, on="filed_at"):
    return VersionedTable(spark, str(folder), spark.createDataFrame([], schema).schema, on)


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_upsert_across_months(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.append(spark.createDataFrame([("a", 1, day(0), "jan"), ("b", 2, day(0), "jan"), ("c", 3, day(70), "mar")], SCHEMA))
    before = {p["folder"]: p["months"] for p in t._list()[1]}
    t.upsert(spark.createDataFrame([("a", 1, day(30), "feb")], SCHEMA), ["accession"])
    assert rows_of(t.read(), "accession", "items") == [(1, "feb"), (2, "jan"), (3, "mar")]
    assert any(p["folder"] in before and p["months"] == ["2024-03"] for p in t._list()[1])  # March was not written anew
    t.insert_ignore(spark.createDataFrame([("b", 2, day(31), "late"), ("d", 4, day(31), "new")], SCHEMA), ["accession"])
    assert rows_of(t.read(), "accession", "items") == [(1, "feb"), (2, "jan"), (3, "mar"), (4, "new")]
    t.update_else_insert(spark.createDataFrame([("c", 3, day(0), "moved")], SCHEMA), ["accession"], ["items"])
    assert rows_of(t.read(), "accession", "items") == [(1, "feb"), (2, "jan"), (3, "moved"), (4, "new")]


def test_a_batch_counts_once(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    new = spark.createDataFrame([("a", 1, day(0), "x"), ("a", 1, day(1), "later"), ("b", 2, day(2), "y")], SCHEMA)
    v = t.upsert(new, ["accession"], ("s", 0), latest="filed_at")
    assert t.upsert(new, ["accession"], ("s", 0), latest="filed_at") == v == t.versions()[-1]
    assert t.append(new, ("s", 0)) == v and t.append(new, ("other", 0)) == v + 1
    assert t.holds(("s", 0)) and not t.holds(("s", 1))
    t.delete(F.col("items") == "y")
    assert t.holds(("s", 0)) and t.holds(("other", 0))  # other changes keep the batches
    older = spark.createDataFrame([("a", 1, day(-3), "older")], SCHEMA)
    t2 = table(spark, tmp_path / "t2")
    t2.upsert(new, ["accession"], ("s", 0), latest="filed_at")
    t2.upsert(older, ["accession"], ("s", 1), latest="filed_at")
    assert rows_of(t2.read(), "accession", "items") == [(1, "later"), (2, "y")]


@pytest.mark.parametrize("fails", ["before the commit", "after the commit"])
def test_stream_that_fails_adds_nothing_twice(spark, tmp_path, monkeypatch, fails):
    parts = ([("a", 1, day(0), "x"), ("b", 2, day(1), "y")], [("a", 1, day(3), "z"), ("c", 3, day(40), "w")], [("b", 2, day(45), "v")])
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    t = table(spark, tmp_path / "t")
    commit, calls = VersionedTable._commit, []

    def failing(self, version, parts, schema, batch=None):
        if batch == ("upsert", 1) and not calls:
            calls.append(1)
            if fails == "after the commit":
                commit(self, version, parts, schema, batch)
            raise RuntimeError("lost")
        return commit(self, version, parts, schema, batch)

    monkeypatch.setattr(VersionedTable, "_commit", failing)
    with pytest.raises(Exception, match="lost"):
        filings.upsert_stream(events, t, ["accession"], f"{tmp_path}/ck").awaitTermination()
    filings.upsert_stream(events, t, ["accession"], f"{tmp_path}/ck").awaitTermination()
    assert calls and rows_of(t.read(), "accession", "items") == [(1, "z"), (2, "v"), (3, "w")]
    assert len(t.versions()) == 4  # the empty table, and one for each batch
    t3 = table(spark, tmp_path / "t3")
    filings.insert_ignore_into(events, t3, ["accession"], f"{tmp_path}/ck3").awaitTermination()
    assert rows_of(t3.read(), "accession", "items") == [(1, "x"), (2, "y"), (3, "w")]


@pytest.mark.parametrize("kind", ["date", "timestamp", "long"])
def test_overlap_join(spark, kind):
    rng = random.Random(7)
    make = {"date": lambda n: dt.date(1969, 12, 1) + dt.timedelta(days=n), "timestamp": lambda n: AT + dt.timedelta(microseconds=n * 1_234_567), "long": lambda n: n - 40}[kind]

    def some(n, longest):
        out = []
        for i in range(n):
            lo = rng.randint(0, 300)
            out.append((i, rng.choice("xyz"), make(lo), make(lo + rng.choice((0, 0, 1, 3, longest, -2)))))
        return out + [(900, "x", None, make(3)), (901, "x", make(3), None)]

    left, right = some(150, 60), some(150, 250)
    a = spark.createDataFrame(left, f"id long, k string, lo {kind}, hi {kind}")
    b = spark.createDataFrame(right, f"other long, k string, ws {kind}, we {kind}")
    meets = lambda p, q: None not in (*p[2:], *q[2:]) and p[2] <= p[3] and q[2] <= q[3] and q[2] <= p[3] and q[3] >= p[2]
    assert rows_of(overlap_join(a, b, ("lo", "hi"), ("ws", "we"), ["k"]), "id", "other") == sorted((p[0], q[0]) for p in left for q in right if p[1] == q[1] and meets(p, q))
    apart = overlap_join(a.drop("k"), b.drop("k"), ("lo", "hi"), ("ws", "we"))
    assert rows_of(apart, "id", "other") == sorted((p[0], q[0]) for p in left for q in right if meets(p, q))
    with pytest.raises(ValueError, match="k"):
        overlap_join(a, b, ("lo", "hi"), ("ws", "we"))


def test_overlap_makes_few_rows(spark):
    """Many long windows that meet nothing, and many short ones: no more rows than matches and logarithms of lengths."""
    n = 4000
    long_ = spark.range(n).select(F.col("id"), (F.col("id") * 3).alias("lo"), (F.col("id") * 3 + 100_000).alias("hi"))
    short = spark.range(n).select(F.col("id").alias("other"), (200_000 + F.col("id") * 2).alias("ws"), (200_000 + F.col("id") * 2).alias("we"))
    met = overlap_join(long_, short, ("lo", "hi"), ("ws", "we"))
    assert met.count() == 0
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()


def test_merged_and_uncovered(spark):
    rng = random.Random(9)
    d = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    spans = [(rng.choice("abc"), lo, lo + rng.randint(0, 12)) for lo in (rng.randint(0, 200) for _ in range(40))] + [("z", 500, 510), ("y", -60, -50)]
    held = spark.createDataFrame([(k, d(a), d(b)) for k, a, b in spans], "symbol string, low date, high date")
    covered = {k: {x for s, a, b in spans if s == k for x in range(a, b + 1)} for k in "abcyz"}
    got = {}
    for r in merged_windows(held, ["symbol"], "low", "high").collect():
        got.setdefault(r["symbol"], []).append((r["low"], r["high"]))
    for k, days in covered.items():
        assert {d(0) + dt.timedelta(days=x) for x in days} == {a + dt.timedelta(days=i) for a, b in got[k] for i in range((b - a).days + 1)}
        assert all(b < c - dt.timedelta(days=1) for (_, b), (c, _) in zip(sorted(got[k]), sorted(got[k])[1:], strict=False))
    wanted = spark.createDataFrame([(k, d(20), d(150)) for k in "abcnyz"], "symbol string, low date, high date")
    missing = {k: set() for k in "abcnyz"}
    for r in uncovered(wanted, held, ["symbol"]).collect():
        missing[r["symbol"]] |= {(r["low"] - d(0)).days + i for i in range((r["high"] - r["low"]).days + 1)}
    assert missing == {k: set(range(20, 151)) - covered.get(k, set()) for k in "abcnyz"}


def test_fold_cache(spark, tmp_path):
    rows = [(f"f{i % 4}", i, float(i)) for i in range(80)]
    schema = spark.createDataFrame([], "fold string, id long, x double").schema
    cache = FoldCache(spark, f"{tmp_path}/cache", schema)
    assert cache.read().count() == 0
    cache.write(spark.createDataFrame(rows, schema))
    files = {p for p in (tmp_path / "cache").rglob("*.parquet") if "fold=f1" not in str(p)}
    cache.write(spark.createDataFrame([("f1", 1000, 1.0), ("f9", 1001, 2.0)], schema))
    assert files <= set((tmp_path / "cache").rglob("*.parquet"))  # other folds' files stay
    assert rows_of(cache.read(), "fold", "id") == sorted([(f, i) for f, i, _ in rows if f != "f1"] + [("f1", 1000), ("f9", 1001)])
    assert cache.folds() == ["f0", "f1", "f2", "f3", "f9"]
    spark.createDataFrame([("f1", 10), ("f2", 1), ("f9", 30)], "fold string, worth long").write.parquet(f"{tmp_path}/worth")
    read = cache.read(spark.read.parquet(f"{tmp_path}/worth").where("worth >= 10"))
    assert rows_of(read, "id") == [(1000,), (1001,)]
    assert "dynamicpruning" in read._jdf.queryExecution().executedPlan().toString()


BARS = "symbol string, day date, close double, volume bigint"


@pytest.fixture
def vendor(spark, tmp_path):
    day0 = dt.date(2024, 1, 1)
    rows = [(s, day0 + dt.timedelta(days=i), 100.0 + i, i) for s in ("A", "B", "C") for i in range(0, 60)]
    spark.createDataFrame(rows, BARS).repartition(3).write.parquet(f"{tmp_path}/vendor")
    return f"file://{tmp_path}/vendor", rows


def test_bar_source_plans_and_pushes(spark, vendor):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    store, rows = vendor
    got = bars.bars(spark, ["A", "C", "NONE"], "2024-01-10", "2024-02-05", store=store, batch=1, days=10)
    want = sorted((s, d, v) for s, d, _, v in rows if s in "AC" and dt.date(2024, 1, 10) <= d <= dt.date(2024, 2, 5))
    assert rows_of(got, "symbol", "day", "volume") == want and got.rdd.getNumPartitions() == 9
    assert bars.bars(spark, None, "2024-01-10", "2024-01-11", store=store).count() == 6
    reader = bars.BarReader({"store": store, "batch": "2", "days": "30"})
    assert list(reader.pushFilters([In(("symbol",), ("A", "B", "C")), GreaterThan(("day",), dt.date(2024, 1, 4)), LessThanOrEqual(("day",), dt.date(2024, 3, 1)), EqualTo(("volume",), 3)])) == [EqualTo(("volume",), 3)]
    plan = [(p.symbols, p.low, p.high) for p in reader.partitions()]
    assert [p[0] for p in plan] == [["A", "B"], ["C"]] * 2 and plan[0][1] == dt.date(2024, 1, 5) and plan[-1][2] == dt.date(2024, 3, 1)
    assert plan[2][1] == plan[0][2] + dt.timedelta(days=1)


def test_read_through(spark, tmp_path, vendor, monkeypatch):
    store, rows = vendor
    cache = bars.BarCache(spark, f"{tmp_path}/cache")
    wanted = spark.createDataFrame([("A",), ("C",), ("NONE",), ("A",)], "symbol string")
    asked, plain = [], bars.bars

    def counted(spark, symbols, low, high, **options):
        asked.append((symbols, low, high))
        return plain(spark, symbols, low, high, **options)

    monkeypatch.setattr(bars, "bars", counted)
    inside = lambda names, a, b: sorted((s, d) for s, d, *_ in rows if s in names and dt.date.fromisoformat(a) <= d <= dt.date.fromisoformat(b))
    got = cache.prices(wanted, "2024-01-05", "2024-01-20", store=store)
    assert rows_of(got, "symbol", "day") == inside("AC", "2024-01-05", "2024-01-20")
    assert asked == [(["A", "C", "NONE"], "2024-01-05", "2024-01-20")]
    versions = cache.bars.versions(), cache.asked.versions()
    assert rows_of(cache.prices(wanted, "2024-01-05", "2024-01-20", store=store), "symbol", "day") == inside("AC", "2024-01-05", "2024-01-20")
    assert len(asked) == 1 and versions == (cache.bars.versions(), cache.asked.versions())  # nothing was fetched
    cache.prices(wanted, "2024-01-15", "2024-02-10", store=store)  # the tail alone; NONE failed in an overlapping window
    cache.prices(spark.createDataFrame([("A",), ("B",)], "symbol string"), "2024-01-01", "2024-02-20", store=store)  # both ends, and one that is new
    assert asked[1:] == [(["A", "C"], "2024-01-21", "2024-02-10"), (["A"], "2024-01-01", "2024-01-04"), (["A"], "2024-02-11", "2024-02-20"), (["B"], "2024-01-01", "2024-02-20")]
    assert rows_of(cache.bars.read(), "symbol", "day") == sorted(inside("AB", "2024-01-01", "2024-02-20") + inside("C", "2024-01-05", "2024-02-10"))
    assert cache.prices(spark.createDataFrame([("B",)], "symbol string"), "2023-01-01", "2024-12-31", cache_only=True).count() == len(inside("B", "2024-01-01", "2024-02-20"))


def test_outage_and_lost_note(spark, tmp_path, vendor, monkeypatch):
    store, _ = vendor
    cache = bars.BarCache(spark, f"{tmp_path}/cache")
    none = spark.range(60).selectExpr("concat('N', id) as symbol")
    with pytest.raises(RuntimeError, match="60 symbols"):
        cache.prices(none, "2024-01-05", "2024-01-20", store=store)
    assert cache.asked.read().count() == 0
    one = spark.createDataFrame([("A",)], "symbol string")
    append = VersionedTable.append
    monkeypatch.setattr(VersionedTable, "append", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        cache.prices(one, "2024-01-05", "2024-01-20", store=store)
    monkeypatch.setattr(VersionedTable, "append", append)
    assert cache.prices(one, "2024-01-05", "2024-01-20", store=store).count() == 16  # fetched again, stored once
    assert cache.bars.read().count() == 16 and rows_of(cache.asked.read(), "symbol", "n") == [("A", 16)]


def test_insert_or_get_id(spark):
    old = spark.createDataFrame([("r", "a", 5), ("r", "b", 9), ("s", "a", 7)], "run string, pair string, id long")
    new = spark.createDataFrame([("r", "a", 1), ("r", "c", 2), ("r", "c", 3), ("q", "z", 4), (None, "a", 5), (None, "a", 6), ("r", None, 7), ("r", None, 8)], "run string, pair string, k long")
    got = dict(rows_of(tables.insert_or_get_id(old, new, ["run", "pair"], scope="run"), "k", "id"))
    assert got == {1: 5, 4: 10, 7: 11, 8: 11, 2: 12, 3: 12, 5: 13, 6: 14}
    empty = tables.insert_or_get_id(old.limit(0), new.where("run = 'r' and pair is not null"), ["run", "pair"])
    assert dict(rows_of(empty, "k", "id")) == {1: 1, 2: 2, 3: 2}
    many = spark.range(5000).selectExpr("cast(id % 1000 as string) as run", "cast(id as string) as pair")
    ids = sorted(r["id"] for r in tables.insert_or_get_id(old, many, ["run", "pair"], scope="run").collect())
    assert ids == list(range(10, 5010))
