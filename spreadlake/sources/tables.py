"""Scans and table changes; a changed table is a new DataFrame, for the caller to write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folders import Files, shared_folder


def price_scan(prices: DataFrame, symbols: list[str], start: str, end: str) -> DataFrame:
    """Rows of the symbols with start <= day <= end, in order. Over a stored table both filters reach the scan, and files of other days are skipped."""
    return prices.where(F.col("symbol").isin(symbols) & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("day", "symbol")


def wide(prices: DataFrame, symbols: list[str]) -> DataFrame:
    """A row per day, a column per symbol; the symbols are named, so no pass is needed to find them."""
    return prices.groupBy("day").pivot("symbol", symbols).agg(F.first("close"))


def tradeable_assets(assets: DataFrame, exchanges=("NYSE", "NASDAQ")) -> DataFrame:
    return assets.where(F.col("exchange").isin(*exchanges) & ~F.col("symbol").contains(".") & ~F.upper(F.coalesce("name", F.lit(""))).contains("ETF"))


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def merge_fresh(cached: DataFrame, fresh: DataFrame, keys: list[str], tie: str | None = None) -> DataFrame:
    """Union by key, fresh rows first: a cell of the cache stays where nothing fresh has its key."""
    both = cached.withColumn("__p", F.lit(1)).unionByName(fresh.withColumn("__p", F.lit(0)))
    return latest(both, keys, "__p", *([tie] if tie else [])).drop("__p")


def coverage_gaps(prices: DataFrame, wanted: DataFrame, start: str, end: str, days: int = 2) -> DataFrame:
    """Wanted symbols that are absent, or miss either end of the span by more than so many days."""
    held = prices.groupBy("symbol").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    low, high = F.date_add(F.lit(start).cast("date"), days), F.date_sub(F.lit(end).cast("date"), days)
    return wanted.join(held, "symbol", "left").where(F.col("lo").isNull() | (F.col("lo") > low) | (F.col("hi") < high)).select("symbol")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def update_else_insert(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """old with the columns taken from new where it has the key, and new's other rows whole."""
    fresh = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    changed = old.join(fresh, keys, "left")
    kept = changed.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])
    return kept.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def insert_or_get_id(old: DataFrame, new: DataFrame, keys: list[str], scope: str | None = None, id_: str = "id") -> DataFrame:
    """new with the id of its key: old's where it has the key, else the next free one, in the order of the keys; rows of one key share it.

    scope: of the keys, the one whose rows are unique only where it isn't null: each row without it gets an id of its own, after the others, and
    never an old one.  Other nulls in keys are values like any other.  Ids are counted within ranges of keys, whose sizes give the offsets.
    """
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__{k}")) for k in keys]
    held = old.groupBy(*keys).agg(F.min(id_).alias("__old")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__old")
    last = old.agg(F.coalesce(F.max(id_), F.lit(0)).cast("long").alias("__last"))
    lone = F.col(f"`{scope}`").isNull() if scope else F.lit(False)
    known = new.join(held, same, "left").withColumn("__old", F.when(~lone, F.col("__old"))).drop(*[f"__{k}" for k in keys])
    missing = known.where(F.col("__old").isNull())
    named = missing.where(~lone).select(*keys).distinct()
    ranges = counted(named.select(*keys, F.lit(0).alias("__lone")), keys)
    found = known.where(~lone).join(ranges.drop("__lone").select(*[F.col(k).alias(f"__{k}") for k in keys], "__n"), same, "left").drop(*[f"__{k}" for k in keys])
    out = found.crossJoin(last).withColumn(id_, F.coalesce("__old", F.col("__n") + F.col("__last"))).drop("__old", "__n", "__last")  # one row
    if not scope:
        return out
    free = named.count()
    alone = counted(new.where(lone), [c for c in new.columns if c != scope]).crossJoin(last)
    return out.unionByName(alone.withColumn(id_, F.col("__n") + F.col("__last") + free).drop("__n", "__last"))


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows, written in order over ranges of it, with __id, the number of a row's range, and __at, which ascends in the order."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    by = [F.col(f"`{c}`") for c in order]
    df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__at", T.LongType())])).parquet(folder)
    return rows.withColumn("__id", F.shiftright("__at", 33))


def counted(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows, written, with __n, the row's number from 1 in the order: the sizes of the ranges before its own are added."""
    rows = ranged(df, order)
    sizes = rows.groupBy("__id").agg(F.count("*").alias("__k"), F.min("__at").alias("__first"))  # a row for each range
    before = W.orderBy("__id").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__id", "__first", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__off"))
    return rows.join(offsets, "__id").withColumn("__n", F.col("__at") - F.col("__first") + F.col("__off") + 1).drop("__at", "__id", "__first", "__off")


def span_of_last(as_of: str, days: int) -> tuple[Column, Column]:
    """First and last day of the last ``days`` days."""
    end = F.lit(as_of).cast("date")
    return F.date_sub(end, days), end


def warm(cache: DataFrame, source: DataFrame, symbols: DataFrame, as_of: str, days: int = 126) -> DataFrame:
    """The cache with all of the source's rows of the symbols in the last days; no symbols: as it was."""
    low, high = span_of_last(as_of, days)
    fresh = source.where(F.col("day").between(low, high)).join(symbols.select("symbol"), "symbol", "left_semi")
    return upsert(cache, fresh.select(*cache.columns), ["symbol", "day"])


def batches(symbols: DataFrame, size: int = 500) -> DataFrame:
    """symbol, batch: numbered in order. The universe is a few thousand rows."""
    return symbols.select("symbol").distinct().withColumn("batch", F.floor((F.row_number().over(W.orderBy("symbol")) - 1) / size).cast("int"))


def prewarm(cache: DataFrame, source: DataFrame, symbols: DataFrame, start: str, end: str, buffer_days: int = 150) -> DataFrame:
    """The cache with the source's rows of all symbols from so many days before the window to its end; what is absent is not marked as failed."""
    low, high = F.date_sub(F.lit(start).cast("date"), buffer_days), F.lit(end).cast("date")
    fresh = source.where(F.col("day").between(low, high)).join(symbols.select("symbol"), "symbol", "left_semi")
    return upsert(cache, fresh.select(*cache.columns), ["symbol", "day"])


def still_to_do(wanted: DataFrame, done: DataFrame, key: str = "symbol") -> DataFrame:
    return wanted.select(key).distinct().join(done.select(key), key, "left_anti")


def resume_csv(spark: SparkSession, folder: str, wanted: DataFrame, fetch, schema: str, key: str = "symbol") -> DataFrame:
    """A CSV cache that goes on where it stopped: fetches the keys that it lacks and appends; a key without an answer gets an empty row, so it is not asked again."""
    have = spark.read.schema(schema).option("header", True).csv(folder) if Files(spark, folder).names(folder) else spark.createDataFrame([], schema)
    todo = still_to_do(wanted, have, key)
    todo.join(fetch(todo), key, "left").select(*have.columns).write.mode("append").option("header", True).csv(folder)
    return spark.read.schema(schema).option("header", True).csv(folder)


def load_metadata(known: DataFrame, wanted: DataFrame, ciks: DataFrame, codes: DataFrame) -> DataFrame:
    """symbol, sector, is_etf, source of all wanted symbols: the table's row, else the sector of the company's industry code, else an empty placeholder.

    known: symbol, sector, is_etf. ciks: ticker, cik, the first of a ticker counts. codes: cik, sic.
    """
    from ..functions import scalar as S

    stored = known.join(wanted, "symbol", "left_semi").select("symbol", "sector", "is_etf", F.lit("stored").alias("source"))
    missing = still_to_do(wanted, known)
    first = ciks.groupBy(F.upper("ticker").alias("t")).agg(F.min("cik").alias("cik"))
    found = missing.withColumn("t", F.upper("symbol")).join(first, "t", "left").join(codes, "cik", "left")
    source = F.when(F.col("cik").isNull(), "none").otherwise("industry code")
    return stored.unionByName(found.select("symbol", S.sic_sector(F.col("sic").cast("string")).alias("sector"), F.lit(False).alias("is_etf"), source.alias("source")))


def orders_to_send(orders: DataFrame, mode: str) -> DataFrame:
    """Market orders for the day as rows for a sink: symbol, qty, side, type, time_in_force. A backtest sends none: its simulation fills them."""
    sent = orders.select("symbol", "qty", F.lower("side").alias("side"), F.lit("market").alias("type"), F.lit("day").alias("time_in_force"))
    return sent.where(F.lit(mode != "backtest"))


def fetch_with_retry(fetch, *args, tries: int = 3, wait: float = 15.0, sleep=None):
    """fetch(*args), tried again after waits that double; the last error is raised."""
    import time

    for k in range(tries):
        try:
            return fetch(*args)
        except Exception:
            if k == tries - 1:
                raise
            (sleep or time.sleep)(wait * 2**k)
    return None


def retry_waits(tries: int = 3, wait: float = 15.0) -> list[float]:
    """The waits between tries of ``fetch_with_retry``."""
    return [wait * 2**k for k in range(tries - 1)]


def batch_outcome(answers: DataFrame, least: int = 50) -> DataFrame:
    """batch, asked, got, status of rows (batch, symbol, answered): an outage where a large batch got nothing at all."""
    x = answers.groupBy("batch").agg(F.count("*").alias("asked"), F.count_if("answered").alias("got"))
    return x.withColumn("status", F.when((F.col("asked") >= least) & (F.col("got") == 0), "outage").when(F.col("got") < F.col("asked"), "partial").otherwise("ok"))


def guard_mass_failure(asked: int, got: int, least: int = 50) -> None:
    """A large batch without any answer is an outage, not absent symbols."""
    if asked >= least and got == 0:
        raise RuntimeError(f"none of {asked} symbols was answered")
