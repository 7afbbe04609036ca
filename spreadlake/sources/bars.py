"""Daily bars from a source outside of Spark, and a stored cache that reads through to it.

``BarSource`` is a data source for ``spark.read.format("bars")``.  It plans requests of so many symbols and days each, which tasks
send to a client; filters on symbol and day become part of the plan, so only what is asked for is fetched.  The client is
named by its class: ``FolderBars`` reads bars that lie as Parquet files in a folder of any file system that Arrow opens, another one may
talk to a vendor.
"""

from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.intervals import overlap_join, uncovered
from .tables import fetch_with_retry, guard_mass_failure
from .versioned import VersionedTable

BARS = "symbol string, day date, close double, volume bigint"
SPANS = "symbol string, low date, high date, n bigint"
ARROW = pa.schema([("symbol", pa.string()), ("day", pa.date32()), ("close", pa.float64()), ("volume", pa.int64())])
PUSH = "spark.sql.python.filterPushdown.enabled"


class FolderBars:
    """Bars in Parquet files under a folder, by its address."""

    def __init__(self, options: dict[str, str]):
        self.address = options["store"]

    def _files(self):
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.address)
        found = [f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.base_name.endswith(".parquet")]
        return ds.dataset(sorted(found), schema=ARROW, filesystem=system, format="parquet")

    def symbols(self) -> list[str]:
        """All symbols: a listing of some thousands."""
        import pyarrow.compute as pc

        found: set[str] = set()
        for batch in self._files().to_batches(columns=["symbol"]):
            found.update(pc.unique(batch.column("symbol")).to_pylist())
        return sorted(s for s in found if s is not None)

    def span(self) -> tuple[dt.date, dt.date] | None:
        import pyarrow.compute as pc

        ends = [pc.min_max(b.column("day")).as_py() for b in self._files().to_batches(columns=["day"]) if b.num_rows]
        ends = [e for e in ends if e["min"] is not None]
        return (min(e["min"] for e in ends), max(e["max"] for e in ends)) if ends else None

    def bars(self, symbols: list[str], low: dt.date, high: dt.date) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        day = ds.field("day")
        yield from self._files().to_batches(filter=ds.field("symbol").isin(symbols) & (day >= pa.scalar(low)) & (day <= pa.scalar(high)))


class Request(InputPartition):
    """Some symbols and the days from low to high, both included."""

    def __init__(self, symbols: list[str], low: dt.date, high: dt.date):
        self.symbols, self.low, self.high = symbols, low, high


class BarSource(DataSource):
    """Options: client (module:class, FolderBars by default) and its own; batch (symbols of a request, 500), days (of a request, 366), tries and wait of a retry."""

    @classmethod
    def name(cls) -> str:
        return "bars"

    def schema(self) -> str:
        return BARS

    def reader(self, schema: StructType) -> DataSourceReader:
        return BarReader(dict(self.options))


class BarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.symbols: set[str] | None = None
        self.low: dt.date | None = None
        self.high: dt.date | None = None

    def client(self):
        module, name = self.options.get("client", f"{__name__}:FolderBars").split(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def pushFilters(self, filters: list) -> Iterator:
        """Takes what bounds symbol and day, and hands the rest back to Spark."""
        one = dt.timedelta(days=1)
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column == "symbol" and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = named if self.symbols is None else self.symbols & named
            elif column == "day" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = f.value + one if isinstance(f, GreaterThan) else f.value
                    self.low = low if self.low is None else max(self.low, low)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = f.value - one if isinstance(f, LessThan) else f.value
                    self.high = high if self.high is None else min(self.high, high)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        client = self.client()
        low, high = self.low, self.high
        if low is None or high is None:
            span = client.span()
            if span is None:
                return []
            low, high = low or span[0], high or span[1]
        symbols = sorted(s for s in (client.symbols() if self.symbols is None else self.symbols) if s is not None)
        return planned(symbols, low, high, int(self.options.get("batch", 500)), int(self.options.get("days", 366)))

    def read(self, partition: Request) -> Iterator[pa.RecordBatch]:
        client = self.client()

        def fetch() -> list[pa.RecordBatch]:
            return list(client.bars(partition.symbols, partition.low, partition.high))  # one request: its symbols' days

        for batch in fetch_with_retry(fetch, tries=int(self.options.get("tries", 3)), wait=float(self.options.get("wait", 15))):
            yield batch.select(ARROW.names).cast(ARROW)


def planned(symbols: list[str], low: dt.date, high: dt.date, batch: int, days: int) -> list[Request]:
    """Requests of at most so many symbols and days that cover the symbols and days, each once."""
    out, at = [], low
    while at <= high:
        end = min(high, at + dt.timedelta(days=days - 1))
        out += [Request(symbols[i : i + batch], at, end) for i in range(0, len(symbols), batch)]
        at = end + dt.timedelta(days=1)
    return out


def bars(spark: SparkSession, symbols: list[str] | None, low: str, high: str, **options) -> DataFrame:
    """Bars of the symbols (all, if none are named) from low to high through the source."""
    spark.dataSource.register(BarSource)
    spark.conf.set(PUSH, "true")  # for as long as the session lives: a plan is made when it runs
    df = spark.read.format("bars").options(**{k: str(v) for k, v in options.items()}).load()
    df = df.where(F.col("day").between(F.lit(low).cast("date"), F.lit(high).cast("date")))
    return df if symbols is None else df.where(F.col("symbol").isin(symbols))


class BarCache:
    """Stored bars, and the windows of each symbol that have been asked for, with the number of bars that came.

    ``prices`` reads through: what of a window has not been asked for is fetched, stored, and then noted, in this order, so a run that
    fails between fetches again and stores the same. A symbol for which nothing came is not asked for again in a window that overlaps
    the one that failed.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.bars = VersionedTable(spark, f"{folder}/bars", spark.createDataFrame([], BARS).schema, "day")
        self.asked = VersionedTable(spark, f"{folder}/asked", spark.createDataFrame([], SPANS).schema)

    def gaps(self, symbols: DataFrame, low: str, high: str) -> DataFrame:
        """symbol, low, high: what of the window is neither stored nor known to be empty."""
        window = symbols.select("symbol").distinct().select("symbol", F.lit(low).cast("date").alias("low"), F.lit(high).cast("date").alias("high"))
        asked = self.asked.read()
        failed = asked.where("n = 0").select("symbol", F.col("low").alias("ws"), F.col("high").alias("we"))
        empty = overlap_join(window, failed, ("low", "high"), ("ws", "we"), ["symbol"]).select("symbol").distinct()
        return uncovered(window.join(empty, "symbol", "left_anti"), asked.where("n > 0"), ["symbol"])

    def prices(self, symbols: DataFrame, low: str, high: str, cache_only: bool = False, least: int = 50, **options) -> DataFrame:
        """Stored bars of the symbols in the window, after what was missing has been fetched.  symbols: a column symbol, some thousands of rows.

        A batch of ``least`` symbols or more for which nothing at all comes is an outage and an error; nothing is noted then.
        """
        if not cache_only:
            self._fetch(symbols, low, high, least, options)
        day = F.col("day").between(F.lit(low).cast("date"), F.lit(high).cast("date"))
        return self.bars.read().where(day).join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "day", "close", "volume")

    def _fetch(self, symbols: DataFrame, low: str, high: str, least: int, options: dict) -> None:
        windows: dict[tuple, list[str]] = {}
        for r in self.gaps(symbols, low, high).orderBy("symbol", "low").collect():  # the plan of requests: a listing of symbols
            windows.setdefault((r["low"], r["high"]), []).append(r["symbol"])
        if not windows:
            return
        fetched = [bars(self.spark, names, str(a), str(b), **options) for (a, b), names in windows.items()]
        fresh = fetched[0]
        for more in fetched[1:]:
            fresh = fresh.unionByName(more)
        before = self.bars.versions()[-1]
        self.bars.upsert(fresh.dropDuplicates(["symbol", "day"]), ["symbol", "day"])
        spans = self.spark.createDataFrame([(s, a, b) for (a, b), names in windows.items() for s in names], "symbol string, low date, high date")
        stored = self.bars.read().select(F.col("symbol").alias("s"), "day")
        came = spans.join(stored, (F.col("s") == F.col("symbol")) & F.col("day").between(F.col("low"), F.col("high")), "left").groupBy("symbol", "low", "high").agg(F.count("day").alias("n"))
        told = came.agg(F.countDistinct("symbol").alias("asked"), F.countDistinct(F.when(F.col("n") > 0, F.col("symbol"))).alias("got")).first()
        try:
            guard_mass_failure(told["asked"], told["got"], least)
        except RuntimeError:
            self.bars.restore(before)
            raise
        self.asked.append(came)
