"""Parquet tables with versions: appends, upserts, snapshots, schema changes, retention and compaction.

A version is a small list of parts, each a folder of Parquet files dealt by month.  Changes write new parts and
a new list, and never touch what an older version names, so readers keep what they opened, a snapshot is a number,
and restoring one writes a list.  An upsert writes anew only the months that its rows fall in; the older
parts' other months stay listed.  Of two writers of the same version the second one fails.

A change by a batch of a stream names the stream and the batch, and the list that commits it keeps the last batch of each stream: a
batch that is handed over again after a failure, whether it was committed or only half written, changes nothing twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables
from .folders import Files

MONTH = "month_"


class VersionedTable:
    """A table under ``folder``; ``day`` names the date or time column that rows are dealt by month of, or none."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | None = None, day: str | None = None):
        self.spark, self.folder, self.day = spark, folder.rstrip("/"), day
        self.files = Files(spark, folder)
        if not self.versions():
            if schema is None:
                raise ValueError("a new table needs a schema")
            self._commit(1, [], schema)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.folder}/_versions") if n.endswith(".json")]

    def _list(self, version: int | None = None) -> tuple[int, list[dict], T.StructType]:
        version = version or self.versions()[-1]
        x = json.loads(self.files.read(f"{self.folder}/_versions/{version:08d}.json"))
        return version, x["parts"], T.StructType.fromJson(x["schema"])

    def _batches(self, version: int | None = None) -> dict[str, int]:
        """The last batch of each stream that a version holds."""
        version = version or self.versions()[-1]
        return json.loads(self.files.read(f"{self.folder}/_versions/{version:08d}.json")).get("batches", {})

    def _commit(self, version: int, parts: list[dict], schema: T.StructType, batch: tuple[str, int] | None = None) -> int:
        batches = self._batches(version - 1) if version > 1 else {}
        if batch:
            batches = batches | {batch[0]: batch[1]}
        self.files.create(f"{self.folder}/_versions/{version:08d}.json", json.dumps({"parts": parts, "schema": schema.jsonValue(), "batches": batches}))
        return version

    def holds(self, batch: tuple[str, int] | None) -> bool:
        """Whether a stream's batch has been committed."""
        return bool(batch) and self._batches().get(batch[0], -1) >= batch[1]

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one by default. Columns that were added later are null in older parts."""
        _, parts, schema = self._list(version)
        return self._rows(parts, schema)

    def _rows(self, parts: list[dict], schema: T.StructType) -> DataFrame:
        folders = [f"{p['folder']}/{MONTH}={m}" for p in parts for m in p["months"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, schema: T.StructType, sort: list[str] | None = None) -> dict:
        """A new part; its months are a calendar, so they may be listed."""
        folder = f"{self.folder}/part-{uuid.uuid4().hex}"
        month = F.coalesce(F.date_format(self.day, "yyyy-MM"), F.lit("none")) if self.day else F.lit("all")
        rows = df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).withColumn(MONTH, month)
        if sort:
            rows = rows.repartition(MONTH).sortWithinPartitions(MONTH, *sort)
        rows.write.partitionBy(MONTH).option("compression", "zstd" if sort else "snappy").parquet(folder)
        return {"folder": folder, "months": [n.split("=", 1)[1] for n in self.files.names(folder) if n.startswith(f"{MONTH}=")]}

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds rows. Columns that the table lacks are an error, missing ones are null. batch: of a stream, as for ``upsert``."""
        version, parts, schema = self._list()
        if self.holds(batch):
            return version
        if extra := set(df.columns) - set(schema.names):
            raise ValueError(f"unknown columns {sorted(extra)}")
        return self._commit(version + 1, [*parts, self._write(df, schema)], schema, batch)

    def overwrite(self, df: DataFrame) -> int:
        version, _, schema = self._list()
        return self._commit(version + 1, [self._write(df, schema)], schema)

    def _months_of(self, parts: list[dict], schema: T.StructType, new: DataFrame, keys: list[str]) -> set[str]:
        """The months in which keys of new rows stand already; only keys are read. A key that names the day says itself where it stands."""
        if not parts or self.day in keys:
            return set()
        month = F.coalesce(F.date_format(self.day, "yyyy-MM"), F.lit("none")) if self.day else F.lit("all")
        old = self._rows(parts, schema).select(*keys, month.alias(MONTH))
        return {r[0] for r in old.join(new.select(*keys).distinct(), keys, "left_semi").select(MONTH).distinct().collect()}  # a calendar

    def _merge(self, df: DataFrame, keys: list[str], how, batch: tuple[str, int] | None = None) -> int:
        """The months of new rows, and those in which their keys stand, are read, merged and written anew. Keys that hold a null match nothing."""
        version, parts, schema = self._list()
        if self.holds(batch):
            return version
        new = self._write(df, schema)
        fresh = self._rows([new], schema)
        touched = set(new["months"]) | self._months_of(parts, schema, fresh, keys)
        old = self._rows([{**p, "months": [m for m in p["months"] if m in touched]} for p in parts], schema)
        merged = self._write(how(old, fresh, keys), schema)
        rest = [{**p, "months": [m for m in p["months"] if m not in touched]} for p in parts]
        return self._commit(version + 1, [*(p for p in rest if p["months"]), merged], schema, batch)

    def upsert(self, df: DataFrame, keys: list[str], batch: tuple[str, int] | None = None, latest: str | None = None) -> int:
        """New rows replace those of the same key. batch: (stream, number); one that is committed already changes nothing.

        latest: the column by which the greater row of a key stays, new or old, a new one of equals; without it, one row for each key is asked for.
        """

        def how(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
            if not latest:
                return tables.upsert(old, new, keys)
            both = old.withColumn("__p", F.lit(0)).unionByName(new.withColumn("__p", F.lit(1)))
            return tables.latest(both, keys, F.desc_nulls_last(latest), F.desc("__p"), *self._rest(both, keys, latest)).drop("__p")

        return self._merge(df, keys, how, batch)

    def insert_ignore(self, df: DataFrame, keys: list[str], batch: tuple[str, int] | None = None, first: str | None = None) -> int:
        """New rows are added where the key is not there. batch as for ``upsert``; first: the column by which the smallest of new rows of a key counts."""

        def how(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
            return tables.insert_ignore(old, tables.latest(new, keys, F.asc_nulls_last(first), *self._rest(new, keys, first)) if first else new, keys)

        return self._merge(df, keys, how, batch)

    @staticmethod
    def _rest(df: DataFrame, keys: list[str], at: str) -> list[Column]:
        """The other columns, so that of equal times the same row comes first whatever the order of files."""
        return [F.col(f"`{c}`") for c in df.columns if c not in (*keys, at, "__p")]

    def update_else_insert(self, df: DataFrame, keys: list[str], columns: list[str]) -> int:
        """Sets the columns of rows whose key df names; df's other rows are added whole."""

        def how(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
            return tables.update_else_insert(old, new, keys, columns)

        return self._merge(df, keys, how)

    def delete(self, condition: Column) -> int:
        """Removes the rows for which the condition is true."""
        version, parts, schema = self._list()
        kept = self._rows(parts, schema).where(~F.coalesce(condition, F.lit(False)))
        return self._commit(version + 1, [self._write(kept, schema)], schema)

    def snapshot(self) -> int:
        return self.versions()[-1]

    def restore(self, version: int) -> int:
        """Makes an older version the last one again; nothing is copied."""
        _, parts, schema = self._list(version)
        return self._commit(self.versions()[-1] + 1, parts, schema)

    def add_columns(self, columns: dict[str, str]) -> int:
        """Adds nullable columns that are not there yet; all there: no new version."""
        version, parts, schema = self._list()
        new = [T.StructField(n, T._parse_datatype_string(t)) for n, t in columns.items() if n not in schema.names]
        return self._commit(version + 1, parts, T.StructType([*schema.fields, *new])) if new else version

    def retain(self, as_of: str, days: int) -> int:
        """Drops the months that lie whole before as_of - days, as a policy that drops chunks does."""
        version, parts, schema = self._list()
        first = self.spark.sql(f"select date_format(date_sub(date '{as_of}', {int(days)}), 'yyyy-MM')").first()[0]
        kept = [{**p, "months": [m for m in p["months"] if m >= first]} for p in parts]
        return self._commit(version + 1, [p for p in kept if p["months"]], schema)

    def compact(self, as_of: str, days: int, sort: list[str]) -> int:
        """Writes months that lie whole before as_of - days as one part, sorted and compressed harder."""
        version, parts, schema = self._list()
        first = self.spark.sql(f"select date_format(date_sub(date '{as_of}', {int(days)}), 'yyyy-MM')").first()[0]
        old = [{**p, "months": [m for m in p["months"] if m < first]} for p in parts]
        new = [{**p, "months": [m for m in p["months"] if m >= first]} for p in parts]
        if not any(p["months"] for p in old):
            return version
        packed = self._write(self._rows(old, schema), schema, sort)
        return self._commit(version + 1, [packed, *(p for p in new if p["months"])], schema)

    def vacuum(self, keep: int = 1) -> None:
        """Removes all but the last versions, and the parts that none of those names."""
        kept = self.versions()[-keep:]
        named = {p["folder"].rsplit("/", 1)[1] for v in kept for p in self._list(v)[1]}
        for v in self.versions()[:-keep]:
            self.files.delete(f"{self.folder}/_versions/{v:08d}.json")
        for n in self.files.names(self.folder):
            if n.startswith("part-") and n not in named:
                self.files.delete(f"{self.folder}/{n}")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule; a rule that is null for a row holds, as a check constraint does."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("x")).select("x.*")
