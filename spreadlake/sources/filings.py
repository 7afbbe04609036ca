"""Filing documents: maps of companies, parallel arrays to rows, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cik_map(df: DataFrame, json_col: str) -> DataFrame:
    """ticker, cik from an object of objects."""
    entry = F.from_json(json_col, "map<string, struct<ticker: string, cik_str: long>>")
    return df.select(F.explode(entry).alias("k", "v")).select(F.upper("v.ticker").alias("t"), F.col("v.ticker").alias("ticker"), F.col("v.cik_str").alias("cik")).drop("t")


def cik_map_columnar(df: DataFrame, json_col: str) -> DataFrame:
    """ticker, cik from the form with a list of fields and rows of data."""
    form = F.from_json(json_col, "struct<fields: array<string>, data: array<array<string>>>")
    rows = df.select(form.alias("f")).select("f.fields", F.explode("f.data").alias("d"))
    at = lambda name: F.get("d", F.array_position("fields", name).cast("int") - 1)
    return rows.select(at("ticker").alias("ticker"), at("cik").cast("long").alias("cik"))


def extract(blocks: DataFrame, forms: list[str], since: str) -> DataFrame:
    """Rows of parallel arrays: forms asked for, with an acceptance time, on or after a UTC day; missing items are empty."""
    rows = blocks.select(F.explode(F.arrays_zip("accessionNumber", "form", "acceptanceDateTime", "items")).alias("x")).select(F.col("x.accessionNumber").alias("accession"), "x.form", F.coalesce("x.items", F.lit("")).alias("items"), F.col("x.acceptanceDateTime").alias("at"))
    rows = rows.where(F.col("form").isin(forms) & (F.coalesce("at", F.lit("")) != "")).withColumn("filed_at", F.to_timestamp("at"))
    return rows.where(F.to_date("filed_at") >= F.lit(since).cast("date")).drop("at")


def pages_since(pages: DataFrame, since: str) -> DataFrame:
    """Archived pages that end on or after the day; the others need no fetch."""
    return pages.where(F.col("filing_to") >= F.lit(since).cast("date"))


def scan(events: DataFrame, symbols: list[str], start: str, end: str, forms: list[str] | None = None) -> DataFrame:
    keep = F.col("symbol").isin(symbols) & F.to_date("filed_at").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return events.where(keep & F.col("form").isin(forms) if forms else keep).orderBy("filed_at")
