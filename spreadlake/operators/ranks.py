"""Ranks, row numbers and exact quantiles without a task that holds a whole group.

Values are counted first, and lie sorted over ranges that are written once, so neither a large group nor a value that a third of all rows
share is one task's.  What stands before a row is a running sum within its range, the sums of the ranges before, less where its
group begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import counted, ranged


def _begins(df: DataFrame, keys: list[str], at: str, n: Column) -> DataFrame:
    """keys, __start, __total: the least ``at`` of each group, and its sum."""
    return (df.groupBy(*keys) if keys else df).agg(F.min(at).alias("__start"), n.alias("__total"))


def _with(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what their group has."""
    return df.join(groups, keys) if keys else df.join(groups, F.col("__start").isNotNull())  # one row


def rank_table(df: DataFrame, keys: list[str], x: str, weight: Column | None = None, **sums: Column) -> DataFrame:
    """keys, x, n, before, total: how often each value stands in its group (or its weight's sum), and how many rows are smaller. Nulls are left out. sums: more aggregates of each value."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(n.alias("n"), *[c.alias(k) for k, c in sums.items()]).where("n > 0")
    rows = ranged(counts, [*keys, x])
    parts = rows.groupBy("__id").agg(F.sum("n").alias("__k"))  # a row for each range
    offsets = parts.select("__id", F.coalesce(F.sum("__k").over(W.orderBy("__id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    inside = W.partitionBy("__id").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(offsets, "__id").withColumn("__before", F.col("__off") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    got = _with(rows, _begins(rows, keys, "__before", F.sum("n")), keys)
    return got.select(*keys, x, "n", (F.col("__before") - F.col("__start")).alias("before"), F.col("__total").alias("total"), *sums)


def with_average_rank(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """Rows with a value, and its rank from 1; ties share their mean."""
    ranks = rank_table(df, keys, x).select(*keys, x, (F.col("before") + (F.col("n") + 1) / 2.0).alias(out))
    return df.join(ranks, [*keys, x])


def quantiles(df: DataFrame, keys: list[str], x: str, shares: dict[str, float], weight: Column | None = None, **more: Column) -> DataFrame:
    """keys and a column for each named share: the exact quantile, between neighbours by linear interpolation. more: aggregates over each group's values x, of which there are n."""
    table = rank_table(df, keys, x, weight)
    v, before, n = F.col(x).cast("double"), F.col("before"), F.col("n")
    cols, out = [], []
    for name, p in shares.items():
        at = F.lit(p) * (F.col("total") - 1)
        for side, i in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            cols.append(F.max(F.when((before <= i) & (i < before + n), v)).alias(f"__{name}_{side}"))
        cols.append(F.max(at - F.floor(at)).alias(f"__{name}_f"))
        lo, hi, f = (F.col(f"__{name}_{s}") for s in ("lo", "hi", "f"))
        out.append((lo + (hi - lo) * f).alias(name))
    return (table.groupBy(*keys) if keys else table).agg(*cols, *[c.alias(k) for k, c in more.items()]).select(*keys, *out, *more)


def numbered(df: DataFrame, keys: list[str], x: str, key: str, out: str, total: str | None = None) -> DataFrame:
    """Adds the row's number from 1 within its group by (x, key), key unique, and the group's size. Rows without x are left out."""
    rows = counted(df.where(F.col(x).isNotNull()), [*keys, x, key]).withColumnRenamed("__n", "__row")
    got = _with(rows, _begins(rows, keys, "__row", F.count(F.lit(1))), keys).withColumn(out, F.col("__row") - F.col("__start") + 1)
    return (got.withColumn(total, F.col("__total")) if total else got).drop("__row", "__start", "__total")
