"""Gates that thin out symbols and pairs before anything costly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import merged_windows, overlap_join
from .ranks import quantiles


def penny_gate(pairs: DataFrame, prices: DataFrame, least: float) -> DataFrame:
    """Pairs whose legs both closed at ``least`` or more on their last day."""
    good = prices.groupBy("symbol").agg(F.max_by("close", "day").alias("c")).where(F.col("c") >= least).select("symbol")
    return with_legs(pairs, good)


def with_legs(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    for leg in ("lead", "lag"):
        pairs = pairs.join(symbols.select(F.col("symbol").alias(leg)), leg, "left_semi")
    return pairs.select("lead", "lag")


def without_legs(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    for leg in ("lead", "lag"):
        pairs = pairs.join(symbols.select(F.col("symbol").alias(leg)), leg, "left_anti")
    return pairs.select("lead", "lag")


def without_mirrors(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs neither of whose legs is held the other way round: the lag short, or the lead long. held: symbol, leg."""
    for leg, other in (("lag", "short"), ("lead", "long")):
        pairs = pairs.join(held.where(F.col("leg") == other).select(F.col("symbol").alias(leg)), leg, "left_anti")
    return pairs.select("lead", "lag")


def overlapping(windows: DataFrame, start: str, end: str, low: str = "ws", high: str = "we") -> DataFrame:
    return windows.where((F.col(low) <= F.lit(end).cast("date")) & (F.col(high) >= F.lit(start).cast("date")))


def failed_for_requests(requests: DataFrame, failed: DataFrame, keys: list[str], span: tuple[str, str] = ("low", "high"), windows: tuple[str, str] = ("ws", "we")) -> DataFrame:
    """keys (of a request), symbol: each symbol with a stored window that overlaps the request's, once.

    A symbol's windows are merged first, as which of them it was doesn't count; then requests and windows meet by blocks of days.
    """
    merged = merged_windows(failed, ["symbol"], *windows)
    return overlap_join(requests.select(*keys, *span), merged, span, windows).select(*keys, "symbol").distinct()


def universe_health(counts: DataFrame, large: int = 500, share: int = 5) -> DataFrame:
    """counts: raw, left_; fails when nothing is left, or less than a fifth of many."""
    raw, left = F.col("raw"), F.col("left_")
    return counts.withColumn("status", F.when((raw > 0) & (left == 0), "fail").when((raw >= large) & (left * share < raw), "fail").otherwise("ok"))


def off_cooldown(pairs: DataFrame, evaluated: DataFrame, today: str, days: int | None) -> DataFrame:
    """Pairs, in either order, that were not evaluated within so many days; none or 0 days lets all pass."""
    if not days:
        return pairs
    a, b = F.least("lead", "lag"), F.greatest("lead", "lag")
    last = evaluated.groupBy(a.alias("a"), b.alias("b")).agg(F.max("date").alias("last"))
    keyed = pairs.withColumn("a", a).withColumn("b", b).join(last, ["a", "b"], "left")
    return keyed.where(F.col("last").isNull() | (F.datediff(F.lit(today).cast("date"), F.col("last")) >= days)).select("lead", "lag")


def covered_symbols(prices: DataFrame, calendar: DataFrame, share: float) -> DataFrame:
    """symbol, bars of those with at least so large a share of the calendar's days, and two."""
    days = calendar.select("day").distinct().agg(F.greatest(F.lit(2), F.floor(F.count("*") * F.lit(share))).alias("need"))
    held = prices.groupBy("symbol").agg(F.count("close").alias("bars"))
    return held.join(F.broadcast(days), F.col("bars") >= F.col("need")).select("symbol", "bars")  # one row


def complete_days(prices: DataFrame) -> DataFrame:
    """Days on which every symbol has a close."""
    n = prices.agg(F.countDistinct("symbol").alias("n"))
    per = prices.groupBy("day").agg(F.count("close").alias("k"))
    return per.join(n, F.col("k") == F.col("n")).select("day")


def left_out_screen(df: DataFrame, group: str, x: str, p: float) -> DataFrame:
    """Rows at or above the p-quantile of x over the other groups, of which there are few: each value counts for a group as often as it stands in the others."""
    own = df.where(F.col(x).isNotNull()).groupBy(group, x).agg(F.count(F.lit(1)).alias("own"))
    groups = df.select(F.col(group).alias("__g")).distinct().agg(F.collect_set("__g").alias("__gs"))
    each = own.join(F.broadcast(groups), F.col("own") > 0).select(F.explode("__gs").alias("__g"), group, x, "own").where(F.col("__g") != F.col(group))  # one row
    least = quantiles(each, ["__g"], x, {"__t": p}, weight=F.col("own"))
    return df.join(least, F.col(group) == F.col("__g")).where(F.col(x) >= F.col("__t")).drop("__g", "__t")


def top_unique(df: DataFrame, key: str, k: int, *order) -> DataFrame:
    """The k best rows of different keys."""
    best = df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
    return best.orderBy(order[0], key).limit(k)


def universe_changed(a: DataFrame, b: DataFrame) -> DataFrame:
    marks = a.select("symbol", F.lit(1).alias("m")).unionByName(b.select("symbol", F.lit(2).alias("m")))
    odd = marks.groupBy("symbol").agg(F.countDistinct("m").alias("n")).where("n = 1")
    return odd.agg((F.count("*") > 0).alias("changed"))
