"""Joins of observations with dated events, and policies over forward paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remap(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    """Symbols replaced by what a fixed map names for them."""
    keys = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn(col, F.coalesce(F.create_map(*keys)[F.col(col)], F.col(col)) if keys else F.col(col))


def _week(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-05").cast("date")) / 7)


def _legs_by_week(obs: DataFrame, key: str, before: int) -> DataFrame:
    """A row for each leg and each week that its span touches: what an equi-join with events by symbol and week needs."""
    legs = obs.select(key, "entry", "exit", F.explode(F.array("lead", "lag")).alias("symbol"))
    weeks = F.sequence(_week(F.date_sub("entry", before)), _week(F.greatest("exit", "entry")))
    return legs.withColumn("week", F.explode(weeks))


def events_in_hold(obs: DataFrame, events: DataFrame, key: str, before: int = 7) -> DataFrame:
    """key and a flag for each event group: an event on either leg with entry - before < day <= exit.

    The legs become rows for each week of their span and join on (symbol, week), so an event meets the legs of its week only.
    obs: key, lead, lag, entry, exit. events: symbol, day, and boolean columns.
    """
    flags = [c for c in events.columns if c not in ("symbol", "day")]
    dated = events.withColumn("week", _week(F.col("day")))
    hit = _legs_by_week(obs, key, before).join(dated, ["symbol", "week"]).where((F.col("day") > F.date_sub("entry", before)) & (F.col("day") <= F.col("exit")))
    got = hit.groupBy(key).agg(*[F.bool_or(c).alias(c) for c in flags])
    return obs.select(key).join(got, key, "left").select(key, *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])


def hold_classes(obs: DataFrame, events: DataFrame, key: str, before: int = 7) -> DataFrame:
    """key, hold (entry < day <= exit), pre (entry - before <= day <= entry), hits: the days in order as text."""
    d = F.col("day")
    near = _legs_by_week(obs, key, before).join(events.select("symbol", "day", _week(d).alias("week")), ["symbol", "week"]).where((d >= F.date_sub("entry", before)) & (d <= F.col("exit")))
    got = near.groupBy(key).agg(F.bool_or(d > F.col("entry")).alias("hold"), F.bool_or(d <= F.col("entry")).alias("pre"), F.array_join(F.sort_array(F.collect_set(F.date_format("day", "yyyy-MM-dd"))), ",").alias("hits"))
    return obs.select(key).join(got, key, "left").select(key, F.coalesce("hold", F.lit(False)).alias("hold"), F.coalesce("pre", F.lit(False)).alias("pre"), F.coalesce("hits", F.lit("")).alias("hits"))


def policy_exit(exit_t: Column, next_t: Column, surprise_t: Column, last_t: Column, hold_off: int, lead_days: int, react: bool) -> tuple[Column, Column]:
    """(traded, exit day) of an event policy: no entry with results within ``hold_off`` days, exit ``lead_days`` before them, and the day after a surprise."""
    traded = ~F.coalesce(next_t <= hold_off, F.lit(False))
    t = F.when(next_t <= exit_t, F.least(exit_t, F.greatest(F.lit(1), next_t - lead_days))).otherwise(exit_t)
    if react:
        t = F.when(surprise_t <= t, F.least(last_t, surprise_t + 1)).otherwise(t)
    return traded, F.when(traded, F.least(t, last_t))
