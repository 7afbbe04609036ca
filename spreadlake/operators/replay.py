"""Forward outcomes of pairs: first passages, exit policies, stops; over positions of aligned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from .panel import PAIR, log_floor, ordered, rows


def frozen_spread(aligned: DataFrame, entry: int, window: int) -> DataFrame:
    """Adds s with the hedge of rows up to ``entry``, its rolling z, the legs' rolling correlation, t = pos - entry, s0 and z0. Nothing after the entry enters hedge or z0."""
    whole = W.partitionBy(*PAIR)
    x = aligned.withColumn("ll", log_floor(F.col("pl"))).withColumn("lg", log_floor(F.col("pg")))
    before = F.col("pos") <= entry
    x = x.withColumn("hedge", F.regr_slope(F.when(before, F.col("lg")), F.when(before, F.col("ll"))).over(whole)).withColumn("s", F.col("lg") - F.col("hedge") * F.col("ll"))
    w = rows(PAIR, "pos", window - 1)
    x = x.withColumn("z", F.when(F.count("s").over(w) >= window, (F.col("s") - F.avg("s").over(w)) / F.nullif(F.stddev_samp("s").over(w), F.lit(0.0))))
    step = ordered(PAIR, "pos")
    x = x.withColumn("rl", F.col("ll") - F.lag("ll").over(step)).withColumn("rg", F.col("lg") - F.lag("lg").over(step))
    sd = F.stddev_samp("rl").over(w) * F.stddev_samp("rg").over(w)
    x = x.withColumn("corr", F.when(F.count("rl").over(w) >= window, F.covar_samp("rl", "rg").over(w) / F.nullif(sd, F.lit(0.0))))
    at = lambda c: F.max(F.when(F.col("pos") == entry, F.col(c))).over(whole)
    return x.withColumn("t", F.col("pos") - entry).withColumn("s0", at("s")).withColumn("z0", at("z"))


def forward_paths(aligned: DataFrame, entry: int, window: int, horizon: int) -> DataFrame:
    """Rows t = 0..horizon of each pair: t, hedge, z0, z (absolute), corr, gross in basis points."""
    x = frozen_spread(aligned, entry, window).where(F.col("t").between(0, horizon) & F.col("z0").isNotNull())
    return x.select(*PAIR, "t", "hedge", "z0", F.abs("z").alias("z"), "corr", S.forward_bps(F.col("z0"), F.col("s0"), F.col("s"), F.col("hedge")).alias("gross"))


def first_passage(paths: DataFrame, exit_z: float, cap: int) -> DataFrame:
    """exit_t: the first t >= 1 with z <= exit_z, else the cap or the path's end; and the gross there."""
    x = paths.groupBy(*PAIR).agg(F.min(F.when((F.col("t") >= 1) & (F.col("t") <= cap) & (F.col("z") <= exit_z), F.col("t"))).alias("hit"), F.least(F.max("t"), F.lit(cap)).alias("last"))
    x = x.where("last >= 1").select(*PAIR, F.coalesce("hit", "last").alias("exit_t"))
    return x.join(paths.withColumnRenamed("t", "exit_t"), [*PAIR, "exit_t"]).select(*PAIR, "exit_t", "gross", "hedge")


def fixed_exit(paths: DataFrame, k: int) -> DataFrame:
    return paths.where(F.col("t") == k).select(*PAIR, F.col("t").alias("exit_t"), "gross", "hedge")


def oracle_exit(paths: DataFrame, cap: int) -> DataFrame:
    """The best t in 1..cap, known only afterwards; the first of equals."""
    x = paths.where(F.col("t").between(1, cap)).withColumn("n", F.row_number().over(W.partitionBy(*PAIR).orderBy(F.desc(F.round("gross", 9)), "t")))
    return x.where("n = 1").select(*PAIR, F.col("t").alias("exit_t"), "gross", "hedge")


def net_of_costs(exits: DataFrame, slip_side: float = 5.0, annual: float = 0.01) -> DataFrame:
    borrow = S.borrow_bps(F.col("hedge"), F.col("exit_t"), annual)
    return exits.withColumn("borrow", borrow).withColumn("net", F.col("gross") - 2 * slip_side - borrow)


def stops(paths: DataFrame, rules: list[tuple[str, object]], cap: int) -> DataFrame:
    """day, reason, gross of the first rule that holds at t >= 1; on the same day the earlier rule; else 'cap' at the end. rules: name, condition."""
    reason = F.lit(None).cast("string")
    for name, cond in reversed(rules):
        reason = F.when(cond, name).otherwise(reason)
    x = paths.where(F.col("t").between(1, cap)).withColumn("reason", reason).withColumn("n", F.row_number().over(W.partitionBy(*PAIR).orderBy(F.col("reason").isNull(), F.when(F.col("reason").isNull(), -F.col("t")).otherwise(F.col("t")))))
    return x.where("n = 1").select(*PAIR, F.col("t").alias("day"), F.coalesce("reason", F.lit("cap")).alias("reason"), "gross")


def convergence(paths: DataFrame, days=(3, 5, 10, 20)) -> DataFrame:
    """Share of |z0| gone by each day, whether half of it went within 20 days, and the first such day."""
    half = F.col("z") <= F.abs("z0") / 2
    at = [(1 - F.max(F.when(F.col("t") == k, F.col("z") / F.abs("z0")))).alias(f"conv_{k}") for k in days]
    return paths.groupBy(*PAIR).agg(*at, F.coalesce(F.bool_or((F.col("t").between(1, 20)) & half), F.lit(False)).alias("hit20"), F.min(F.when((F.col("t") >= 1) & half, F.col("t"))).alias("days_to_half"))

