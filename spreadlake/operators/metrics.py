"""Run, trade and pair metrics. Three definitions of profit differ in what slippage they charge; each is a function of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .panel import top_k
from .ranks import rank_table


def round_trips(trades: DataFrame) -> DataFrame:
    """Every later sell of every buy, by run, symbol and pair; only the sell's slippage is charged."""
    b = trades.where("side = 'buy'").select("run_id", "symbol", "pair_id", F.col("id").alias("buy_id"), F.col("price").alias("bp"), F.col("quantity").alias("q"), F.col("filled_at").alias("bt"))
    s = trades.where("side = 'sell'").select("run_id", "symbol", "pair_id", F.col("id").alias("sell_id"), F.col("price").alias("sp"), F.col("slippage").alias("slip"), F.col("filled_at").alias("st"), "exit_reason")
    both = b.join(s, ["run_id", "symbol", "pair_id"]).where("st > bt")
    days = (F.unix_micros(F.col("st").cast("timestamp")) - F.unix_micros(F.col("bt").cast("timestamp"))) / 86400e6
    return both.withColumn("pnl", (F.col("sp") - F.col("bp")) * F.col("q") - F.coalesce("slip", F.lit(0.0))).withColumn("hold_days", days)


def pair_pnl(trades: DataFrame) -> DataFrame:
    """pair_id, pnl of pairs with both sides; slippage on both."""
    v = F.when(F.col("side") == "sell", F.col("quantity") * F.col("price") - F.col("slippage")).otherwise(-(F.col("quantity") * F.col("price") + F.col("slippage")))
    return trades.groupBy("pair_id").agg(F.sum(v).alias("pnl"), F.countDistinct("side").alias("n")).where("n = 2").drop("n")


def first_match(trades: DataFrame) -> DataFrame:
    """run_id, symbol, gain: the first buy against the first sell after it began, without slippage."""
    side = lambda s: [F.min_by(F.when(F.col("side") == s, F.struct("price", "quantity", "filled_at")), F.when(F.col("side") == s, F.struct("filled_at", "id"))).alias(s)]
    both = trades.groupBy("run_id", "symbol").agg(*side("buy"), *side("sell")).where("buy is not null and sell is not null and sell.filled_at > buy.filled_at")
    return both.select("run_id", "symbol", ((F.col("sell.price") - F.col("buy.price")) * F.col("buy.quantity")).alias("gain"))


def run_metrics(snapshots: DataFrame, year: float = 252.0) -> DataFrame:
    """run_id, n, total_return, sharpe, max_drawdown, avg_cash, avg_pairs, beats, pv_std, ret_std."""
    w = W.partitionBy("run_id").orderBy("day")
    peak = F.max("pv").over(w.rowsBetween(W.unboundedPreceding, 0))
    x = snapshots.withColumn("ret", F.col("pv") / F.lag("pv").over(w) - 1).withColumn("dd", (F.col("pv") - peak) / peak)
    first, last = (lambda c: F.min_by(c, "day")), (lambda c: F.max_by(c, "day"))
    sd = F.stddev_samp("ret")
    total = last("pv") / first("pv") - 1
    return x.groupBy("run_id").agg(
        F.count("*").alias("n"), total.alias("total_return"), F.when(sd > 1e-9, F.avg("ret") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(year))).alias("sharpe"), F.abs(F.min("dd")).alias("max_drawdown"),
        F.avg("cash_ratio").alias("avg_cash"), F.avg("active_pairs").alias("avg_pairs"), (total > last("spy") / first("spy") - 1).alias("beats"), F.stddev_samp("pv").alias("pv_std"), sd.alias("ret_std"),
    )


def run_score(metrics: DataFrame, n_trades: DataFrame, drawdown_weight: float, trade_weight: float, benchmark_weight: float, min_trades: int = 3) -> DataFrame:
    """run_id, score: -999 without enough or moving snapshots, -50 with too few trades."""
    x = metrics.join(n_trades, "run_id", "left").withColumn("t", F.coalesce("n_trades", F.lit(0)))
    score = F.col("sharpe") - drawdown_weight * F.col("max_drawdown") - trade_weight * F.log1p("t") + F.when(~F.col("beats"), -2.0 * benchmark_weight).otherwise(0.0)
    return x.select("run_id", F.when(F.col("n") < 3, -999.0).when(F.col("t") < min_trades, -50.0).when((F.col("pv_std") < 1e-6) | (F.col("ret_std") < 1e-9), -999.0).otherwise(score).alias("score"))


def fisher_pool(rhos: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Pooled correlation of groups with more than 3 rows, with a 95 % interval; a weight of n - 3 each."""
    w = F.col(n) - 3
    z = 0.5 * (F.log1p(rho) - F.log(1 - F.col(rho)))
    m, se = F.sum(w * z) / F.sum(w), 1 / F.sqrt(F.sum(w))
    return rhos.where((w > 0) & F.col(rho).isNotNull()).agg(F.tanh(m).alias("pooled"), F.tanh(m - 1.96 * se).alias("low"), F.tanh(m + 1.96 * se).alias("high"))


def trimmed_means(df: DataFrame, group: str, x: str, key: str, k: int) -> DataFrame:
    """group, mean, trimmed (without the k lowest), worst_share of the loss that these hold: from totals less the k rows."""
    loss = F.least(F.col(x), F.lit(0.0))
    total = df.groupBy(group).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(loss).alias("l"))
    worst = top_k(df.where(F.col(x).isNotNull()), [group], k, x, key).groupBy(group).agg(F.count(x).alias("wn"), F.sum(x).alias("ws"), F.sum(loss).alias("wl"))
    y = total.join(worst, group)
    return y.select(group, (F.col("s") / F.col("n")).alias("mean"), ((F.col("s") - F.col("ws")) / F.nullif(F.col("n") - F.col("wn"), F.lit(0))).alias("trimmed"), (F.col("wl") / F.nullif(F.col("l"), F.lit(0.0))).alias("worst_share"))


def auc(df: DataFrame, label: str, x: str) -> DataFrame:
    """Mann-Whitney: the chance that a row of label 1 lies above one of label 0, ties half. Ranks are needed per value only."""
    t = rank_table(df.where(F.col(label).isNotNull()), [], x, ones=F.sum(F.col(label).cast("long")))
    n1, n0 = F.sum("ones"), F.sum(F.col("n") - F.col("ones"))
    ranks = F.sum(F.col("ones") * (F.col("before") + (F.col("n") + 1) / 2.0))
    return t.agg(((ranks - n1 * (n1 + 1) / 2.0) / (n1 * n0)).alias("auc"))
