"""Panel operators over long price tables (symbol, day, close) and aligned pairs (lead, lag, day, pl, pg)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import numbered, with_average_rank

PAIR = ("lead", "lag")


def rows(keys, order, back: int, ahead: int = 0):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(-back if back is not None else W.unboundedPreceding, ahead)


def ordered(keys, order):
    return W.partitionBy(*keys).orderBy(order)


def log_floor(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-9)))


def log_returns(prices: DataFrame) -> DataFrame:
    """Adds ret, the change of the floored logarithm; null at a symbol's first day."""
    w = ordered(["symbol"], "day")
    return prices.withColumn("ret", log_floor(F.col("close")) - F.lag(log_floor(F.col("close"))).over(w))


def simple_returns(prices: DataFrame, k: int = 1) -> DataFrame:
    w = ordered(["symbol"], "day")
    return prices.withColumn("ret", F.col("close") / F.nullif(F.lag("close", k).over(w), F.lit(0.0)) - 1)


def rolling(df: DataFrame, keys, order: str, x: str, window: int, out: str, how=F.avg, min_periods: int | None = None) -> DataFrame:
    """how over the last ``window`` rows, null with fewer values than min_periods (the window by default)."""
    w = rows(keys, order, window - 1)
    need = window if min_periods is None else min_periods
    return df.withColumn(out, F.when(F.count(x).over(w) >= need, how(x).over(w)))


def align(prices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both legs of every pair on their common days: lead, lag, day, pl, pg, and the position from 0. pairs is joined first, so each leg is scanned once."""
    a = prices.select(F.col("symbol").alias("lead"), "day", F.col("close").alias("pl"))
    b = prices.select(F.col("symbol").alias("lag"), "day", F.col("close").alias("pg"))
    both = pairs.join(a, "lead").join(b, ["lag", "day"]).select("lead", "lag", "day", "pl", "pg")
    return both.withColumn("pos", F.row_number().over(ordered(PAIR, "day")) - 1)


def pairs_within(groups: DataFrame, group: str, symbol: str = "symbol") -> DataFrame:
    """lead < lag of every group: an equi-join on the group, never a product of all symbols."""
    a, b = groups.select(F.col(group), F.col(symbol).alias("lead")), groups.select(F.col(group), F.col(symbol).alias("lag"))
    return a.join(b, group).where("lead < lag")


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation; null where it has no value. covar over deviations, as corr raises on constant input."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))


def pair_returns(aligned: DataFrame) -> DataFrame:
    w = ordered(PAIR, "day")
    return aligned.withColumn("rl", log_floor(F.col("pl")) - F.lag(log_floor(F.col("pl"))).over(w)).withColumn("rg", log_floor(F.col("pg")) - F.lag(log_floor(F.col("pg"))).over(w))


def dual_correlation(aligned: DataFrame, long: int, short: int) -> DataFrame:
    """corr_long, corr_short of the last so many log returns of each pair; null with fewer."""
    r = pair_returns(aligned).where("rl is not null").withColumn("back", F.row_number().over(W.partitionBy(*PAIR).orderBy(F.desc("day"))))
    out = []
    for n, name in ((long, "corr_long"), (short, "corr_short")):
        xs, ys = F.when(F.col("back") <= n, F.col("rl")), F.when(F.col("back") <= n, F.col("rg"))
        out.append(F.when(F.count(xs) >= n, F.covar_samp(xs, ys) / F.nullif(F.stddev_samp(xs) * F.stddev_samp(ys), F.lit(0.0))).alias(name))
    return r.where(F.col("back") <= max(long, short)).groupBy(*PAIR).agg(*out)


def spread(aligned: DataFrame) -> DataFrame:
    """Adds ll, lg (floored logarithms), hedge (slope of lg on ll over the pair's rows) and s = lg - hedge * ll."""
    x = aligned.withColumn("ll", log_floor(F.col("pl"))).withColumn("lg", log_floor(F.col("pg")))
    whole = W.partitionBy(*PAIR)
    return x.withColumn("hedge", F.regr_slope("lg", "ll").over(whole)).withColumn("s", F.col("lg") - F.col("hedge") * F.col("ll"))


def zscore(aligned: DataFrame, window: int) -> DataFrame:
    """Adds spread columns and z, the spread in deviations of its last ``window`` rows; null before, and at zero deviation."""
    x = spread(aligned)
    w = rows(PAIR, "day", window - 1)
    z = (F.col("s") - F.avg("s").over(w)) / F.nullif(F.stddev_samp("s").over(w), F.lit(0.0))
    return x.withColumn("z", F.when(F.count("s").over(w) >= window, z))


def last_row(df: DataFrame, keys, order: str, *cols: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in cols])


def spearman(df: DataFrame, keys: list[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """Rank correlation of each group; null with fewer than 3 rows or constant input. Also n."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    r = with_average_rank(with_average_rank(both, keys, x, "__a"), keys, y, "__b")
    return (r.groupBy(*keys) if keys else r).agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, safe_corr("__a", "__b")).alias(out))


def top_k(df: DataFrame, keys, k: int, *order) -> DataFrame:
    """The first k rows of each group; order must end in a unique column."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def quantile_bin(df: DataFrame, keys: list[str], x: str, key: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins 0.. of rows numbered by (x, key), with the linear-interpolated edges of the row numbers; not ntile, whose remainders lie elsewhere."""
    y = numbered(df, keys, x, key, "__i", "__n")
    pos = (F.col("__i") - 1) * F.lit(bins) / F.greatest(F.col("__n") - 1, F.lit(1))
    return y.withColumn(out, F.greatest(F.ceil(pos).cast("int") - 1, F.lit(0))).drop("__i", "__n")


def pairwise_correlation(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rho, n) of every column of x with every column of y over the rows in which both have a value; NaN where there are fewer than two or nothing varies."""
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = lambda v: np.where(np.isfinite(v).any(axis=0), np.nansum(v, axis=0) / np.isfinite(v).sum(axis=0), 0.0)
        ma, mb = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
        xa, xb = np.nan_to_num(x - mean(x)), np.nan_to_num(y - mean(y))
        n = ma.T @ mb
        sx, sy = xa.T @ mb / n, ma.T @ xb / n
        cov = xa.T @ xb / n - sx * sy
        vx, vy = (xa**2).T @ mb / n - sx**2, ma.T @ xb**2 / n - sy**2
        return np.where((n > 1) & (vx > 1e-18) & (vy > 1e-18), cov / np.sqrt(vx * vy), np.nan), n


def correlation_blocks(returns: DataFrame, symbol: str = "symbol", day: str = "day", x: str = "ret", size: int = 256) -> DataFrame:
    """a < b, rho over the days on which both have a value, for all symbols.

    Symbols lie in blocks; a pair of blocks is one group, which sums products of its two matrices. So a day is sent once for
    each pair of blocks, never as a row for each pair of symbols.
    """
    names = returns.select(symbol).distinct().withColumn("block", F.floor((F.row_number().over(W.orderBy(symbol)) - 1) / size).cast("int"))  # a row for each symbol
    n_blocks = names.agg((F.max("block") + 1).alias("blocks"))
    placed = returns.where(F.col(x).isNotNull()).join(names, symbol).join(F.broadcast(n_blocks), F.col("blocks") > F.col("block"))  # one row
    to = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("bi"), F.greatest("block", j).alias("bj"))))
    units = placed.select(F.col(symbol).alias("symbol"), F.col(day).alias("day"), F.col(x).cast("double").alias("x"), "block", to.alias("u")).select("u.*", "symbol", "day", "x", "block")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot(index="day", columns="symbol", values="x")
        side = g.drop_duplicates("symbol").set_index("symbol")["block"]
        rows, cols = (sorted(side.index[side == b]) for b in key)
        rho, n = pairwise_correlation(wide[rows].to_numpy(), wide[cols].to_numpy())
        a, b = np.meshgrid(rows, cols, indexing="ij")
        out = pd.DataFrame({"a": a.ravel(), "b": b.ravel(), "rho": rho.ravel(), "n": n.ravel()})
        return out[(out["a"] < out["b"]) & (out["n"] > 0)][["a", "b", "rho"]]

    got = units.groupBy("bi", "bj").applyInPandas(run, "a string, b string, rho double")
    return got.withColumn("rho", F.nanvl("rho", F.lit(None).cast("double")))
