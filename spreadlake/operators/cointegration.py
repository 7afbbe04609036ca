"""Cointegration and mean reversion of pairs: unit-root tests from sums over each pair's rows. ``coint_p`` and ``adf_tau`` are the same tests of one series at a time, which tests hold them against."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panel import PAIR, ordered
from .unit_root import statistics

# Response surface of the p-value for two series and a constant (and one series, constant).
SURFACES = {
    2: dict(top=0.92, bottom=-18.86, star=-2.62, small=(2.92, 1.5012, 0.039796), large=(2.1945, 0.64695, -0.29198, -0.042377)),
    1: dict(top=2.74, bottom=-18.83, star=-1.61, small=(2.1659, 1.4412, 0.038269), large=(1.7339, 0.93202, -0.12745, -0.010368)),
}


def unit_root_p(tau: float, series: int) -> float:
    s = SURFACES[series]
    if tau > s["top"]:
        return 1.0
    if tau < s["bottom"]:
        return 0.0
    coef = s["small"] if tau <= s["star"] else s["large"]
    x = sum(c * tau**i for i, c in enumerate(coef))
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    return beta, float(rest @ rest), np.linalg.pinv(x.T @ x)


def adf_tau(s: np.ndarray, constant: bool) -> float:
    """t-value of the level in the regression of differences on level and lagged differences; the number of lags by AIC on a common sample."""
    n = len(s)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2 - constant)
    d = np.diff(s)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        y = d[skip:]
        cols = [s[skip:-1]] + [d[skip - k : len(d) - k] for k in range(1, lags + 1)] + ([np.ones(len(y))] if constant else [])
        return y, np.stack(cols, axis=1)

    def aic(lags: int) -> float:
        y, x = design(lags, most)
        ssr = max(_ols(y, x)[1], 1e-300)
        return len(y) * math.log(ssr / len(y)) + 2 * x.shape[1]

    lags = min(range(max(most, 0) + 1), key=aic) if most >= 0 else 0
    y, x = design(lags, lags)
    beta, ssr, inv = _ols(y, x)
    se = math.sqrt(max(ssr / max(len(y) - x.shape[1], 1) * inv[0, 0], 0.0))
    return float(beta[0] / se) if se > 0 else float("-inf")


def coint_p(lead: np.ndarray, lag: np.ndarray, least: int = 20) -> float | None:
    """p-value of no cointegration of two logarithmic series: the residual of the first on the second and a constant."""
    if len(lead) < least:
        return None
    x = np.stack([lag, np.ones(len(lag))], axis=1)
    beta, ssr, _ = _ols(lead, x)
    if ssr < 1e-12 * max(float(lead @ lead), 1e-300):
        return 0.0
    return unit_root_p(adf_tau(lead - x @ beta, constant=False), 2)


def _p_of(tau: Column, series: int) -> Column:
    @F.pandas_udf("double")
    def p(t: pd.Series) -> pd.Series:
        return pd.Series([None if math.isnan(x) else unit_root_p(x, series) for x in t.astype(float)], dtype="float64")

    return p(tau)


def residuals(aligned: DataFrame, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys, pos, s: what the logarithm of the lead is beyond a line of the lag's; and of each pair ok (all prices are there) and flat (nothing is left)."""
    rows = aligned.select(*keys, "pos", F.log(F.greatest(F.col("pl").cast("double"), F.lit(1e-9))).alias("y"), F.log(F.greatest(F.col("pg").cast("double"), F.lit(1e-9))).alias("x"), (F.col("pl").isNotNull() & F.col("pg").isNotNull()).alias("there"))
    left = F.regr_syy("y", "x") - F.coalesce(F.regr_sxy("y", "x") ** 2 / F.nullif(F.regr_sxx("y", "x"), F.lit(0.0)), F.lit(0.0))
    fit = rows.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.bool_and(F.col("there") & ~F.isnan("x") & ~F.isnan("y")).alias("ok"), (left < 1e-12 * F.greatest(F.sum(F.col("y") * F.col("y")), F.lit(1e-300))).alias("flat"),
    )
    return rows.join(fit, list(keys)).select(*keys, "pos", (F.col("y") - F.col("my") - F.col("slope") * (F.col("x") - F.col("mx"))).alias("s"), "ok", "flat")


def cointegration(aligned: DataFrame, ceiling: float = 0.20, least: int = 20, keys: tuple[str, ...] = PAIR) -> DataFrame:
    """keys, coint_pvalue, coint_score of every pair: 1 for fewer rows than ``least`` or missing prices, 0 for a line without residual."""
    rest = residuals(aligned, keys)
    how = rest.groupBy(*keys).agg(F.bool_and("ok").alias("ok"), F.bool_and("flat").alias("flat"))
    told = statistics(rest, list(keys), "pos", "s", constant=False).join(how, list(keys))
    p = F.when((F.col("n") < least) | ~F.col("ok"), 1.0).when(F.col("flat"), 0.0).otherwise(F.coalesce(_p_of(F.col("tau"), 2), F.lit(1.0)))
    return told.select(*keys, p.alias("coint_pvalue")).withColumn("coint_score", F.greatest(F.lit(0.0), 1 - F.col("coint_pvalue") / ceiling))


def spread_unit_root(spread: DataFrame, least: int = 20) -> DataFrame:
    """lead, lag, p: the unit-root test of the spread, with a constant; null for fewer rows than ``least`` or a missing value."""
    told = statistics(spread.select(*PAIR, "pos", "s"), list(PAIR), "pos", "s", constant=True)
    return told.select(*PAIR, F.when(F.col("n") >= least, _p_of(F.col("tau"), 1)).alias("p"))


def half_life(spread: DataFrame) -> DataFrame:
    """lead, lag, rho of s on its predecessor, half_life in days within [1, 252]; null where |rho| >= 1."""
    x = spread.withColumn("sp", F.lag("s").over(ordered(PAIR, "pos"))).where("sp is not null")
    r = x.groupBy(*PAIR).agg(F.regr_slope("s", "sp").alias("rho"))
    days = -F.log(F.lit(2.0)) / F.log(F.abs("rho"))
    return r.withColumn("half_life", F.when((F.abs("rho") < 1) & (F.col("rho") != 0), F.greatest(F.lit(1.0), F.least(F.lit(252.0), days))))
