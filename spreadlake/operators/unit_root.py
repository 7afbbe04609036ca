"""Unit-root tests of many series from moments: lagged products are summed in one aggregation, the regressions of every lag follow from the sums.

A series is its group's rows in order.  Row r has the difference D(r) = s(r) - s(r-1); the regression with p lags is of D(r) on s(r-1) and
D(r-1)..D(r-p), with or without a constant, over r >= p + 2.  The number of lags is the one of least information criterion, all compared on
the rows that the most lags allow.  Sums of D(r) D(r-k) and s(r-1) D(r-k) for k up to the most lags are all that the whole series is
needed for: products of two lagged differences are those of an earlier row, but for the first and last differences, which are kept.
One factorisation of the sums gives the residuals of all nested regressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def most_lags(n: Column, constant: bool) -> Column:
    """The most lags that a series of n values is tested with; below 0: none, and the level alone."""
    return F.least(F.ceil(12 * F.pow(n / 100.0, F.lit(0.25))), F.floor(n / 2) - 2 - int(constant)).cast("int")


def moments(series: DataFrame, keys: list[str], pos: str, s: str, constant: bool) -> DataFrame:
    """keys, n, most, and the sums and end values that ``statistics`` works from. With a constant, levels are counted from the first one."""
    whole, step = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(pos)
    rows = series.select(*keys, F.col(s).cast("double").alias("s"), F.row_number().over(step).alias("r"), F.count(F.lit(1)).over(whole).alias("n"), F.first(F.col(s).cast("double")).over(step).alias("s1"), pos)
    if constant:
        rows = rows.withColumn("s", F.col("s") - F.col("s1"))
    rows = rows.withColumn("most", F.greatest(most_lags(F.col("n"), constant), F.lit(0)))
    most = rows.agg(F.max("most")).first()[0] or 0  # grows with the fourth root of the longest series
    rows = rows.withColumn("level", F.lag("s").over(step)).withColumn("d", F.col("s") - F.col("level"))
    rows = rows.withColumns({f"d{k}": F.lag("d", k).over(step) for k in range(1, most + 1)} | {"d0": F.col("d")})
    common = F.col("r") >= F.col("most") + 2
    part = lambda x: F.coalesce(F.sum(F.when(common, x)), F.lit(0.0))
    ends = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("r", "d")))), lambda x: x["d"])  # noqa: E731  as many as lags
    return rows.groupBy(*keys).agg(
        F.bool_and(F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") < math.inf)).alias("whole"), F.max("n").alias("n"), F.max("most").alias("most"), F.max(F.when(F.col("r") == 1, F.col("s"))).alias("first"),
        F.array(*[part(F.col("d0") * F.col(f"d{k}")) for k in range(most + 1)]).alias("dd"), F.array(*[part(F.col("level") * F.col(f"d{k}")) for k in range(most + 1)]).alias("sd"),
        part(F.col("level") ** 2).alias("ss"), part(F.col("level")).alias("sum_s"), part(F.col("d0")).alias("sum_d"),
        ends((F.col("r") >= 2) & (F.col("r") <= F.col("most") + 1)).alias("head"), ends((F.col("r") >= 2) & (F.col("r") > F.col("n") - F.col("most"))).alias("tail"),
    )


def _products(n: int, most: int, first: float, dd, sd, ss: float, sum_s: float, sum_d: float, head, tail) -> np.ndarray:
    """The sums of products over rows r >= most + 2 of (D(r), .., D(r - most), s(r - 1), 1)."""
    k = most + 1
    m = np.zeros((k + 2, k + 2))
    m[0, :k] = dd[:k]
    m[k, :k] = sd[:k]
    m[k, k], m[k, k + 1], m[0, k + 1], m[k + 1, k + 1] = ss, sum_s, sum_d, max(n - 1 - most, 0)
    for i in range(most):  # D(r - i - 1) is D(r - i) a row earlier: one more at the beginning, one less at the end
        begin, end = head[most - 1 - i], tail[most - 1 - i]
        m[i + 1, k + 1] = m[i, k + 1] + begin - end
        for j in range(i, most):
            m[i + 1, j + 1] = m[i, j] + begin * head[most - 1 - j] - end * tail[most - 1 - j]
    m[:k, :k] = np.triu(m[:k, :k]) + np.triu(m[:k, :k], 1).T
    m[:k, k] = m[k, :k]
    m[k + 1, :] = m[:, k + 1]
    return m


def _longer(m: np.ndarray, lags: int, most: int, first: float, head) -> np.ndarray:
    """The same sums, of fewer lags, over rows r >= lags + 2."""
    take = [*range(lags + 1), most + 1, most + 2]
    out = m[np.ix_(take, take)].copy()
    levels = first + np.concatenate([[0.0], np.cumsum(head)])  # s(1)..s(most + 1)
    for r in range(lags + 2, most + 2):
        v = np.array([*(head[r - 2 - i] for i in range(lags + 1)), levels[r - 2], 1.0])
        out += np.outer(v, v)
    return out


def _explained(m: np.ndarray, y: int, order: list[int]) -> np.ndarray:
    """What each column, after those before it, explains of y: the parts of y along them. A column that is a sum of those before it explains nothing."""
    a = m[np.ix_([*order, y], [*order, y])].copy()
    scale, z = np.maximum(np.diag(a), 1e-300), []
    for i in range(len(order)):
        if a[i, i] <= 1e-13 * scale[i]:
            z.append(0.0)
            continue
        z.append(a[i, -1] / math.sqrt(a[i, i]))
        a[i + 1 :, i + 1 :] -= np.outer(a[i + 1 :, i], a[i, i + 1 :]) / a[i, i]
    return np.array(z)


def statistic(constant: bool, n: int, most: int, *sums) -> tuple[int, float]:
    """(lags, t-value of the level)."""
    if n < 2:
        return 0, float("-inf")
    m, head = _products(n, most, *sums), sums[-2]
    level, one = most + 1, most + 2
    lags = 0
    if n // 2 - 2 - constant >= 0:
        rows = n - 1 - most
        z = _explained(m, 0, [*([one] if constant else []), level, *range(1, most + 1)])
        left = m[0, 0] - np.concatenate([[0.0], np.cumsum(z**2)])[1 + constant :]
        lags = int(np.argmin(rows * np.log(np.maximum(left, 1e-300) / rows) + 2 * (np.arange(most + 1) + 1 + constant)))
    m = _longer(m, lags, most, sums[0], head)
    order = [*range(1, lags + 1), *([lags + 2] if constant else []), lags + 1]
    z = _explained(m, 0, order)
    ssr = max(m[0, 0] - float((z**2).sum()), 0.0)
    ssr = 0.0 if ssr <= 1e-14 * m[0, 0] else ssr
    se = math.sqrt(ssr / max(n - 1 - lags - len(order), 1))
    return lags, float(z[-1] / se) if se > 0 else float("-inf")


SUMS = ("n", "most", "first", "dd", "sd", "ss", "sum_s", "sum_d", "head", "tail")


def statistics(series: DataFrame, keys: list[str], pos: str, s: str, constant: bool) -> DataFrame:
    """keys, n, lags, tau: the t-value of the level for each series of finite values; tau is null where a value is missing or not finite."""
    from pyspark.sql import types as T

    sums = moments(series, keys, pos, s, constant)
    schema = T.StructType([*(sums.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("lags", T.IntegerType()), T.StructField("tau", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for whole, *x in zip(b["whole"], *(b[c] for c in SUMS), strict=True):
                found.append(statistic(constant, *x) if whole else (None, None))
            yield pd.DataFrame({**{k: b[k] for k in keys}, "n": b["n"], "lags": pd.array([f[0] for f in found], dtype="Int32"), "tau": pd.array([f[1] for f in found], dtype="Float64")})

    return sums.mapInPandas(run, schema)
