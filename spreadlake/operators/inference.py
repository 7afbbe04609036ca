"""Tests and intervals: exact table tests, slope and correlation tests, seeded bootstraps.

Bootstraps weigh rows with Poisson draws that a hash of (seed, draw, row) makes, so that no draw needs a resampled copy, all
draws are sums that one pass over the rows adds up, and every run gives the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import PRIME, STEPS, mixed, mixed_sql


def crosstab(df: DataFrame, row: Column, col: Column) -> DataFrame:
    """a, b, c, d of the two-by-two table, and the odds ratio."""
    x = df.agg(F.count_if(row & col).alias("a"), F.count_if(row & ~col).alias("b"), F.count_if(~row & col).alias("c"), F.count_if(~row & ~col).alias("d"))
    return x.withColumn("odds", F.col("a") * F.col("d") / F.nullif((F.col("b") * F.col("c")).cast("double"), F.lit(0.0)))


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: the tables with these margins that are no likelier, summed outward from both sides of the likeliest until nothing more is added."""
    n, r, k = a + b + c + d, a + b, a + c
    low, high = max(0, r + k - n), min(r, k)
    ln = lambda m, j: math.lgamma(m + 1) - math.lgamma(j + 1) - math.lgamma(m - j + 1)
    p = lambda x: ln(k, x) + ln(n - k, r - x) - ln(n, r)
    most, mode = p(a) + 1e-7, min(high, max(low, (r + 1) * (k + 1) // (n + 2)))

    def tail(step: int, end: int) -> float:
        """What lies beyond the mode on one side and is no likelier; likelihood falls away from it."""
        near, far = (mode if step < 0 else mode + 1), end
        if (far - near) * step < 0 or p(far) > most:
            return 0.0
        while near != far:  # the first that is no likelier
            mid = near + (far - near) // 2 if step > 0 else near - (near - far) // 2
            if p(mid) <= most:
                far = mid
            else:
                near = mid + step
        total, x = 0.0, near
        while (end - x) * step >= 0:
            term = math.exp(p(x))
            total += term
            if term <= total * 1e-18:
                break
            x += step
        return total

    return min(1.0, tail(-1, low) + tail(1, high))


def fisher_exact(tables: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([fisher_p(*map(int, x)) for x in zip(a, b, c, d, strict=True)])

    return tables.withColumn("p", p("a", "b", "c", "d"))


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t by the incomplete beta function's continued fraction."""
    if df <= 0 or t != t:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a if x > 0 else 0.0
    c, d, h = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d if abs(1 + num * d) > 1e-300 else 1e-300)
            c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return max(0.0, min(1.0, 1 - front * h if flip else front * h))


def _p_value(r: Column, n: Column) -> Column:
    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([t_tail(x * math.sqrt((k - 2) / max(1 - x * x, 1e-300)), k - 2) if x == x and k > 2 else None for x, k in zip(r.astype(float), n, strict=True)], dtype="float64")

    return p(r, n)


def slope_test(df: DataFrame, keys: list[str], x: str, y: Column) -> DataFrame:
    from .panel import safe_corr

    g = df.withColumn("__y", y).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("__y", x).alias("slope"), safe_corr(x, "__y").alias("r"))
    return g.withColumn("p", _p_value(F.col("r"), F.col("n")))


def correlation_test(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    from .panel import safe_corr, spearman

    g = df.groupBy(*keys).agg(F.count("*").alias("n"), safe_corr(x, y).alias("pearson")).join(spearman(df, keys, x, y).drop("n"), keys)
    return g.withColumn("p_pearson", _p_value(F.col("pearson"), F.col("n"))).withColumn("p_spearman", _p_value(F.col("rho"), F.col("n")))


def _poisson_steps() -> list[float]:
    """P(X < k) of a Poisson(1) number for k = 1..8."""
    out, total, p = [], 0.0, math.exp(-1)
    for k in range(1, 9):
        total += p
        out.append(total)
        p /= k
    return out


def poisson_weight(seed: int, draw: Column, key: Column) -> Column:
    """A Poisson(1) number for each draw and integer key, by the seeded order."""
    u = (mixed(seed, draw, key) + 0.5) / float(PRIME)
    out = F.lit(0)
    for k, step in enumerate(_poisson_steps(), 1):
        out = F.when(u > step, F.lit(k)).otherwise(out)
    return out


def poisson_weight_sql(seed: int, draw: str, key: str) -> str:
    """The same in SQL."""
    u = f"(({mixed_sql(seed, draw, key)} + 0.5) / cast({PRIME} as double))"
    steps = " ".join(f"when u > cast({step!r} as double) then {k}" for k, step in reversed(list(enumerate(_poisson_steps(), 1))))
    return f"(select case {steps} else 0 end from (select {u} as u))"


def _weights(seed: int, draws: int, keys: np.ndarray) -> np.ndarray:
    """poisson_weight of every key (rows) in every draw from 1 (columns)."""
    a, b, c = STEPS
    draw = np.arange(1, draws + 1, dtype=np.int64)
    line = ((keys % PRIME)[:, None] * ((draw * a + seed * b + 1) % PRIME) + draw * c + seed) % PRIME
    order = ((line * line) % PRIME * b + line) % PRIME
    return np.searchsorted(np.array(_poisson_steps()), (order + 0.5) / float(PRIME), side="left").astype(np.float64)


AT_ONCE = 2048  # rows whose weights are held at a time
GROUPS = 512  # groups that a task sums at a time


def weighted_sums(df: DataFrame, groups: list[str], sums: dict[str, Column], draws: int, seed: int, key: Column) -> DataFrame:
    """groups, draw, and of each named number its sum over the group's rows in that draw, weighted by ``poisson_weight``; nulls count as 0.

    A task adds its rows to one vector of sums for each group, draws times names long; vectors are added up in pieces and then as a
    whole, so what is shuffled is a row for each group and task, whatever the number of draws.
    """
    kept = df.select(F.struct(*groups, F.lit(0).alias("__")).alias("__g"), key.cast("long").alias("__key"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"__x{i}") for i, c in enumerate(sums.values())])
    columns = list(sums)
    names = [f"__x{i}" for i in range(len(columns))]
    width = len(names) * draws

    def out(g: list, held: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g, type=schema.field("__g").type), pa.array([h.tobytes() for h in held], type=pa.binary())], names=["__g", "__v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            group = batch.column("__g").to_pylist()
            keys = batch.column("__key").to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names])
            of: dict[tuple, int] = {}
            code = np.array([of.setdefault(tuple(g.items()), len(of)) for g in group], dtype=np.int64)
            for at in range(0, len(keys), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                w = _weights(seed, draws, keys[part])
                for g, k in of.items():
                    mine = code[part] == k
                    if mine.any():
                        held[g] = held.get(g, 0.0) + x[:, part][:, mine] @ w[mine]
            if len(held) > GROUPS:
                yield out([dict(g) for g in held], list(held.values()), batch.schema)
                held.clear()
            schema = batch.schema
        if held:
            yield out([dict(g) for g in held], list(held.values()), schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a group follow one another."""
        last, total = None, None
        for batch in batches:
            for g, v in zip(batch.column("__g").to_pylist(), batch.column("__v").to_pylist(), strict=True):
                if g != last:
                    if last is not None:
                        yield out([last], [total], batch.schema)
                    last, total = g, np.zeros(width)
                total = total + np.frombuffer(v)
            schema = batch.schema
        if last is not None:
            yield out([last], [total], schema)

    types = T.StructType([kept.schema["__g"], T.StructField("__v", T.BinaryType())])
    vectors = kept.mapInArrow(add, types)
    for by in ([F.col("__g"), F.pmod(F.xxhash64("__v"), F.lit(64))], [F.col("__g")]):
        vectors = vectors.repartition(*by).sortWithinPartitions("__g").mapInArrow(merge, types)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, v in zip(batch.column("__g"), batch.column("__v").to_pylist(), strict=True):
                m = np.frombuffer(v).reshape(len(names), draws)
                yield pa.RecordBatch.from_arrays([pa.array([g.as_py()] * draws, type=g.type), pa.array(np.arange(1, draws + 1), type=pa.int32()), *map(pa.array, m)], names=["__g", "__draw", *names])

    schema = T.StructType([kept.schema["__g"], T.StructField("__draw", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])
    return vectors.mapInArrow(spread, schema).select(*[F.col("__g")[c].alias(c) for c in groups], F.col("__draw").alias("draw"), *[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)])


def _interval(draws: DataFrame, x: Column) -> DataFrame:
    """mean, low and high of 95 % over a row for each draw."""
    return draws.select(x.alias("x")).agg(F.avg("x").alias("mean"), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))


def bootstrap_rate_gap(df: DataFrame, group: Column, event: Column, draws: int, seed: int, key: str = "obs_id") -> DataFrame:
    """95 % interval of the event's rate in the group less that outside."""
    inside, e = group.cast("double"), event.cast("double")
    sums = weighted_sums(df, [], {"ge": inside * e, "g": inside, "oe": (1 - inside) * e, "o": 1 - inside}, draws, seed, F.col(key))
    rate = lambda n, d: F.col(n) / F.nullif(F.col(d), F.lit(0.0))
    return _interval(sums, rate("ge", "g") - rate("oe", "o"))


def clustered_bootstrap(df: DataFrame, cluster: str, x: str, draws: int, seed: int) -> DataFrame:
    """95 % interval of the mean of x when whole clusters, days or integers, are drawn: clusters are summed first."""
    key = F.datediff(cluster, F.lit("1970-01-01").cast("date")) if dict(df.dtypes)[cluster] == "date" else F.col(cluster)
    clusters = df.groupBy(key.cast("long").alias("__key")).agg(F.sum(x).alias("s"), F.count(x).alias("n"))
    sums = weighted_sums(clusters.where("__key is not null"), [], {"s": F.col("s"), "n": F.col("n")}, draws, seed, F.col("__key"))
    return _interval(sums, F.col("s") / F.nullif(F.col("n"), F.lit(0.0)))
