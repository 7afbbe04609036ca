"""Strategy simulations over (pair x parameters), as windows over aligned rows; every grid point is a group, none a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .panel import PAIR, ordered, rows, spread


def grid(df: DataFrame, points: list[dict]) -> DataFrame:
    """Every row with every point of a small grid, and the point's number, in grid order."""
    return df.withColumn("__p", F.explode(F.array(*[F.struct(F.lit(i).alias("point"), *[F.lit(v).alias(k) for k, v in p.items()]) for i, p in enumerate(points)]))).select("*", "__p.*").drop("__p")


def hysteresis(z: Column, enter: Column, leave: Column, w) -> Column:
    """1 from z < -enter until z > -leave or a missing z: the last row that decides."""
    event = F.when(z.isNull() | F.isnan(z), 0).when(z < -enter, 1).when(z > -leave, 0)
    return F.coalesce(F.last(event, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))


def performance(df: DataFrame, keys: list[str], year: float = 252.0, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Of rows (keys, pos, pg, held: today's position): total_return, sharpe, max_drawdown, num_trades, win_rate, avg_holding_days.

    A trade begins where the position rises and ends at the next fall; edges alternate, so the fall is the edge after.
    extra: more aggregates of the same rows, in the same pass.
    """
    w = ordered(keys, "pos")
    x = df.withColumn("day_ret", F.coalesce(F.col("pg") / F.lag("pg").over(w) - 1, F.lit(0.0))).withColumn("r", F.col("held") * F.col("day_ret"))
    x = x.withColumn("eq", F.exp(F.sum(F.log1p("r")).over(w.rowsBetween(W.unboundedPreceding, 0)))).withColumn("edge", F.col("held") - F.lag("held").over(w))
    x = x.withColumn("dd", F.col("eq") / F.max("eq").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    nxt = lambda c: F.first(F.when(F.col("edge") == -1, F.col(c)), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    x = x.withColumn("out_pos", F.when(F.col("edge") == 1, nxt("pos"))).withColumn("out_pg", F.when(F.col("edge") == 1, nxt("pg")))
    done = F.col("out_pos").isNotNull()
    sd = F.stddev_samp("r")
    return x.groupBy(*keys).agg(
        (F.exp(F.sum(F.log1p("r"))) - 1).alias("total_return"), F.when(sd > 0, F.avg("r") / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.lit(year))).alias("sharpe"), F.min("dd").alias("max_drawdown"),
        F.count_if(done).alias("num_trades"), F.avg(F.when(done, F.when(F.col("out_pg") > F.col("pg"), 1.0).otherwise(0.0))).alias("win_rate"), F.avg(F.when(done, F.col("out_pos") - F.col("pos"))).alias("avg_holding_days"),
        *extra,
    )


def ma_switch(aligned: DataFrame, points: list[dict]) -> DataFrame:
    """The lag symbol is held while the lead's short mean, shifted by ``shift`` days, was above its long mean the day before. points: shift, short, long.

    One pass for all points: a row for each shift carries the means of every length, then a row for each point its signal.
    """
    if any(p["short"] >= p["long"] for p in points):
        raise ValueError("the short mean must be shorter than the long one")
    w = ordered(PAIR, "pos")
    shifts = sorted({p["shift"] for p in points})
    x = aligned.select(*PAIR, "pos", "pg", F.array(*[F.struct(F.lit(k).alias("shift"), F.lag("pl", k).over(w).alias("x")) for k in shifts]).alias("s"))
    x = x.select(*PAIR, "pos", "pg", F.explode("s").alias("s")).select(*PAIR, "pos", "pg", "s.*")
    by = [*PAIR, "shift"]
    lengths = sorted({p[c] for p in points for c in ("short", "long")})
    means = [F.when(F.count("x").over(rows(by, "pos", n - 1)) >= n, F.avg("x").over(rows(by, "pos", n - 1))).alias(f"m{n}") for n in lengths]
    x = x.select("*", *means)
    signal = lambda p: F.coalesce((F.col(f"m{p['short']}") > F.col(f"m{p['long']}")).cast("int"), F.lit(0))
    each = [F.when(F.col("shift") == p["shift"], F.struct(F.lit(i).alias("point"), F.lit(p["short"]).alias("short"), F.lit(p["long"]).alias("long"), signal(p).alias("sig"))) for i, p in enumerate(points)]
    x = x.select(*PAIR, "pos", "pg", "shift", F.explode(F.array_compact(F.array(*each))).alias("p")).select(*PAIR, "pos", "pg", "shift", "p.*")
    keys = [*PAIR, "point", "shift", "short", "long"]
    return performance(x.withColumn("held", F.coalesce(F.lag("sig").over(ordered(keys, "pos")), F.lit(0))), keys)


def z_strategy(aligned: DataFrame, points: list[dict]) -> DataFrame:
    """The lag symbol is held from z < -entry until z > -exit, a day later. points: window, entry, exit. Also days_to_first_signal.

    One pass for all points: the spread is taken once, its z for every window beside it.
    """
    windows = sorted({p["window"] for p in points})
    x = spread(aligned)
    each = []
    for n in windows:
        w = rows(PAIR, "day", n - 1)
        each.append(F.when(F.count("s").over(w) >= n, (F.col("s") - F.avg("s").over(w)) / F.nullif(F.stddev_samp("s").over(w), F.lit(0.0))).alias(f"z{n}"))
    x = x.select(*PAIR, "pos", "pg", *each)
    parts = [F.struct(F.lit(i).alias("point"), F.lit(p["window"]).alias("window"), F.lit(float(p["entry"])).alias("entry"), F.lit(float(p["exit"])).alias("exit"), F.col(f"z{p['window']}").alias("z")) for i, p in enumerate(points)]
    x = x.select(*PAIR, "pos", "pg", F.explode(F.array(*parts)).alias("p")).select(*PAIR, "pos", "pg", "p.*")
    keys = [*PAIR, "point", "window", "entry", "exit"]
    w = ordered(keys, "pos")
    x = x.withColumn("sig", hysteresis(F.col("z"), F.col("entry"), F.col("exit"), w)).withColumn("held", F.coalesce(F.lag("sig").over(w), F.lit(0)))
    first = F.coalesce(F.min(F.when(F.col("z") < -F.col("entry"), F.col("pos"))), F.lit(0)).alias("days_to_first_signal")
    return performance(x, keys, extra=(first,))


def best_point(results: DataFrame, by: str = "total_return", digits: int = 9) -> DataFrame:
    """The pair's best grid point; the first in grid order on ties."""
    w = W.partitionBy(*PAIR).orderBy(F.desc(F.round(F.coalesce(by, F.lit(float("-inf"))), digits)), "point")
    return results.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def with_holdout(aligned: DataFrame, points: list[dict], share: float = 0.67, least: tuple[int, int] = (30, 10)) -> DataFrame:
    """lead, lag, point, train_return, num_trades, holdout_return, holdout_days: the train part's best point, tried on the rest.

    The return is -1 and the days are 0 when rows or the train result don't suffice; without enough rows there is no point either.
    """
    n = F.count(F.lit(1)).over(W.partitionBy(*PAIR))
    x = aligned.withColumn("cut", F.floor(n * F.lit(share))).withColumn("n", n)
    enough = (F.col("cut") >= least[0]) & (F.col("n") - F.col("cut") >= least[1])
    few = x.where(~enough).select(*PAIR).distinct().select(*PAIR, F.lit(None).cast("int").alias("point"), F.lit(0.0).alias("train_return"), F.lit(0).cast("long").alias("num_trades"), F.lit(-1.0).alias("holdout_return"), F.lit(0).cast("int").alias("holdout_days"))
    x = x.where(enough)
    train = best_point(z_strategy(x.where("pos < cut"), points)).select(*PAIR, "point", F.col("total_return").alias("train_return"), "num_trades")
    test = z_strategy(x.where("pos >= cut").withColumn("pos", F.col("pos") - F.col("cut")), points).select(*PAIR, "point", F.col("total_return").alias("t"), F.col("days_to_first_signal").alias("d"))
    passed = (F.col("train_return") > 0) & (F.col("num_trades") >= 2)
    both = train.join(test, [*PAIR, "point"], "left")
    both = both.withColumn("holdout_return", F.when(passed, F.col("t")).otherwise(-1.0)).withColumn("holdout_days", F.when(passed, F.col("d")).otherwise(0).cast("int"))
    return both.select(*few.columns).unionByName(few)
