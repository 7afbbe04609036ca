"""Observations of pairs at scoring days with their forward paths, event policies over a grid, and studies of scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import panel as P
from .events import policy_exit

KEY = ("lead", "lag", "entry")
CATASTROPHE = -100.0  # basis points


def return_arrays(aligned: DataFrame, most: int) -> DataFrame:
    """lead, lag, ret_lead, ret_lag: the last returns of both legs, oldest first; at most so many."""
    r = P.pair_returns(aligned).where("rl is not null").withColumn("k", F.row_number().over(W.partitionBy(*P.PAIR).orderBy(F.desc("day")))).where(F.col("k") <= most)
    path = r.groupBy(*P.PAIR).agg(F.sort_array(F.collect_list(F.struct("day", "rl", "rg"))).alias("p"))
    return path.select(*P.PAIR, F.transform("p", lambda x: x["rl"]).alias("ret_lead"), F.transform("p", lambda x: x["rg"]).alias("ret_lag"))


def corr_of_arrays(obs: DataFrame, window: int, keys=P.PAIR, out: str = "rho") -> DataFrame:
    """keys, rho over the last ``window`` entries; null with fewer."""
    tail = lambda c: F.slice(c, F.greatest(F.size(c) - window + 1, F.lit(1)), window)
    pairs = F.zip_with(tail("ret_lead"), tail("ret_lag"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    x = obs.select(*keys, F.explode(pairs).alias("z")).select(*keys, "z.a", "z.b")
    return x.groupBy(*keys).agg(F.when(F.count("*") >= window, P.safe_corr("a", "b")).alias(out))


def observations(aligned: DataFrame, at: str, lookback: int, window: int, entry: float, exit: float, long: int, short: int) -> DataFrame:
    """Score components of every pair on the last day at or before ``at``, dislocated pairs only; rows after it are never read."""
    pre = aligned.where((F.col("day") <= F.lit(at).cast("date")) & (F.col("day") >= F.date_sub(F.lit(at).cast("date"), lookback)))
    z = P.last_row(P.zscore(pre, window).where("z is not null"), P.PAIR, "day", "z").where(F.abs("z") >= entry)
    return z.join(P.dual_correlation(pre, long, short), [*P.PAIR], "left").withColumn("z_depth", S.z_depth(F.col("z"), entry, exit))


@dataclass(frozen=True)
class Replay:
    """What an observation reads: rows before the entry, the windows, and rows after it."""

    back: int = 104
    window: int = 32
    horizon: int = 40
    exit_z: float = 0.5
    long: int = 90
    short: int = 20
    entry_z: float = 1.5
    least: int = 15  # rows before the entry beyond the window


def entry_rows(aligned: DataFrame, entries: list[int], p: Replay) -> DataFrame:
    """Rows around every entry position, with what the entry freezes: lead, lag, entry, t, day, ll, lg, hedge, s, z, corr.

    The hedge comes from rows up to the entry alone. A row is sent once for each entry that it serves, so nothing is joined.
    """
    serving = F.filter(F.array(*map(F.lit, entries)), lambda e: F.col("pos").between(e - p.back, e + p.horizon))
    x = aligned.select(*P.PAIR, "day", "pos", P.log_floor(F.col("pl")).alias("ll"), P.log_floor(F.col("pg")).alias("lg"), F.explode(serving).alias("entry"))
    x = x.withColumn("t", F.col("pos") - F.col("entry"))
    whole, w = W.partitionBy(*KEY), P.ordered(KEY, "t")
    before = F.col("t") <= 0
    x = x.withColumn("k", F.count_if(before).over(whole)).withColumn("hedge", F.regr_slope(F.when(before, F.col("lg")), F.when(before, F.col("ll"))).over(whole))
    x = x.where(F.col("k") >= p.window + p.least).withColumn("s", F.col("lg") - F.col("hedge") * F.col("ll"))
    x = x.withColumn("rl", F.col("ll") - F.lag("ll").over(w)).withColumn("rg", F.col("lg") - F.lag("lg").over(w))
    roll = P.rows(KEY, "t", p.window - 1)
    z = (F.col("s") - F.avg("s").over(roll)) / F.nullif(F.stddev_samp("s").over(roll), F.lit(0.0))
    recent = P.rows(KEY, "t", p.short - 1)
    sd = F.stddev_samp("rl").over(recent) * F.stddev_samp("rg").over(recent)
    corr = F.covar_samp("rl", "rg").over(recent) / F.nullif(sd, F.lit(0.0))
    return x.withColumn("z", F.when(F.count("s").over(roll) >= p.window, z)).withColumn("corr", F.when(F.count("rl").over(recent) >= p.short, corr))


def replayed(aligned: DataFrame, entries: list[int], p: Replay = Replay()) -> DataFrame:
    """One row for each pair and entry: date, z0, hedge, half_life, corr_long, corr_short, z_depth, ret_lead, ret_lag, and the path after the entry:
    bps, zs, corrs (arrays by t from 0), n, exit_t (first t with |z| <= exit_z, else n) and gross there.

    Components read rows up to the entry, the path only rows after it.
    """
    x = entry_rows(aligned, entries, p)
    x = x.withColumn("sp", F.lag("s").over(P.ordered(KEY, "t")))
    t, at0, fwd = F.col("t"), lambda c: F.max(F.when(F.col("t") == 0, F.col(c))), F.col("t") >= 0

    def corr(n: int) -> Column:
        a, b = (F.when(t.between(1 - n, 0), F.col(c)) for c in ("rl", "rg"))
        return F.when(F.count(a) >= n, F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))

    rho = F.regr_slope(F.when(t <= 0, F.col("s")), F.when(t <= 0, F.col("sp")))
    path = F.sort_array(F.collect_list(F.when(fwd, F.struct("t", "s", F.abs("z").alias("z"), "corr"))))
    past = F.sort_array(F.collect_list(F.when((t <= 0) & F.col("rl").isNotNull(), F.struct("t", "rl", "rg"))))
    g = x.groupBy(*KEY).agg(at0("day").alias("date"), at0("z").alias("z0"), F.max("hedge").alias("hedge"), rho.alias("rho"), corr(p.long).alias("corr_long"), corr(p.short).alias("corr_short"), path.alias("path"), past.alias("past"))
    g = g.withColumn("n", F.size("path") - 1).where("z0 is not null and n >= 1")
    s0 = F.element_at("path", 1)["s"]
    g = g.withColumn("bps", F.transform("path", lambda e: S.forward_bps(F.col("z0"), s0, e["s"], F.col("hedge")))).withColumn("zs", F.transform("path", lambda e: e["z"])).withColumn("corrs", F.transform("path", lambda e: e["corr"]))
    hit = F.array_position(F.transform(F.slice("zs", 2, p.horizon), lambda z: F.coalesce(z <= p.exit_z, F.lit(False))), True)
    g = g.withColumn("exit_t", F.when(hit > 0, hit).otherwise(F.col("n")).cast("int")).withColumn("gross", F.element_at("bps", F.col("exit_t") + 1))
    days = -F.log(F.lit(2.0)) / F.log(F.abs("rho"))
    g = g.withColumn("half_life", F.when((F.abs("rho") < 1) & (F.col("rho") != 0), F.greatest(F.lit(1.0), F.least(F.lit(252.0), days))))
    g = g.withColumn("z_depth", S.z_depth(F.col("z0"), p.entry_z, p.exit_z))
    returns = [F.transform("past", lambda e: e["rl"]).alias("ret_lead"), F.transform("past", lambda e: e["rg"]).alias("ret_lag")]
    return g.select(*KEY, "date", "z0", "hedge", "half_life", "corr_long", "corr_short", "z_depth", *returns, "bps", "zs", "corrs", "n", "exit_t", "gross")


def verified(obs: DataFrame, stored: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Observations whose stored outcome (keys, forward_gross) the replay meets within so many basis points."""
    return obs.join(stored, [*KEY]).where(F.abs(F.col("gross") - F.col("forward_gross")) <= tolerance)


def with_event_days(obs: DataFrame, aligned: DataFrame, events: DataFrame, entries: list[int], horizon: int) -> DataFrame:
    """Adds next_results_t and surprise_t: trading days from the entry to the first such event on either leg, null beyond the path.

    events: symbol, day, results, surprise. An event falls on the pair's first trading day at or after it (an as-of join by pair).
    """
    from .asof import asof
    from .intervals import points_in_windows

    # Only events within some entry's span count: those are met by blocks of days, not all events of a leg.
    spanned = F.explode(F.filter(F.array(*map(F.lit, entries)), lambda e: (F.col("pos") >= e) & (F.col("pos") <= e + horizon))).alias("entry")
    spans = aligned.select(*P.PAIR, "day", "pos", spanned).groupBy(*KEY).agg(F.max(F.when(F.col("pos") == F.col("entry"), F.unix_date("day"))).alias("low"), F.max(F.unix_date("day")).alias("high"))
    legs = spans.join(obs.select(*KEY).distinct(), [*KEY], "left_semi").select(*P.PAIR, "low", "high", F.explode(F.array_distinct(F.array("lead", "lag"))).alias("symbol"))
    told = events.groupBy("symbol", "day").agg(F.bool_or("results").alias("results"), F.bool_or("surprise").alias("surprise"))
    met = points_in_windows(told, F.unix_date("day"), legs, F.col("low") + 1, F.col("high"), ["symbol"])
    dated = met.groupBy(*P.PAIR, F.col("day").alias("event_day")).agg(F.bool_or("results").alias("results"), F.bool_or("surprise").alias("surprise"))
    on = asof(dated, aligned.select(*P.PAIR, "day", "pos"), list(P.PAIR), "event_day", "day", forward=True).where("pos is not null")
    serving = F.filter(F.array(*map(F.lit, entries)), lambda e: (F.col("pos") > e) & (F.col("pos") <= e + horizon))
    each = on.select(*P.PAIR, "pos", "results", "surprise", F.explode(serving).alias("entry")).withColumn("t", F.col("pos") - F.col("entry"))
    first = each.groupBy(*KEY).agg(F.min(F.when(F.col("results"), F.col("t"))).alias("next_results_t"), F.min(F.when(F.col("surprise"), F.col("t"))).alias("surprise_t"))
    kept = [F.when(F.col(c) <= F.col("n"), F.col(c)).alias(c) for c in ("next_results_t", "surprise_t")]
    return obs.join(first, [*KEY], "left").select(*obs.columns, *kept)


def policies(obs: DataFrame, holds, leads, reacts=(False, True)) -> DataFrame:
    """A row for each observation and policy (h, l, r): traded, pol (basis points on the path at the policy's exit, null without a trade), base."""
    parts = []
    for h in holds:
        for ahead in leads:
            for r in reacts:
                traded, t = policy_exit(F.col("exit_t"), F.col("next_results_t"), F.col("surprise_t"), F.col("n"), h, ahead, r)
                parts.append(F.struct(F.lit(h).alias("h"), F.lit(ahead).alias("l"), F.lit(r).alias("r"), traded.alias("traded"), F.when(traded, F.element_at("bps", t.cast("int") + 1)).alias("pol")))
    kept = [c for c in obs.columns if c not in ("bps", "zs", "corrs", "ret_lead", "ret_lag")]
    return obs.select(*kept, F.col("gross").alias("base"), F.explode(F.array(*parts)).alias("c")).select(*kept, "base", "c.*")


SUMS = ("n", "n_traded", "s", "s_base", "cat", "cat_base", "n_cat")


def policy_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and sums from which every metric follows; sums of groups add up."""
    pol, base = F.col("pol"), F.col("base")
    zero = F.lit(0.0)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("traded").alias("n_traded"), F.coalesce(F.sum("pol"), zero).alias("s"), F.sum(base).alias("s_base"),
        F.coalesce(F.sum(F.when(pol < CATASTROPHE, pol)), zero).alias("cat"), F.coalesce(F.sum(F.when(base < CATASTROPHE, base)), zero).alias("cat_base"), F.count_if(pol < CATASTROPHE).alias("n_cat"),
    )


def policy_metrics(sums: DataFrame) -> DataFrame:
    """Adds mean, base_mean, loss_cut (share of the catastrophic loss that is avoided; 1 if there was none) and excluded."""
    cut = 1 - F.coalesce(F.col("cat") / F.nullif(F.col("cat_base"), F.lit(0.0)), F.lit(0.0))
    return sums.select("*", (F.col("s") / F.nullif(F.col("n_traded"), F.lit(0))).alias("mean"), (F.col("s_base") / F.col("n")).alias("base_mean"), cut.alias("loss_cut"), (1 - F.col("n_traded") / F.col("n")).alias("excluded"))


def select_policy(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The policy with the greatest mean among those that cut half of the catastrophic loss, or among all if none does; ties to the least exclusion, then in grid order. For each of the keys."""
    order = [F.desc(F.col("loss_cut") >= 0.5), F.desc(F.round("mean", 9)), F.round("excluded", 9), "h", "l", "r"]
    if not keys:
        return metrics.orderBy(*order).limit(1)
    return metrics.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def dropped_one(rows: DataFrame, group: str) -> DataFrame:
    """The policy that is selected without each value of the group: totals less the value's sums, no pass over the rows for each."""
    own = policy_sums(rows, [group, "h", "l", "r"])
    w = W.partitionBy("h", "l", "r")
    rest = own.select(group, "h", "l", "r", *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in SUMS])
    return select_policy(policy_metrics(rest.where("n > 0")), [group])


def shifted_calendar_null(obs: DataFrame, chosen: DataFrame, draws: int, seed: int, horizon: int, most: int = 120) -> DataFrame:
    """real (gain in mean of the chosen policy), null_p90 over calendars shifted by a seeded number of days for each symbol, passed.

    An observation's events move by the lesser offset of its legs; those moved out of the horizon vanish. chosen: h, l, r, one row.
    """
    number = lambda leg: F.conv(F.substring(F.md5(leg), 1, 7), 16, 10).cast("long")  # noqa: E731  of a symbol, however it is spelt
    off = lambda leg: F.pmod(S.mixed(seed, F.col("draw"), number(leg)), F.lit(2 * most + 1)) - most
    policy = chosen.select("h", "l", "r")
    x = obs.drop("zs", "corrs", "ret_lead", "ret_lag").join(F.broadcast(policy), F.col("n") >= 0)  # one row
    each = x.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))  # 0: as it was
    shift = F.when(F.col("draw") > 0, F.least(off("lead"), off("lag"))).otherwise(0)
    for c in ("next_results_t", "surprise_t"):
        each = each.withColumn(c, F.col(c) + shift).withColumn(c, F.when(F.col(c).between(1, horizon), F.col(c)))
    traded, calm = policy_exit(F.col("exit_t"), F.col("next_results_t"), F.col("surprise_t"), F.col("n"), F.col("h"), F.col("l"), False)
    _, react = policy_exit(F.col("exit_t"), F.col("next_results_t"), F.col("surprise_t"), F.col("n"), F.col("h"), F.col("l"), True)
    t = F.when(F.col("r"), react).otherwise(calm)
    deltas = each.select("draw", "gross", F.when(traded, F.element_at("bps", t.cast("int") + 1)).alias("pol")).groupBy("draw").agg((F.avg("pol") - F.avg("gross")).alias("d"))
    out = deltas.agg(F.max(F.when(F.col("draw") == 0, F.col("d"))).alias("real"), F.percentile(F.when(F.col("draw") > 0, F.col("d")), 0.9).alias("null_p90"))  # a row for each draw
    return out.withColumn("passed", F.col("real") > F.col("null_p90"))


def book_of(obs: DataFrame, k: int, weights: tuple[float, float, float] = (0.3, 0.5, 0.2)) -> DataFrame:
    """The k best observations of each entry by the composite score."""
    score = S.composite_score(F.col("corr_long"), F.col("corr_short"), F.col("z_depth"), *weights)
    return P.top_k(obs.withColumn("score", F.round(score, 9)), ["entry"], k, F.desc("score"), "lead", "lag").drop("rank")


def window_study(obs: DataFrame, points: list[dict], k: int, fold: Column) -> DataFrame:
    """trial, objective: half the mean and half the worst of the folds' mean outcome of each entry's k best, for weights and correlation windows.

    points: corr_window_long, corr_window_short, w_corr_long, w_corr_short, w_z_depth. Correlations are computed once for each window that any trial names.
    """
    windows = sorted({p[w] for p in points for w in ("corr_window_long", "corr_window_short")})
    pairs = F.zip_with("ret_lead", "ret_lag", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    back = obs.select(*KEY, F.posexplode(F.reverse(pairs)).alias("i", "z")).select(*KEY, "i", "z.a", "z.b")
    served = back.withColumn("window", F.explode(F.filter(F.array(*map(F.lit, windows)), lambda w: F.col("i") < w)))
    rho = served.groupBy(*KEY, "window").agg(F.when(F.count("*") >= F.col("window"), P.safe_corr("a", "b")).alias("rho"))
    by_window = rho.where("rho is not null").groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("window", "rho"))).alias("rhos"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("trial"), *[F.lit(v).alias(c) for c, v in p.items()]) for i, p in enumerate(points)]))
    x = obs.select(*KEY, "z_depth", "gross", fold.alias("fold")).join(by_window, [*KEY], "left").select("*", grid.alias("p")).select(*KEY, "fold", "gross", "z_depth", "rhos", "p.*")
    part = lambda w: S.clip(F.coalesce(F.try_element_at("rhos", F.col(w)), F.lit(0.0)), 0.0, 1.0)
    score = F.col("w_corr_long") * part("corr_window_long") + F.col("w_corr_short") * part("corr_window_short") + F.col("w_z_depth") * F.col("z_depth")
    top = P.top_k(x.withColumn("score", F.round(score, 9)), ["trial", "entry"], k, F.desc("score"), "lead", "lag")
    days = top.groupBy("trial", "fold", "entry").agg(F.avg("gross").alias("m"))
    folds = days.groupBy("trial", "fold").agg(F.avg("m").alias("m"))
    return folds.groupBy("trial").agg((0.5 * F.avg("m") + 0.5 * F.min("m")).alias("objective"))


