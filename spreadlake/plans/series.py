"""Windows and series, simulations and replay."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import panel as P
from ..operators.ranks import quantiles
from ..operators import replay as R
from ..operators import simulate as X
from ..registry import query
from .aggregates import ALIGNED, RETURNS, aligned

BY = "window w as (partition by symbol order by day)"


@query("win_01_log_return", f"select symbol, day, R(ln(greatest(close, 1e-9)) - lag(ln(greatest(close, 1e-9))) over w) as ret from prices {BY}")
def _(t):
    return P.log_returns(t.prices).select("symbol", "day", "ret")


@query("win_02_simple_return", f"select symbol, day, R(close / lag(close, 20) over w - 1) as ret from prices {BY}")
def _(t):
    return P.simple_returns(t.prices, 20).select("symbol", "day", "ret")


@query("win_03_lag_nullif", f"select symbol, day, R(volume / nullif(cast(lag(volume) over w as double), 0)) as x from prices {BY}")
def _(t):
    return t.prices.select("symbol", "day", (F.col("volume") / F.nullif(F.lag("volume").over(P.ordered(["symbol"], "day")).cast("double"), F.lit(0.0))).alias("x"))


FRAME = "over (partition by symbol order by day rows between {n} preceding and current row)"


@query("win_04_rolling_mean", f"select symbol, day, R(case when count(close) {FRAME.format(n=9)} >= 10 then avg(close) {FRAME.format(n=9)} end) as m10, R(avg(close) {FRAME.format(n=4)}) as m5 from prices")
def _(t):
    return P.rolling(P.rolling(t.prices, ["symbol"], "day", "close", 10, "m10"), ["symbol"], "day", "close", 5, "m5", min_periods=1).select("symbol", "day", "m10", "m5")


@query("win_05_rolling_vol", f"with r as (select symbol, day, ln(close) - lag(ln(close)) over (partition by symbol order by day) as ret from prices) select symbol, day, R(case when count(ret) {FRAME.format(n=19)} >= 20 then stddev_samp(ret) {FRAME.format(n=19)} * sqrt(252) end) as vol from r")
def _(t):
    return P.rolling(P.log_returns(t.prices), ["symbol"], "day", "ret", 20, "v", F.stddev_samp).select("symbol", "day", (F.col("v") * F.sqrt(F.lit(252.0))).alias("vol"))


PW = "over (partition by lead, lag order by day rows between {n} preceding and current row)"
SPREAD = f"{ALIGNED}, hd as (select lead, lag, regr_slope(ln(pg), ln(pl)) as hedge from al group by lead, lag), sp as (select al.*, hedge, ln(pg) - hedge * ln(pl) as s from al join hd using (lead, lag))"
ZS = f"{SPREAD}, zs as (select *, case when count(s) {PW.format(n=19)} >= 20 then (s - avg(s) {PW.format(n=19)}) / nullif(stddev_samp(s) {PW.format(n=19)}, 0) end as z from sp)"


@query("win_06_spread_z", f"with {ZS} select lead, lag, day, R(z) as z from zs")
def _(t):
    return P.zscore(aligned(t), 20).select("lead", "lag", "day", "z")


@query("win_07_rolling_corr", f"with {RETURNS} select lead, lag, day, R(case when count(rl) {PW.format(n=29)} >= 30 then corr(rl, rg) {PW.format(n=29)} end) as rho from rt")
def _(t):
    w = P.rows(P.PAIR, "day", 29)
    return P.pair_returns(aligned(t)).select("lead", "lag", "day", F.when(F.count("rl").over(w) >= 30, F.corr("rl", "rg").over(w)).alias("rho"))


@query("win_08_rolling_beta", f"with {RETURNS} select lead, lag, day, R(case when count(rl) over f >= 20 then covar_samp(rg, rl) over f / nullif(var_samp(rl) over f, 0) end) as beta from rt window f as (partition by lead, lag order by day rows between 20 preceding and 1 preceding)")
def _(t):
    w = P.ordered(P.PAIR, "day").rowsBetween(-20, -1)
    sd = F.stddev_samp("rl").over(w)
    return P.pair_returns(aligned(t)).select("lead", "lag", "day", F.when((F.count("rl").over(w) >= 20) & (sd > 1e-9), F.covar_samp("rg", "rl").over(w) / F.nullif(F.var_samp("rl").over(w), F.lit(0.0))).alias("beta"))


@query("win_09_rank_bins", "select N(obs_id) as obs_id, greatest(cast(ceil((row_number() over (partition by fold order by gross, obs_id) - 1) * 5 / cast(greatest(count(*) over (partition by fold) - 1, 1) as double)) as int) - 1, 0) as bin from observations")
def _(t):
    return P.quantile_bin(t.observations.select("fold", "obs_id", "gross"), ["fold"], "gross", "obs_id", 5).select("obs_id", "bin")


@query("win_10_value_bins", "with e as (select list_sort(list_distinct(list_value(min(z_depth), quantile_cont(z_depth, 0.25), quantile_cont(z_depth, 0.5), quantile_cont(z_depth, 0.75), max(z_depth)))) as e from observations) select N(obs_id) as obs_id, cast(greatest(1, len(list_filter(e, lambda x: x < z_depth))) as int) - 1 as bin from observations, e")
def _(t):
    cuts = quantiles(t.observations, [], "z_depth", {f"q{i}": i / 4 for i in range(5)})
    edges = cuts.select(F.array_sort(F.array_distinct(F.array(*cuts.columns))).alias("e"))
    x = t.observations.join(F.broadcast(edges), F.col("z_depth").isNotNull())  # one row of edges
    return x.select("obs_id", (F.greatest(F.lit(1), F.size(F.filter("e", lambda v: v < F.col("z_depth")))) - 1).alias("bin"))


@query("win_11_top_k", "select fold, N(obs_id) as obs_id, rank from (select *, cast(row_number() over (partition by fold order by corr_long desc, obs_id) as int) as rank from observations) where rank <= 20")
def _(t):
    return P.top_k(t.observations, ["fold"], 20, F.desc("corr_long"), "obs_id").select("fold", "obs_id", "rank")


EQ = "with r as (select symbol, day, coalesce(close / lag(close) over (partition by symbol order by day) - 1, 0) as r from prices), q as (select symbol, day, exp(sum(ln(1 + r)) over (partition by symbol order by day rows unbounded preceding)) as eq from r)"


def _equity(t):
    w = P.ordered(["symbol"], "day").rowsBetween(W.unboundedPreceding, 0)
    return P.simple_returns(t.prices).withColumn("eq", F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(w)))


@query("win_12_equity", f"{EQ} select symbol, day, R(eq) as eq from q")
def _(t):
    return _equity(t).select("symbol", "day", "eq")


@query("win_13_drawdown", f"{EQ} select symbol, day, R(eq / max(eq) over (partition by symbol order by day rows unbounded preceding) - 1) as dd from q")
def _(t):
    w = P.ordered(["symbol"], "day").rowsBetween(W.unboundedPreceding, 0)
    return _equity(t).select("symbol", "day", (F.col("eq") / F.max("eq").over(w) - 1).alias("dd"))


STATE = f"{ZS}, ev as (select *, case when z is null then 0 when z < -1.5 then 1 when z > -0.5 then 0 end as e from zs), st as (select *, coalesce(last_value(e ignore nulls) over (partition by lead, lag order by pos rows unbounded preceding), 0) as sig from ev), hl as (select *, coalesce(lag(sig) over (partition by lead, lag order by pos), 0) as held from st)"


def _state(t):
    w = P.ordered(P.PAIR, "pos")
    x = P.zscore(aligned(t), 20).withColumn("sig", X.hysteresis(F.col("z"), F.lit(1.5), F.lit(0.5), w))
    return x.withColumn("held", F.coalesce(F.lag("sig").over(w), F.lit(0)))


@query("win_14_lagged_position", f"with {STATE} select lead, lag, day, held from hl")
def _(t):
    return _state(t).select("lead", "lag", "day", "held")


@query("win_15_edges", f"with {STATE}, g as (select *, held - lag(held) over (partition by lead, lag order by pos) as edge from hl) select lead, lag, day, edge from g where edge <> 0")
def _(t):
    x = _state(t).withColumn("edge", F.col("held") - F.lag("held").over(P.ordered(P.PAIR, "pos")))
    return x.where("edge <> 0").select("lead", "lag", "day", "edge")


@query("win_16_entry_exit", f"with {STATE}, g as (select *, held - lag(held) over (partition by lead, lag order by pos) as edge from hl), m as (select *, lead(pos) over (partition by lead, lag order by pos) as nxt from g where edge <> 0) select lead, lag, N(pos) as entry, N(nxt) as exit from m where edge = 1 and nxt is not null")
def _(t):
    w = P.ordered(P.PAIR, "pos")
    x = _state(t).withColumn("edge", F.col("held") - F.lag("held").over(w)).where("edge <> 0").withColumn("nxt", F.lead("pos").over(w))
    return x.where("edge = 1 and nxt is not null").select("lead", "lag", F.col("pos").cast("long").alias("entry"), F.col("nxt").cast("long").alias("exit"))


@query("win_17_hysteresis", f"with {STATE} select lead, lag, day, sig from st")
def _(t):
    return _state(t).select("lead", "lag", "day", "sig")


@query("win_18_first_signal", f"with {ZS} select lead, lag, N(coalesce(min(case when z < -1.5 then pos end), 0)) as first_pos from zs group by lead, lag")
def _(t):
    return P.zscore(aligned(t), 20).groupBy("lead", "lag").agg(F.coalesce(F.min(F.when(F.col("z") < -1.5, F.col("pos"))), F.lit(0)).cast("long").alias("first_pos"))


@query("win_19_forward_fill", "with g as (select s.symbol, d.day from (select distinct symbol from prices) s, (select distinct day from prices) d) select g.symbol, g.day, R(last_value(p.close ignore nulls) over (partition by g.symbol order by g.day rows unbounded preceding)) as close from g left join (select * from prices where volume > 60) p on p.symbol = g.symbol and p.day = g.day")
def _(t):
    days = t.prices.agg(F.collect_set("day").alias("days"))  # a calendar: one row
    full = t.prices.select("symbol").distinct().join(F.broadcast(days), F.col("symbol").isNotNull()).select("symbol", F.explode("days").alias("day"))
    x = full.join(t.prices.where("volume > 60").select("symbol", "day", "close"), ["symbol", "day"], "left")
    return x.withColumn("close", F.last("close", ignorenulls=True).over(P.ordered(["symbol"], "day").rowsBetween(W.unboundedPreceding, 0)))


@query("win_20_forward_slice", f"with {ALIGNED} select lead, lag, N(pos - 100) as t, R(pg) as pg from al where pos between 100 and 120")
def _(t):
    return aligned(t).where("pos between 100 and 120").select("lead", "lag", (F.col("pos") - 100).cast("long").alias("t"), "pg")


FWD = f"{ALIGNED}, h0 as (select lead, lag, regr_slope(ln(pg), ln(pl)) as hedge from al where pos <= 120 group by lead, lag), s0 as (select al.*, hedge, ln(pg) - hedge * ln(pl) as s, ln(pl) - lag(ln(pl)) over (partition by lead, lag order by pos) as rl, ln(pg) - lag(ln(pg)) over (partition by lead, lag order by pos) as rg from al join h0 using (lead, lag)), z0 as (select *, case when count(rl) {PW.format(n=19)} >= 20 then corr(rl, rg) {PW.format(n=19)} end as corr, case when count(s) {PW.format(n=19)} >= 20 then (s - avg(s) {PW.format(n=19)}) / nullif(stddev_samp(s) {PW.format(n=19)}, 0) end as z from s0), e0 as (select lead, lag, s as se, z as ze from z0 where pos = 120 and z is not null), fw as (select lead, lag, pos - 120 as t, hedge, ze as z0, abs(z) as z, corr, -sign(ze) * (s - se) / (1 + abs(hedge)) * 1e4 as gross from z0 join e0 using (lead, lag) where pos between 120 and 160)"


def _paths(t):
    return R.forward_paths(aligned(t), 120, 20, 40)


PASSAGE = f"{FWD}, xt as (select lead, lag, coalesce(min(case when t between 1 and 20 and z <= 0.5 then t end), least(max(t), 20)) as t from fw group by lead, lag)"


@query("win_21_first_passage", f"with {PASSAGE} select lead, lag, N(t) as exit_t, R(gross) as gross from xt join fw using (lead, lag, t) where t >= 1")
def _(t):
    return R.first_passage(_paths(t), 0.5, 20).select("lead", "lag", F.col("exit_t").cast("long").alias("exit_t"), "gross")


@query("win_22_convergence", f"with {FWD} select lead, lag, " + ", ".join(f"R(1 - max(case when t = {k} then z / abs(z0) end)) as conv_{k}" for k in (3, 5, 10, 20)) + ", coalesce(bool_or(t between 1 and 20 and z <= abs(z0) / 2), false) as hit20, N(min(case when t >= 1 and z <= abs(z0) / 2 then t end)) as days_to_half from fw group by lead, lag")
def _(t):
    return R.convergence(_paths(t)).withColumn("days_to_half", F.col("days_to_half").cast("long"))


@query("win_23_entry_forward_corr", f"with {RETURNS} select lead, lag, R(corr(rl, rg) filter (where pos between 61 and 120)) as entry, R(corr(rl, rg) filter (where pos between 121 and 180)) as forward from rt group by lead, lag having count(*) > 180")
def _(t):
    r = P.pair_returns(aligned(t))
    part = lambda a, b: [F.when(F.col("pos").between(a, b), F.col(c)) for c in ("rl", "rg")]
    c = lambda a, b: F.corr(*part(a, b))
    return r.groupBy("lead", "lag").agg(c(61, 120).alias("entry"), c(121, 180).alias("forward"), F.count("*").alias("n")).where("n > 180").drop("n")


@query("win_24_benchmark_norm", "select run_id, day, R(spy / first_value(spy) over w * first_value(pv) over w) as bench from portfolio_snapshots window w as (partition by run_id order by day)")
def _(t):
    w = P.ordered(["run_id"], "day")
    return t.portfolio_snapshots.select("run_id", "day", (F.col("spy") / F.first("spy").over(w) * F.first("pv").over(w)).alias("bench"))


CROSS = f"{ALIGNED}, sh as (select *, lag(pl, 2) over (partition by lead, lag order by pos) as x from al), mm as (select lead, lag, pos, case when count(x) {PW.format(n=4)} >= 5 then avg(x) {PW.format(n=4)} end as a, case when count(x) {PW.format(n=19)} >= 20 then avg(x) {PW.format(n=19)} end as b from sh)"


@query("win_25_ma_signal", f"with {CROSS.replace('select lead, lag, pos, case', 'select lead, lag, pos, day, case')} select lead, lag, arg_max(case when a > b then 'buy' when a < b then 'sell' else 'hold' end, pos) as action from mm group by lead, lag")
def _(t):
    x = aligned(t).withColumn("x", F.lag("pl", 2).over(P.ordered(P.PAIR, "pos")))
    x = P.rolling(P.rolling(x, P.PAIR, "pos", "x", 5, "a"), P.PAIR, "pos", "x", 20, "b")
    return P.last_row(x.withColumn("action", F.when(F.col("a") > F.col("b"), "buy").when(F.col("a") < F.col("b"), "sell").otherwise("hold")), P.PAIR, "pos", "action")


@query("win_26_z_action", f"with {ZS}, l as (select lead, lag, arg_max(z, pos) as z from zs where z is not null group by lead, lag) select lead, lag, case when z < -2.0 then 'buy' when z > -0.5 then 'sell' else 'hold' end as action, R(z) as z from l")
def _(t):
    z = F.col("z")
    x = P.last_row(P.zscore(aligned(t), 20).where("z is not null"), P.PAIR, "pos", "z")
    return x.select("lead", "lag", F.when(z < -2.0, "buy").when(z > -0.5, "sell").otherwise("hold").alias("action"), "z")


@query("win_27_z_depth", f"with {ZS} select lead, lag, day, R(greatest(0, least(1, (-z - 0.5) / 1.5))) as depth from zs where z is not null")
def _(t):
    return P.zscore(aligned(t), 20).where("z is not null").select("lead", "lag", "day", S.z_depth(F.col("z"), 2.0, 0.5).alias("depth"))


@query("win_28_half_life", f"with {SPREAD}, l as (select *, lag(s) over (partition by lead, lag order by pos) as sp from sp), r as (select lead, lag, regr_slope(s, sp) as rho from l where sp is not null group by lead, lag) select lead, lag, R(rho) as rho, R(case when abs(rho) < 1 and rho <> 0 then greatest(1, least(252, -ln(2) / ln(abs(rho)))) end) as half_life from r")
def _(t):
    from ..operators.cointegration import half_life

    return half_life(P.spread(aligned(t)))


@query("win_29_early_drawdown", f"with {FWD} select lead, lag, R(min(gross) filter (where t <= 5)) as worst5 from fw group by lead, lag")
def _(t):
    path = _paths(t).groupBy("lead", "lag").agg(F.sort_array(F.collect_list(F.struct("t", "gross"))).alias("p"))
    return path.select("lead", "lag", F.array_min(F.transform(F.slice("p", 1, 6), lambda x: x["gross"])).alias("worst5"))


@query("win_30_survival", f"with {EQ[5:]}, k as (select *, row_number() over (partition by symbol order by day) as n from q) select symbol, R(max(case when n = 1 then eq end)) as day1, R(max(case when n = 30 then eq end)) as day30, R(arg_max(eq, n)) as end_ from k group by symbol")
def _(t):
    x = _equity(t).withColumn("n", F.row_number().over(P.ordered(["symbol"], "day")))
    at = lambda k: F.max(F.when(F.col("n") == k, F.col("eq")))
    return x.groupBy("symbol").agg(at(1).alias("day1"), at(30).alias("day30"), F.max_by("eq", "n").alias("end_"))


@query("win_31_equity_curve", "select run_id, day, R(pv / first_value(pv) over w) as eq, R((pv - max(pv) over (partition by run_id order by day rows unbounded preceding)) / max(pv) over (partition by run_id order by day rows unbounded preceding)) as dd from portfolio_snapshots window w as (partition by run_id order by day)")
def _(t):
    w = P.ordered(["run_id"], "day")
    peak = F.max("pv").over(w.rowsBetween(W.unboundedPreceding, 0))
    return t.portfolio_snapshots.select("run_id", "day", (F.col("pv") / F.first("pv").over(w)).alias("eq"), ((F.col("pv") - peak) / peak).alias("dd"))


def _perf(held: str = "hl", keys: str = "lead, lag", p: str = "") -> str:
    """{p}pf and {p}tr: the performance of a table's positions, and its trades."""
    part = f"partition by {keys} order by pos"
    return f"""{p}dr as (select *, held * coalesce(pg / lag(pg) over w - 1, 0) as r, held - lag(held) over w as edge from {held} window w as ({part})), {p}pe as (select *, exp(sum(ln(1 + r)) over ({part} rows unbounded preceding)) as eq from {p}dr), {p}pd as (select *, eq / max(eq) over ({part} rows unbounded preceding) - 1 as dd from {p}pe),
{p}ed as (select {keys}, pos, pg, edge, lead(pos) over x as np, lead(pg) over x as ng from {p}dr where edge <> 0 window x as ({part})), {p}tr as (select {keys}, count(*) filter (where edge = 1 and np is not null) as num_trades, avg(case when ng > pg then 1.0 else 0.0 end) filter (where edge = 1 and np is not null) as win_rate, avg(np - pos) filter (where edge = 1 and np is not null) as avg_holding_days from {p}ed group by {keys}),
{p}pf as (select {keys}, exp(sum(ln(1 + r))) - 1 as total_return, case when stddev_samp(r) > 0 then avg(r) / stddev_samp(r) * sqrt(252) end as sharpe, min(dd) as max_drawdown from {p}pd group by {keys})"""


PERF_COLS = "R(total_return) as total_return, R(sharpe) as sharpe, R(max_drawdown) as max_drawdown, N(coalesce(num_trades, 0)) as num_trades, R(win_rate) as win_rate, R(avg_holding_days) as avg_holding_days"
PERF_OUT = f"select pf.lead, pf.lag, {PERF_COLS} from pf left join tr on tr.lead = pf.lead and tr.lag = pf.lag"


@query("udx_07_ma_simulation", f"with {CROSS.replace('select lead, lag, pos, case', 'select lead, lag, pos, pg, day, case')}, hl as (select *, coalesce(lag(case when a > b then 1 else 0 end) over (partition by lead, lag order by pos), 0) as held from mm), {_perf()} {PERF_OUT}")
def _(t):
    return X.ma_switch(aligned(t), [{"shift": 2, "short": 5, "long": 20}]).drop("point", "shift", "short", "long")


# Five lags by ten pairs of means: a short one of at most 4 days, a long one of at most 5.
MA_GRID = [{"shift": k, "short": s, "long": n} for k in range(1, 6) for s in range(1, 5) for n in range(s + 1, 6)]
BEST_POINT = "qualify row_number() over (partition by pf.lead, pf.lag order by round(coalesce(total_return, '-infinity'::double), 9) desc, pf.point) = 1"


def _ma_grid_sql() -> str:
    points = ", ".join(f"({i}, {p['shift']}, {p['short']}, {p['long']})" for i, p in enumerate(MA_GRID))
    by = "partition by lead, lag, shift order by pos"
    means = ", ".join(f"case when count(x) over ({by} rows {n - 1} preceding) >= {n} then avg(x) over ({by} rows {n - 1} preceding) end as m{n}" for n in range(1, 6))
    pick = lambda c: "case " + c + " " + " ".join(f"when {n} then m{n}" for n in range(1, 6)) + " end"
    shifted = ", ".join(f"lag(pl, {k}) over (partition by lead, lag order by pos) as x{k}" for k in range(1, 6))
    return f"""with {ALIGNED}, pt as (select * from (values {points}) v(point, shift, short, long)), xs as (select *, {shifted} from al), sh as (select lead, lag, pos, pg, k as shift, case k {' '.join(f'when {k} then x{k}' for k in range(1, 6))} end as x from xs, range(1, 6) r(k)),
mm as (select *, {means} from sh), sg as (select lead, lag, pos, pg, point, pt.shift, short, long, case when {pick('short')} > {pick('long')} then 1 else 0 end as sig from mm join pt on pt.shift = mm.shift), hl as (select *, coalesce(lag(sig) over (partition by lead, lag, point order by pos), 0) as held from sg), {_perf(keys="lead, lag, point")}
select pf.lead, pf.lag, cast(pt.shift as int) as shift, cast(pt.short as int) as short, cast(pt.long as int) as long, {PERF_COLS} from pf left join tr on tr.lead = pf.lead and tr.lag = pf.lag and tr.point = pf.point join pt on pt.point = pf.point {BEST_POINT}"""


@query("udx_08_ma_grid", _ma_grid_sql())
def _(t):
    return X.best_point(X.ma_switch(aligned(t), MA_GRID)).drop("point")


@query("udx_09_z_simulation", f"with {STATE}, {_perf()} {PERF_OUT}")
def _(t):
    return X.z_strategy(aligned(t), [{"window": 20, "entry": 1.5, "exit": 0.5}]).drop("point", "days_to_first_signal", "window", "entry", "exit")


Z_GRID = [{"window": w, "entry": e, "exit": x} for w in (10, 20, 30) for e in (1.5, 2.0, 2.5) for x in (0.0, 0.5)]


def _z_grid(rows: str, p: str = "") -> str:
    """{p}pf, {p}tr and {p}fs (first signal) of all points over a table of aligned rows."""
    by = "partition by lead, lag order by pos"
    z = ", ".join(f"case when count(s) over ({by} rows {n - 1} preceding) >= {n} then (s - avg(s) over ({by} rows {n - 1} preceding)) / nullif(stddev_samp(s) over ({by} rows {n - 1} preceding), 0) end as z{n}" for n in (10, 20, 30))
    points = ", ".join(f"({i}, {q['window']}, cast({q['entry']} as double), cast({q['exit']} as double))" for i, q in enumerate(Z_GRID))
    return f"""{p}hd as (select lead, lag, regr_slope(ln(pg), ln(pl)) as hedge from {rows} group by lead, lag), {p}sp as (select a.*, hedge, ln(pg) - hedge * ln(pl) as s from {rows} a join {p}hd using (lead, lag)), {p}zz as (select *, {z} from {p}sp), {p}pt as (select * from (values {points}) v(point, win, entry, exit_)),
{p}ev as (select lead, lag, pos, pg, point, entry, exit_, case win when 10 then z10 when 20 then z20 else z30 end as z from {p}zz, {p}pt), {p}st as (select *, coalesce(last_value(case when z is null then 0 when z < -entry then 1 when z > -exit_ then 0 end ignore nulls) over (partition by lead, lag, point order by pos rows unbounded preceding), 0) as sig from {p}ev),
{p}hl as (select *, coalesce(lag(sig) over (partition by lead, lag, point order by pos), 0) as held from {p}st), {p}fs as (select lead, lag, point, coalesce(min(pos) filter (where z < -entry), 0) as first_ from {p}st group by 1, 2, 3), {_perf(f"{p}hl", "lead, lag, point", p)}"""


@query("udx_10_z_grid", f"with {ALIGNED}, {_z_grid('al')} select pf.lead, pf.lag, cast(win as int) as \"window\", R(entry) as entry, R(exit_) as exit, N(first_) as days_to_first_signal, {PERF_COLS} from pf left join tr on tr.lead = pf.lead and tr.lag = pf.lag and tr.point = pf.point join pt on pt.point = pf.point join fs on fs.lead = pf.lead and fs.lag = pf.lag and fs.point = pf.point {BEST_POINT}")
def _(t):
    return X.best_point(X.z_strategy(aligned(t), Z_GRID)).drop("point").withColumn("days_to_first_signal", F.col("days_to_first_signal").cast("long"))


@query("udx_11_holdout", f"with {ALIGNED}, cu as (select *, cast(floor(count(*) over (partition by lead, lag) * cast(0.67 as double)) as int) as cut, count(*) over (partition by lead, lag) as n from al where lag <> 'Brand#15' or pos < 30), good as (select * from cu where cut >= 30 and n - cut >= 10), ta as (select * from good where pos < cut), tb as (select * replace (pos - cut as pos) from good where pos >= cut), {_z_grid('ta')}, {_z_grid('tb', 'h')}, best as (select pf.lead, pf.lag, pf.point, total_return, coalesce(num_trades, 0) as k from pf left join tr on tr.lead = pf.lead and tr.lag = pf.lag and tr.point = pf.point {BEST_POINT}) select best.lead, best.lag, cast(best.point as int) as point, R(best.total_return) as train_return, N(k) as num_trades, R(case when best.total_return > 0 and k >= 2 then hpf.total_return else -1 end) as holdout_return, cast(case when best.total_return > 0 and k >= 2 then first_ else 0 end as int) as holdout_days from best left join hpf on hpf.lead = best.lead and hpf.lag = best.lag and hpf.point = best.point left join hfs on hfs.lead = best.lead and hfs.lag = best.lag and hfs.point = best.point union all select distinct lead, lag, cast(null as int), R(0), 0, R(-1), 0 from cu where not (cut >= 30 and n - cut >= 10)")
def _(t):
    return X.with_holdout(aligned(t).where("lag <> 'Brand#15' or pos < 30"), Z_GRID)


@query("udx_13_rewindowed_corr", f"with {RETURNS}, b as (select *, row_number() over (partition by lead, lag order by day desc) as k from rt where rl is not null) select lead, lag, R(case when count(*) filter (where k <= 60) >= 60 then corr(rl, rg) filter (where k <= 60) end) as rho from b group by lead, lag")
def _(t):
    from ..operators.observe import corr_of_arrays, return_arrays

    return corr_of_arrays(return_arrays(aligned(t), 250), 60)


POLICY = "case when next_results_t <= 3 then null when next_results_t <= hold_days then least(hold_days, greatest(1, next_results_t - 1)) else hold_days end"


@query("udx_15_event_policy", f"with p as (select obs_id, {POLICY} as x, surprise_t from observations) select N(obs_id) as obs_id, x is not null as traded, N(case when x is null then null when surprise_t <= x then least(30, surprise_t + 1) else x end) as exit_t from p")
def _(t):
    from ..operators.events import policy_exit

    traded, exit_t = policy_exit(F.col("hold_days"), F.col("next_results_t"), F.col("surprise_t"), F.lit(30), 3, 1, True)
    return t.observations.select("obs_id", traded.alias("traded"), exit_t.cast("long").alias("exit_t"))


@query("udx_17_exit_policies", f"with {FWD}, o as (select *, row_number() over (partition by lead, lag order by round(gross, 9) desc, t) as n from fw where t between 1 and 20) select f.lead, f.lag, R(f.gross) as fixed5, R(f.gross - 10 - 0.01 * (abs(f.hedge) / (1 + abs(f.hedge))) * (5 / 252.0) * 1e4) as net5, N(o.t) as best_t, R(o.gross) as best from fw f join o on o.lead = f.lead and o.lag = f.lag and o.n = 1 where f.t = 5")
def _(t):
    p = _paths(t)
    five = R.net_of_costs(R.fixed_exit(p, 5)).select("lead", "lag", F.col("gross").alias("fixed5"), F.col("net").alias("net5"))
    return five.join(R.oracle_exit(p, 20).select("lead", "lag", F.col("exit_t").cast("long").alias("best_t"), F.col("gross").alias("best")), ["lead", "lag"])


def _stop_sql(rules: str) -> str:
    return f"with {FWD}, r as (select *, {rules} as why from fw where t between 1 and 40), n as (select *, row_number() over (partition by lead, lag order by (why is null), case when why is null then -t else t end) as k from r) select lead, lag, N(t) as day, coalesce(why, 'cap') as reason, R(gross) as gross from n where k = 1"


@query("udx_18_stops", _stop_sql("case when z <= 0.5 then 'take_profit' when z >= abs(z0) + 1 then 'divergence' when corr < 0.0 then 'health' when t >= 25 and z > 0.5 then 'time' end"))
def _(t):
    z, d = F.col("z"), F.col("t")
    got = R.stops(_paths(t), [("take_profit", z <= 0.5), ("divergence", z >= F.abs("z0") + 1), ("health", F.col("corr") < 0.0), ("time", (d >= 25) & (z > 0.5))], 40)
    return got.withColumn("day", F.col("day").cast("long"))


@query("udx_19_catastrophe_stops", _stop_sql("case when z <= 0.1 then 'take_profit' when gross <= -800 or z >= 2.5 then 'catastrophe' end"))
def _(t):
    got = R.stops(_paths(t), [("take_profit", F.col("z") <= 0.1), ("catastrophe", (F.col("gross") <= -800) | (F.col("z") >= 2.5))], 40)
    return got.withColumn("day", F.col("day").cast("long"))


@query("udx_20_round_trip", f"with {PASSAGE} select lead, lag, N(t) as hold_days, R(gross) as gross, R(fw.z0) as z0 from xt join fw using (lead, lag, t) where t >= 1 and abs(fw.z0) >= 1")
def _(t):
    p = _paths(t).where(F.abs("z0") >= 1)
    z0 = p.where("t = 0").select("lead", "lag", "z0")
    return R.first_passage(p, 0.5, 20).join(z0, ["lead", "lag"]).select("lead", "lag", F.col("exit_t").cast("long").alias("hold_days"), "gross", "z0")


@query("udx_21_unit_hedge_z", f"with {ALIGNED}, u as (select *, ln(pl) - ln(pg) as s, row_number() over (partition by lead, lag order by pos desc) as k from al) select lead, lag, R((arg_max(s, pos) - avg(s)) / nullif(stddev_samp(s), 0)) as z from u where k <= 30 group by lead, lag")
def _(t):
    x = aligned(t).withColumn("s", F.log("pl") - F.log("pg")).withColumn("k", F.row_number().over(W.partitionBy("lead", "lag").orderBy(F.desc("pos")))).where("k <= 30")
    return x.groupBy("lead", "lag").agg(((F.max_by("s", "pos") - F.avg("s")) / F.nullif(F.stddev_samp("s"), F.lit(0.0))).alias("z"))


@query("udx_22_fifo_match", "with f as (select run_id, symbol, arg_min(price, (filled_at, id)) filter (where side = 'buy') as bp, arg_min(quantity, (filled_at, id)) filter (where side = 'buy') as q, min(filled_at) filter (where side = 'buy') as bt, arg_min(price, (filled_at, id)) filter (where side = 'sell') as sp, min(filled_at) filter (where side = 'sell') as st from trades group by 1, 2) select run_id, symbol, R((sp - bp) * q) as gain from f where st > bt")
def _(t):
    from ..operators.metrics import first_match

    return first_match(t.trades)
