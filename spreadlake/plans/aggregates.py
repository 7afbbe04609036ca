"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import inference as I
from ..operators import metrics as M
from ..operators import panel as P
from ..operators.ranks import quantiles
from ..registry import query

PAIRS = "pairs_ as (select a.symbol as lead, b.symbol as lag from ticker_metadata a join ticker_metadata b on substr(a.symbol, 1, 7) = substr(b.symbol, 1, 7) and a.symbol < b.symbol)"
ALIGNED = f"{PAIRS}, al as (select lead, lag, a.day, a.close as pl, b.close as pg, row_number() over (partition by lead, lag order by a.day) - 1 as pos from pairs_ join prices a on a.symbol = lead join prices b on b.symbol = lag and b.day = a.day)"
RETURNS = f"{ALIGNED}, rt as (select *, ln(greatest(pl, 1e-9)) - lag(ln(greatest(pl, 1e-9))) over w as rl, ln(greatest(pg, 1e-9)) - lag(ln(greatest(pg, 1e-9))) over w as rg from al window w as (partition by lead, lag order by day))"
AVGRANK = "rank() over (partition by {k} order by {x}) + (count(*) over (partition by {k}, {x}) - 1) / 2.0"


def pairs(t):
    return P.pairs_within(t.ticker_metadata.select(F.substring("symbol", 1, 7).alias("g"), "symbol"), "g").select("lead", "lag")


def aligned(t):
    return P.align(t.prices, pairs(t))


@query("agg_01_dual_correlation", f"with {RETURNS}, b as (select *, row_number() over (partition by lead, lag order by day desc) as k from rt where rl is not null) select lead, lag, R(case when count(*) filter (where k <= 90) >= 90 then corr(rl, rg) filter (where k <= 90) end) as corr_long, R(case when count(*) filter (where k <= 20) >= 20 then corr(rl, rg) filter (where k <= 20) end) as corr_short from b group by lead, lag")
def _(t):
    return P.dual_correlation(aligned(t), 90, 20)


@query("agg_02_lagged_corr", f"with {ALIGNED}, s as (select lead, lag, lag(pl, 3) over (partition by lead, lag order by day) as x, pg from al) select lead, lag, R(corr(x, pg)) as rho from s where x is not null group by lead, lag")
def _(t):
    x = aligned(t).withColumn("x", F.lag("pl", 3).over(P.ordered(P.PAIR, "day")))
    return x.groupBy("lead", "lag").agg(P.safe_corr("x", "pg").alias("rho"))


@query("agg_03_corr_matrix", "with r as (select symbol, day, ln(close) - lag(ln(close)) over (partition by symbol order by day) as r from prices) select a.symbol as a, b.symbol as b, R(corr(a.r, b.r)) as rho from r a join r b using (day) where a.symbol < b.symbol and a.r is not null and b.r is not null group by 1, 2")
def _(t):
    return P.correlation_blocks(P.log_returns(t.prices), size=16)


@query("agg_04_hedge", f"with {ALIGNED} select lead, lag, R(regr_slope(ln(pg), ln(pl))) as hedge from al group by lead, lag")
def _(t):
    return aligned(t).groupBy("lead", "lag").agg(F.regr_slope(F.log("pg"), F.log("pl")).alias("hedge"))


@query("agg_05_regression", f"with {RETURNS} select lead, lag, R(regr_slope(rg, rl)) as beta, R(regr_intercept(rg, rl) * 252) as alpha, R(regr_r2(rg, rl)) as r2 from rt where rl is not null group by lead, lag")
def _(t):
    return P.pair_returns(aligned(t)).where("rl is not null").groupBy("lead", "lag").agg(F.regr_slope("rg", "rl").alias("beta"), (F.regr_intercept("rg", "rl") * 252).alias("alpha"), F.regr_r2("rg", "rl").alias("r2"))


RHO = f"with r as (select fold, {AVGRANK.format(k='fold', x='corr_long')} as a, {AVGRANK.format(k='fold', x='gross')} as b from observations) select fold, count(*) as n, corr(a, b) as rho from r group by fold"


@query("agg_06_spearman", f"select fold, N(n) as n, R(rho) as rho from ({RHO})")
def _(t):
    return P.spearman(t.observations, ["fold"], "corr_long", "gross")


@query("agg_07_spearman_components", " union all ".join(f"select '{c}' as component, fold, R(corr(a, b)) as rho from (select fold, {AVGRANK.format(k='fold', x=c)} as a, {AVGRANK.format(k='fold', x='gross')} as b from observations) group by fold" for c in ("corr_long", "corr_short", "z_depth")))
def _(t):
    long = t.observations.unpivot(["fold", "gross", "obs_id"], ["corr_long", "corr_short", "z_depth"], "component", "x")
    return P.spearman(long, ["component", "fold"], "x", "gross").drop("n")


@query("agg_08_fisher_pool", f"with q as ({RHO}), s as (select sum((n - 3) * atanh(rho)) / sum(n - 3) as m, 1 / sqrt(sum(n - 3)) as se from q) select R((exp(2 * m) - 1) / (exp(2 * m) + 1)) as pooled, R((exp(2 * (m - 1.96 * se)) - 1) / (exp(2 * (m - 1.96 * se)) + 1)) as low, R((exp(2 * (m + 1.96 * se)) - 1) / (exp(2 * (m + 1.96 * se)) + 1)) as high from s")
def _(t):
    return M.fisher_pool(P.spearman(t.observations, ["fold"], "corr_long", "gross"))


METRICS = "x as (select *, pv / lag(pv) over w - 1 as ret, (pv - max(pv) over (partition by run_id order by day rows unbounded preceding)) / max(pv) over (partition by run_id order by day rows unbounded preceding) as dd from portfolio_snapshots window w as (partition by run_id order by day)), m as (select run_id, count(*) as n, arg_max(pv, day) / arg_min(pv, day) - 1 as total_return, avg(ret) / stddev_samp(ret) * sqrt(252) as sharpe, abs(min(dd)) as max_drawdown, avg(cash_ratio) as avg_cash, avg(active_pairs) as avg_pairs, arg_max(pv, day) / arg_min(pv, day) > arg_max(spy, day) / arg_min(spy, day) as beats, stddev_samp(pv) as pv_std, stddev_samp(ret) as ret_std from x group by run_id)"


@query("agg_09_run_metrics", f"with {METRICS} select run_id, N(n) as n, R(total_return) as total_return, R(sharpe) as sharpe, R(max_drawdown) as max_drawdown, R(avg_cash) as avg_cash, R(avg_pairs) as avg_pairs, beats from m")
def _(t):
    return M.run_metrics(t.portfolio_snapshots).drop("pv_std", "ret_std")


SCORE = f"{METRICS}, sc as (select run_id, case when n < 3 then -999 when k < 3 then -50 when pv_std < 1e-6 or ret_std < 1e-9 then -999 else sharpe - 0.5 * max_drawdown - 0.05 * ln(1 + k) + case when not beats then -2.0 else 0 end end as score from m join (select run_id, count(*) as k from trades group by run_id) using (run_id))"


def _scores(t):
    return M.run_score(M.run_metrics(t.portfolio_snapshots), t.trades.groupBy("run_id").agg(F.count("*").alias("n_trades")), 0.5, 0.05, 1.0)


@query("agg_10_run_score", f"with {SCORE} select run_id, R(score) as score from sc")
def _(t):
    return _scores(t)


@query("agg_11_blended_score", f"with {SCORE}, q as ({RHO}) select run_id, R(case when n >= 5 then 0.4 * rho + 0.6 * greatest(-1, least(1, score / 3)) else score end) as score from sc left join q on fold = run_id")
def _(t):
    rho = P.spearman(t.observations, ["fold"], "corr_long", "gross").withColumnRenamed("fold", "run_id")
    x = _scores(t).join(rho, "run_id", "left")
    blend = 0.4 * F.col("rho") + 0.6 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("score") / 3))
    return x.select("run_id", F.when(F.col("n") >= 5, blend).otherwise(F.col("score")).alias("score"))


@query("agg_12_pair_pnl", "select N(pair_id) as pair_id, R(sum(case when side = 'sell' then quantity * price - slippage else -(quantity * price + slippage) end)) as pnl from trades where leg = 'long' group by pair_id having count(distinct case when side = 'buy' then 1 end) = 1 and count(distinct case when side = 'sell' then 1 end) = 1")
def _(t):
    return M.pair_pnl(t.trades.where("leg = 'long'"))


@query("agg_13_slippage_share", "select run_id, R(sum(slippage) / nullif(sum(quantity * price), 0)) as share from trades group by run_id")
def _(t):
    return t.trades.groupBy("run_id").agg((F.sum("slippage") / F.nullif(F.sum(F.col("quantity") * F.col("price")), F.lit(0.0))).alias("share"))


@query("agg_14_dispersion", "with r as (select symbol, day, close / nullif(lag(close) over (partition by symbol order by day), 0) - 1 as r from prices), d as (select day, stddev_samp(r) as s from r where r is not null group by day having count(*) >= 20) select R(avg(s)) as dispersion, N(count(*)) as days_ from d")
def _(t):
    d = P.simple_returns(t.prices).where("ret is not null").groupBy("day").agg(F.stddev_samp("ret").alias("s"), F.count("*").alias("n")).where("n >= 20")
    return d.agg(F.avg("s").alias("dispersion"), F.count("*").alias("days_"))


@query("agg_15_warmth", "select symbol, min(day) as lo, max(day) as hi, N(count(distinct day)) as days_, min(day) <= date '1995-02-01' and max(day) >= date '2001-10-01' and count(distinct day) >= 354 as warm from prices group by symbol")
def _(t):
    x = t.prices.groupBy("symbol").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.countDistinct("day").alias("days_"))
    return x.withColumn("warm", (F.col("lo") <= "1995-02-01") & (F.col("hi") >= "2001-10-01") & (F.col("days_") >= 354))


@query("agg_16_pool_corr", "select R(median(corr_short)) as pool from observations where z_depth > 0")
def _(t):
    return quantiles(t.observations.where("z_depth > 0"), [], "corr_short", {"pool": 0.5})


CORR = f"with {RETURNS}, c as (select substr(lead, 1, 7) as cluster, lead, lag, corr(rl, rg) as rho from rt where rl is not null group by 1, 2, 3)"


def _cluster_corr(t):
    r = P.pair_returns(aligned(t)).where("rl is not null").groupBy("lead", "lag").agg(P.safe_corr("rl", "rg").alias("rho"))
    return r.withColumn("cluster", F.substring("lead", 1, 7))


@query("agg_17_cluster_median", f"{CORR} select cluster, R(median(rho)) as rho from c group by cluster")
def _(t):
    return _cluster_corr(t).groupBy("cluster").agg(F.median("rho").alias("rho"))


@query("agg_18_expected_yield", f"{CORR} select cluster, R(avg(rho) * any_value(k)) as yield_ from c join (select substr(symbol, 1, 7) as cluster, count(*) as k from ticker_metadata group by 1) using (cluster) group by cluster")
def _(t):
    size = t.ticker_metadata.groupBy(F.substring("symbol", 1, 7).alias("cluster")).agg(F.count("*").alias("k"))
    return _cluster_corr(t).groupBy("cluster").agg(F.avg("rho").alias("y")).join(size, "cluster").select("cluster", (F.col("y") * F.col("k")).alias("yield_"))


BIN = "select *, greatest(cast(ceil((row_number() over (partition by fold order by {x}, obs_id) - 1) * {n} / cast(greatest(count(*) over (partition by fold) - 1, 1) as double)) as int) - 1, 0) as bin from observations"


@query("agg_19_tercile_outcomes", f"select fold, bin, N(count(*)) as n, R(avg(gross)) as mean, R(median(gross)) as median_, R(avg(case when gross > 0 then 1.0 else 0.0 end)) as win_rate, R(avg(gross) filter (where gross > 0)) as win_size, R(avg(case when gross < -1000 then 1.0 else 0.0 end)) as cat from ({BIN.format(x='corr_long', n=3)}) group by fold, bin")
def _(t):
    x = P.quantile_bin(t.observations.select("fold", "obs_id", "corr_long", "gross"), ["fold"], "corr_long", "obs_id", 3)
    g, n = F.col("gross"), F.col("n")
    share = lambda c: F.sum(F.when(c, n).otherwise(0)) / F.sum(n)
    means = {"mean": F.sum(g * n) / F.sum(n), "win_rate": share(g > 0), "win_size": F.sum(F.when(g > 0, g * n)) / F.sum(F.when(g > 0, n)), "cat": share(g < -1000)}
    return quantiles(x, ["fold", "bin"], "gross", {"median_": 0.5}, None, **means, n=F.sum(n))


TIMING = "case when next_results_t is null then 'none' when next_results_t <= 5 then 'near' when next_results_t <= hold_days then 'inside' else 'after' end"


def _timing():
    t = F.col("next_results_t")
    return F.when(t.isNull(), "none").when(t <= 5, "near").when(t <= F.col("hold_days"), "inside").otherwise("after")


@query("agg_20_timing_buckets", f"with s as (select sum(gross) as g, count(*) as k from observations) select {TIMING} as bucket, N(count(*)) as n, R(avg(gross)) as mean, R((any_value(g) - sum(gross)) / (any_value(k) - count(*))) as mean_without from observations, s group by 1")
def _(t):
    b = t.observations.groupBy(_timing().alias("bucket")).agg(F.count("*").alias("n"), F.sum("gross").alias("g"))
    w = W.partitionBy()  # four rows
    return b.select("bucket", "n", (F.col("g") / F.col("n")).alias("mean"), ((F.sum("g").over(w) - F.col("g")) / (F.sum("n").over(w) - F.col("n"))).alias("mean_without"))


CLASS = "case when gross < -1000 then 'caught' when gross < 0 then 'survivor' else 'normal' end"


def _class():
    g = F.col("gross")
    return F.when(g < -1000, "caught").when(g < 0, "survivor").otherwise("normal")


@query("agg_21_profile_medians", f"select {CLASS} as class, R(median(halflife_days)) as hl, R(median(corr_short)) as cs, R(median(hold_days)) as hold from observations group by 1")
def _(t):
    x = t.observations.select(_class().alias("class"), "halflife_days", "corr_short", "hold_days")
    hl, cs, hold = (quantiles(x, ["class"], c, {out: 0.5}) for c, out in (("halflife_days", "hl"), ("corr_short", "cs"), ("hold_days", "hold")))
    return hl.join(cs, "class").join(hold, "class")


@query("agg_22_composition", "select least(a, b) || '+' || greatest(a, b) as combo, N(count(*)) as n, R(avg(gross)) as mean from (select gross, case when l.is_etf then 'etf' else 'stock' end as a, case when g.is_etf then 'etf' else 'stock' end as b from observations join ticker_metadata l on l.symbol = lead join ticker_metadata g on g.symbol = lag) group by 1")
def _(t):
    kind = lambda leg, out: t.ticker_metadata.select(F.col("symbol").alias(leg), F.when(F.col("is_etf"), "etf").otherwise("stock").alias(out))
    x = t.observations.join(kind("lead", "a"), "lead").join(kind("lag", "b"), "lag")
    return x.groupBy(F.array_join(F.sort_array(F.array("a", "b")), "+").alias("combo")).agg(F.count("*").alias("n"), F.avg("gross").alias("mean"))


@query("agg_23_leg_concentration", "select leg, N(count(*)) as n, R(sum(gross) filter (where gross < 0)) as lost from (select unnest([lead, lag]) as leg, gross from observations) group by leg having count(*) >= 8")
def _(t):
    return t.observations.select(F.explode(F.array("lead", "lag")).alias("leg"), "gross").groupBy("leg").agg(F.count("*").alias("n"), F.sum(F.when(F.col("gross") < 0, F.col("gross"))).alias("lost")).where("n >= 8")


@query("agg_24_leg_reuse", "select date, N(max(k)) as most from (select date, leg, count(*) as k from (select date, unnest([lead, lag]) as leg from observations) group by 1, 2) group by date")
def _(t):
    return t.observations.select("date", F.explode(F.array("lead", "lag")).alias("leg")).groupBy("date", "leg").agg(F.count("*").alias("k")).groupBy("date").agg(F.max("k").alias("most"))


@query("agg_25_trimmed_means", "select fold, R(avg(gross)) as mean, R(avg(gross) filter (where k > 5)) as trimmed, R(sum(least(gross, 0)) filter (where k <= 5) / sum(least(gross, 0))) as worst_share from (select *, row_number() over (partition by fold order by gross, obs_id) as k from observations) group by fold")
def _(t):
    return M.trimmed_means(t.observations, "fold", "gross", "obs_id", 5)


@query("agg_26_auc", "with r as (select case when gross > 0 then 1 else 0 end as y, rank() over (order by corr_long) + (count(*) over (partition by corr_long) - 1) / 2.0 as r from observations) select R((sum(r) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))) as auc from r")
def _(t):
    return M.auc(t.observations.withColumn("y", F.when(F.col("gross") > 0, 1).otherwise(0)), "y", "corr_long")


@query("agg_27_crosstab", "with c as (select N(count(*) filter (where e and b)) as a, N(count(*) filter (where e and not b)) as b, N(count(*) filter (where not e and b)) as c, N(count(*) filter (where not e and not b)) as d from (select surprise_t is not null as e, gross < -1000 as b from observations)) select a, b, c, d, R(a * d / nullif(cast(b * c as double), 0)) as odds from c")
def _(t):
    from ..operators.inference import crosstab

    return crosstab(t.observations, F.col("surprise_t").isNotNull(), F.col("gross") < -1000).select("a", "b", "c", "d", "odds")


LN_CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1))"
LN_TABLE = f"{LN_CHOOSE.format('k', 'x')} + {LN_CHOOSE.format('n - k', 'r - x')} - {LN_CHOOSE.format('n', 'r')}"


@query("agg_27_fisher_exact", f"with c as (select N(count(*) filter (where e and b)) as a, N(count(*) filter (where e and not b)) as b, N(count(*) filter (where not e and b)) as c, N(count(*) filter (where not e and not b)) as d from (select surprise_t is not null as e, gross < -1000 as b from observations)), m as (select *, a + b as r, a + c as k, a + b + c + d as n from c), t as (select m.*, unnest(range(greatest(0, r + k - n), least(r, k) + 1)) as x from m), l as (select *, {LN_TABLE} as ln_p from t), h as (select ln_p as here from l where x = a) select any_value(a) as a, any_value(b) as b, any_value(c) as c, any_value(d) as d, R(any_value(a * d / nullif(cast(b * c as double), 0))) as odds, R(least(1, sum(exp(ln_p)))) as p from l, h where ln_p <= here + 1e-7")
def _(t):
    from ..operators.inference import crosstab, fisher_exact

    return fisher_exact(crosstab(t.observations, F.col("surprise_t").isNotNull(), F.col("gross") < -1000))


@query("agg_28_bootstrap_rate_gap", f"with x as (select draw, surprise_t is not null as g, case when gross < -1000 then 1.0 else 0.0 end as e, {I.poisson_weight_sql(7, 'draw', 'obs_id')} as w from observations, (select unnest(range(1, 201)) as draw)), y as (select draw, sum(w * e) filter (where g) / nullif(sum(w) filter (where g), 0) - sum(w * e) filter (where not g) / nullif(sum(w) filter (where not g), 0) as gap from x group by draw) select R(avg(gap)) as mean, R(quantile_cont(gap, 0.025)) as low, R(quantile_cont(gap, 0.975)) as high from y")
def _(t):
    from ..operators.inference import bootstrap_rate_gap

    return bootstrap_rate_gap(t.observations, F.col("surprise_t").isNotNull(), F.col("gross") < -1000, draws=200, seed=7)


@query("agg_29_date_bootstrap", f"with c as (select cast(date - date '1970-01-01' as bigint) as k, sum(gross) as s, count(gross) as n from observations group by 1), x as (select draw, s, n, {I.poisson_weight_sql(7, 'draw', 'k')} as w from c, (select unnest(range(1, 101)) as draw)), y as (select draw, sum(w * s) / nullif(sum(w * n), 0) as m from x group by draw) select R(avg(m)) as mean, R(quantile_cont(m, 0.025)) as low, R(quantile_cont(m, 0.975)) as high from y")
def _(t):
    from ..operators.inference import clustered_bootstrap

    return clustered_bootstrap(t.observations, "date", "gross", draws=100, seed=7)


@query("agg_30_halflife_calibration", "select fold, R(median(hold_days / halflife_days)) as ratio from observations group by fold")
def _(t):
    return quantiles(t.observations.select("fold", (F.col("hold_days") / F.col("halflife_days")).alias("r")), ["fold"], "r", {"ratio": 0.5})


TRIPS = "r as (select b.run_id, s.exit_reason, (s.price - b.price) * b.quantity - s.slippage as pnl, epoch(s.filled_at - b.filled_at) / 86400 as hold_days from trades b join trades s on s.run_id = b.run_id and s.symbol = b.symbol and s.pair_id = b.pair_id and s.side = 'sell' and s.filled_at > b.filled_at where b.side = 'buy')"


@query("agg_31_trade_funnel", f"with {TRIPS} select run_id, exit_reason, N(count(*)) as n, R(avg(case when pnl > 0 then 1.0 else 0.0 end)) as win_rate, R(avg(pnl)) as mean, R(median(hold_days)) as hold from r group by 1, 2")
def _(t):
    trips = M.round_trips(t.trades)
    means = trips.groupBy("run_id", "exit_reason").agg(F.count("*").alias("n"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("pnl").alias("mean"))
    return means.join(quantiles(trips, ["run_id", "exit_reason"], "hold_days", {"hold": 0.5}), ["run_id", "exit_reason"])


@query("agg_32_sector_pairs", "select case when a.sector is null or b.sector is null then 'unknown' when a.sector = b.sector then a.sector else 'cross' end as label, N(count(*)) as n, R(avg(gross)) as mean from observations join ticker_metadata a on a.symbol = lead join ticker_metadata b on b.symbol = lag group by 1 having count(*) >= 3")
def _(t):
    dim = lambda leg: t.ticker_metadata.select(F.col("symbol").alias(leg), F.col("sector").alias(f"s_{leg}"))
    x = t.observations.join(dim("lead"), "lead").join(dim("lag"), "lag")
    label = F.when(F.col("s_lead").isNull() | F.col("s_lag").isNull(), "unknown").when(F.col("s_lead") == F.col("s_lag"), F.col("s_lead")).otherwise("cross")
    return x.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.avg("gross").alias("mean")).where("n >= 3")


@query("agg_33_veto_ledger", "select fold, R(-sum(gross) filter (where v and gross < 0)) as avoided, R(sum(gross) filter (where v and gross > 0)) as missed, R(-sum(gross) filter (where v)) as net, R(avg(gross)) as before_, R(avg(gross) filter (where not v)) as after_ from (select *, coalesce(next_results_t <= 5, false) as v from observations) group by fold")
def _(t):
    v, g = F.coalesce(F.col("next_results_t") <= 5, F.lit(False)), F.col("gross")
    return t.observations.groupBy("fold").agg((-F.sum(F.when(v & (g < 0), g))).alias("avoided"), F.sum(F.when(v & (g > 0), g)).alias("missed"), (-F.sum(F.when(v, g))).alias("net"), F.avg(g).alias("before_"), F.avg(F.when(~v, g)).alias("after_"))


@query("agg_34_gate", "with a as (select fold, avg(gross) filter (where corr_long > 0.5) as g, avg(gross) filter (where corr_long <= 0.5) as b from observations group by fold) select N(count(*) filter (where g > b)) as wins, R(avg(case when g > 0 then 1.0 else 0.0 end)) as positive, arg_max(fold, g) as best from a")
def _(t):
    a = t.observations.groupBy("fold").agg(F.avg(F.when(F.col("corr_long") > 0.5, F.col("gross"))).alias("g"), F.avg(F.when(F.col("corr_long") <= 0.5, F.col("gross"))).alias("b"))
    return a.agg(F.count_if(F.col("g") > F.col("b")).alias("wins"), F.avg(F.when(F.col("g") > 0, 1.0).otherwise(0.0)).alias("positive"), F.max_by("fold", "g").alias("best"))


@query("agg_35_components", "select component, R(stddev_samp(x)) as sd, R(avg(case when x = m then 1.0 else 0.0 end)) as at_max, R(stddev_samp(x) / 3) as weighted from (select component, x, max(x) over (partition by component) as m from (unpivot (select corr_long, corr_short, z_depth from observations) on corr_long, corr_short, z_depth into name component value x)) group by component")
def _(t):
    long = t.observations.unpivot("obs_id", ["corr_long", "corr_short", "z_depth"], "component", "x")
    top = long.groupBy("component").agg(F.max("x").alias("m"))  # three rows
    x = long.join(top, "component")
    return x.groupBy("component").agg(F.stddev_samp("x").alias("sd"), F.avg(F.when(F.col("x") == F.col("m"), 1.0).otherwise(0.0)).alias("at_max"), (F.stddev_samp("x") / 3).alias("weighted"))


@query("agg_36_component_corr", "select R(corr(corr_long, corr_short)) as ls, R(corr(corr_long, z_depth)) as lz, R(corr(corr_short, z_depth)) as sz from observations")
def _(t):
    return t.observations.agg(P.safe_corr("corr_long", "corr_short").alias("ls"), P.safe_corr("corr_long", "z_depth").alias("lz"), P.safe_corr("corr_short", "z_depth").alias("sz"))


@query("agg_37_freshness", "select symbol from filing_events group by symbol having max(filed_at) >= timestamp '2024-01-30 12:00:00'")
def _(t):
    return t.filing_events.groupBy("symbol").agg(F.max("filed_at").alias("m")).where("m >= timestamp_ntz '2024-01-30 12:00:00'").select("symbol")


@query("agg_38_distinct", "select N(count(distinct symbol)) as symbols, N(count(distinct form)) as forms from filing_events")
def _(t):
    return t.filing_events.agg(F.countDistinct("symbol").alias("symbols"), F.countDistinct("form").alias("forms"))


@query("agg_39_threshold_what_if", "select th, N(count(*)) as n, R(avg(gross)) as mean, R(avg(gross) filter (where gross > 0)) as winners, R(avg(gross) filter (where gross <= 0)) as losers from observations, (values (0.2), (0.5), (0.8)) v(th) where corr_long >= th group by th")
def _(t):
    x = t.observations.select("gross", "corr_long", F.explode(F.array(*map(F.lit, (0.2, 0.5, 0.8)))).alias("th")).where("corr_long >= th")
    g = F.col("gross")
    return x.groupBy("th").agg(F.count("*").alias("n"), F.avg(g).alias("mean"), F.avg(F.when(g > 0, g)).alias("winners"), F.avg(F.when(g <= 0, g)).alias("losers"))


@query("agg_40_policy_summary", "select R(avg(gross) filter (where tr)) as mean, R(min(gross) filter (where tr)) as worst, N(count(*) filter (where tr and gross < -1000)) as n_cat, R(1 - sum(gross) filter (where tr and gross < -1000) / sum(gross) filter (where gross < -1000)) as loss_cut, R(1 - count(*) filter (where tr) / cast(count(*) as double)) as excluded from (select *, not coalesce(next_results_t <= 5, false) as tr from observations)")
def _(t):
    tr, g = ~F.coalesce(F.col("next_results_t") <= 5, F.lit(False)), F.col("gross")
    cat = g < -1000
    return t.observations.agg(F.avg(F.when(tr, g)).alias("mean"), F.min(F.when(tr, g)).alias("worst"), F.count_if(tr & cat).alias("n_cat"), (1 - F.sum(F.when(tr & cat, g)) / F.sum(F.when(cat, g))).alias("loss_cut"), (1 - F.count_if(tr) / F.count("*")).alias("excluded"))


DEPTH = "case when z_depth = 0 then 'none' when z_depth < 1 then 'partial' else 'full' end"


@query("agg_41_live_entries", f"select {DEPTH} as depth, N(count(*)) as n, R(count(*) / cast(sum(count(*)) over () as double)) as share, R(avg(gross)) as mean, R(median(gross)) as median_ from observations where exists (select 1 from trades where id = obs_id and side = 'buy') group by 1")
def _(t):
    z = F.col("z_depth")
    live = _live(t).withColumn("depth", F.when(z == 0, "none").when(z < 1, "partial").otherwise("full"))
    x = live.groupBy("depth").agg(F.count("*").alias("n"), F.avg("gross").alias("mean")).join(quantiles(live, ["depth"], "gross", {"median_": 0.5}), "depth")
    return x.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))  # three rows


def _live(t):
    return t.observations.join(t.trades.where("side = 'buy'").select(F.col("id").alias("obs_id")), "obs_id", "left_semi")


LIVE_RHO = "select {g} as fold, N(count(*)) as n, R(corr(a, b)) as rho from (select *, rank() over (partition by {k} order by score) + (count(*) over (partition by {k}, score) - 1) / 2.0 as a, rank() over (partition by {k} order by gross) + (count(*) over (partition by {k}, gross) - 1) / 2.0 as b from live) group by 1"


@query("agg_41_live_rank_correlation", "with live as (select fold, gross, 1 as one, round(0.3 * corr_long + 0.3 * corr_short + 0.4 * z_depth, 9) as score from observations where exists (select 1 from trades where id = obs_id and side = 'buy')) " + LIVE_RHO.format(g="fold", k="fold") + " union all " + LIVE_RHO.format(g="'pooled'", k="one"))
def _(t):
    score = F.round(S.composite_score(F.col("corr_long"), F.col("corr_short"), F.col("z_depth")), 9)
    live = _live(t).select("fold", "gross", score.alias("score"))
    return P.spearman(live, ["fold"], "score", "gross").unionByName(P.spearman(live, [], "score", "gross").withColumn("fold", F.lit("pooled")))


RANKERS = ("composite", "corr_long", "corr_short", "z_depth", "z_entry", "neg_halflife", "random")


@query("agg_42_rankers", f"with o as (select cast(date_trunc('month', date) as date) as mon, obs_id, gross, round(0.3 * corr_long + 0.3 * corr_short + 0.4 * z_depth, 9) as composite, corr_long, corr_short, z_depth, z_entry, -halflife_days as neg_halflife, cast({S.mixed_sql(3, '0', 'obs_id')} as double) as random from observations) select ranker, R(avg(gross)) as mean, R(median(gross)) as median_, R(avg(case when gross < -1000 then 1.0 else 0.0 end)) as cat, R(avg(gross) filter (where gross > 0)) as win_size from (select ranker, gross, row_number() over (partition by mon, ranker order by x desc, obs_id) as k from (unpivot (select * from o) on {', '.join(RANKERS)} into name ranker value x)) where k <= 20 group by ranker")
def _(t):
    o = t.observations.withColumn("at", F.to_date(F.date_trunc("month", "date"))).withColumn("composite", F.round(S.composite_score(F.col("corr_long"), F.col("corr_short"), F.col("z_depth")), 9))
    o = o.withColumn("neg_halflife", -F.col("halflife_days")).withColumn("random", S.mixed(3, F.lit(0), F.col("obs_id")).cast("double"))
    top = P.top_k(o.unpivot(["at", "obs_id", "gross"], list(RANKERS), "ranker", "x"), ["at", "ranker"], 20, F.desc("x"), "obs_id")
    g = F.col("gross")
    means = top.groupBy("ranker").agg(F.avg(g).alias("mean"), F.avg(F.when(g < -1000, 1.0).otherwise(0.0)).alias("cat"), F.avg(F.when(g > 0, g)).alias("win_size"))
    return means.join(quantiles(top, ["ranker"], "gross", {"median_": 0.5}), "ranker")


@query("agg_43_duration_control", "select N(hold_days // 5) as bucket, R(avg(case when surprise_t <= hold_days then 1.0 else 0.0 end)) as rate, N(count(*)) as n from observations where gross >= -1000 group by 1")
def _(t):
    hit = F.coalesce(F.col("surprise_t") <= F.col("hold_days"), F.lit(False))
    return t.observations.where("gross >= -1000").groupBy(F.expr("hold_days div 5").alias("bucket")).agg(F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("rate"), F.count("*").alias("n"))


@query("agg_44_stock_legs", f"select {CLASS} as class, R(avg(case when not l.is_etf or not g.is_etf then 1.0 else 0.0 end)) as any_, R(avg(case when not l.is_etf and not g.is_etf then 1.0 else 0.0 end)) as both_ from observations join ticker_metadata l on l.symbol = lead join ticker_metadata g on g.symbol = lag group by 1")
def _(t):
    dim = lambda leg: t.ticker_metadata.select(F.col("symbol").alias(leg), (~F.col("is_etf")).alias(f"k_{leg}"))
    x = t.observations.join(dim("lead"), "lead").join(dim("lag"), "lag")
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return x.groupBy(_class().alias("class")).agg(rate(F.col("k_lead") | F.col("k_lag")).alias("any_"), rate(F.col("k_lead") & F.col("k_lag")).alias("both_"))


@query("agg_47_weight_share", "with q as (select o_custkey, o_totalprice as v, p_size / cast(p_size + 10 as double) as share from orders join part on p_partkey = 1 + o_orderkey % 2000) select R(corr(a, b)) as rho from (select rank() over (order by share) + (count(*) over (partition by share) - 1) / 2.0 as a, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as b from q)")
def _(t):
    q = t.orders.withColumn("p_partkey", 1 + F.col("o_orderkey") % 2000).join(t.part, "p_partkey").select((F.col("p_size") / (F.col("p_size") + 10)).alias("share"), F.col("o_totalprice").alias("v"))
    return P.spearman(q, [], "share", "v").select("rho")


@query("agg_48_histogram", "select N(greatest(0, least(21, floor((greatest(-2000, least(2000, gross)) + 2000) / 200.0) + 1))) as bin, N(count(*)) as n from observations group by 1")
def _(t):
    g = F.greatest(F.lit(-2000.0), F.least(F.lit(2000.0), F.col("gross")))
    return t.observations.groupBy(F.width_bucket(g, F.lit(-2000.0), F.lit(2000.0), F.lit(20)).alias("bin")).agg(F.count("*").alias("n"))


def _p_sql(r: str, n: str) -> str:
    """Two-sided p-value of a correlation of n rows: the density of r integrated from 0 by Simpson's rule, in SQL."""
    weight = "case when i = 0 or i = 1000 then 1 when i % 2 = 1 then 4 else 2 end"
    area = f"abs({r}) / 3000 * sum({weight} * pow(1 - pow({r} * i / 1000.0, 2), ({n} - 2) / 2.0 - 1))"
    return f"(select greatest(0, least(1, 1 - 2 * exp(lgamma(({n} - 1) / 2.0) - lgamma(0.5) - lgamma(({n} - 2) / 2.0)) * {area})) from range(0, 1001) k(i))"


@query("agg_49_regression_p", f"with o as (select fold, corr_long as x, greatest(-1000, least(1000, gross)) as y from observations), g as (select fold, count(*) as n, regr_slope(y, x) as slope, corr(x, y) as r from o group by fold) select fold, N(n) as n, R(slope) as slope, R(r) as r, R({_p_sql('g.r', 'g.n')}) as p from g")
def _(t):
    from ..operators.inference import slope_test

    return slope_test(t.observations, ["fold"], "corr_long", F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), F.col("gross"))))


@query("agg_50_component_p", "with u as (" + " union all ".join(f"select '{c}' as component, {c} as x, gross from observations" for c in ("corr_long", "corr_short", "z_depth")) + f"), q as (select *, {AVGRANK.format(k='component', x='x')} as a, {AVGRANK.format(k='component', x='gross')} as b from u), g as (select component, count(*) as n, corr(x, gross) as pearson, corr(a, b) as rho from q group by component) select component, N(n) as n, R(pearson) as pearson, R(rho) as rho, R({_p_sql('g.pearson', 'g.n')}) as p_pearson, R({_p_sql('g.rho', 'g.n')}) as p_spearman from g")
def _(t):
    from ..operators.inference import correlation_test

    return correlation_test(t.observations.unpivot(["obs_id", "gross"], ["corr_long", "corr_short", "z_depth"], "component", "x"), ["component"], "x", "gross")


@query("agg_51_decile_error", f"select fold, bin, R(avg(gross)) as mean, R(stddev_samp(gross) / sqrt(count(*))) as se from ({BIN.format(x='corr_short', n=10)}) group by fold, bin")
def _(t):
    return P.quantile_bin(t.observations.select("fold", "obs_id", "corr_short", "gross"), ["fold"], "corr_short", "obs_id", 10).groupBy("fold", "bin").agg(F.avg("gross").alias("mean"), (F.stddev_samp("gross") / F.sqrt(F.count("*"))).alias("se"))


@query("agg_52_friction", "select N(cost) as cost, R(avg(gross) - cost) as net from observations, (values (10), (30)) v(cost) group by cost")
def _(t):
    return t.observations.select("gross", F.explode(F.array(F.lit(10), F.lit(30))).alias("cost")).groupBy("cost").agg((F.avg("gross") - F.col("cost")).alias("net")).withColumn("cost", F.col("cost").cast("long"))


@query("agg_53_sampled_coverage", f"select R(avg(case when surprise_t is not null then 1.0 else 0.0 end)) as rate, N(count(*)) as n from (select surprise_t from observations order by {S.mixed_sql(7, '0', 'obs_id')}, obs_id limit 200)")
def _(t):
    picked = t.observations.orderBy(S.mixed(7, F.lit(0), F.col("obs_id")), "obs_id").limit(200)
    return picked.agg(F.avg(F.when(F.col("surprise_t").isNotNull(), 1.0).otherwise(0.0)).alias("rate"), F.count("*").alias("n"))


@query("smp_01_sample_per_fold", f"select fold, N(obs_id) as obs_id from observations qualify row_number() over (partition by fold order by {S.mixed_sql(7, '0', 'obs_id')}, obs_id) <= 200")
def _(t):
    return P.top_k(t.observations, ["fold"], 200, S.mixed(7, F.lit(0), F.col("obs_id")), "obs_id").select("fold", "obs_id")
