"""Filters, predicates and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import panel as P
from ..registry import query


@query("flt_01_penny_gate", "with l as (select symbol, arg_max(close, day) as c from prices group by symbol) select a.symbol as lead, b.symbol as lag from l a join l b on substr(a.symbol, 1, 7) = substr(b.symbol, 1, 7) and a.symbol < b.symbol where a.c >= 1400 and b.c >= 1400")
def _(t):
    pairs = P.pairs_within(t.ticker_metadata.select("symbol", F.substring("symbol", 1, 7).alias("g")), "g").select("lead", "lag")
    return G.penny_gate(pairs, t.prices, 1400.0)


@query("flt_02_without_failed", "select symbol from ticker_metadata where symbol not in (select symbol from prices group by symbol having arg_max(close, day) < 1500)")
def _(t):
    return t.ticker_metadata.select("symbol").join(t.prices.groupBy("symbol").agg(F.max_by("close", "day").alias("c")).where("c < 1500"), "symbol", "left_anti")


FAILED = "with f as (select o_custkey % 50 as symbol, cast(o_orderdate as date) as ws, cast(o_orderdate as date) + 30 as we, o_orderkey % 10 = 0 as sentinel from orders)"


def _failed(t):
    return t.orders.select((F.col("o_custkey") % 50).alias("symbol"), F.to_date("o_orderdate").alias("ws"), F.date_add(F.to_date("o_orderdate"), 30).alias("we"), (F.col("o_orderkey") % 10 == 0).alias("sentinel"))


@query("flt_03_failed_in_window", f"{FAILED} select distinct symbol from f where ws <= date '1996-03-10' and we >= date '1996-02-01'")
def _(t):
    return G.overlapping(_failed(t), "1996-02-01", "1996-03-10").select("symbol").distinct()


@query("flt_04_failed_global", f"{FAILED} select symbol, N(count(*)) as n from f where sentinel group by symbol")
def _(t):
    rows = _failed(t).withColumn("ws", F.when(F.col("sentinel") & (F.col("symbol") % 2 == 0), F.lit("1970-01-01").cast("date")).when(~F.col("sentinel"), F.col("ws")))
    return rows.where("ws = date '1970-01-01' or ws is null").groupBy("symbol").agg(F.count("*").alias("n"))


@query("flt_05_universe_health", "select N(count(*)) as raw, N(count(*) filter (where not is_etf)) as left_, case when count(*) > 0 and count(*) filter (where not is_etf) = 0 then 'fail' when count(*) >= 500 and count(*) filter (where not is_etf) * 5 < count(*) then 'fail' else 'ok' end as status from ticker_metadata")
def _(t):
    return G.universe_health(t.ticker_metadata.agg(F.count("*").alias("raw"), F.count_if(~F.col("is_etf")).alias("left_")))


@query("flt_06_cooldown", "with e as (select least(lead, lag) as a, greatest(lead, lag) as b, max(date) as last from observations where date < date '1996-01-01' group by 1, 2), c as (select distinct lead, lag from observations) select lead, lag from c left join e on a = least(lead, lag) and b = greatest(lead, lag) where last is null or date '1996-01-04' - last >= 5")
def _(t):
    return G.off_cooldown(t.observations.select("lead", "lag").distinct(), t.observations.where("date < date '1996-01-01'"), "1996-01-04", 5)


@query("flt_07_not_held", "select distinct lead, lag from observations where lead not in (select symbol from ticker_metadata where is_etf) and lag not in (select symbol from ticker_metadata where is_etf)")
def _(t):
    return G.without_legs(t.observations.select("lead", "lag").distinct(), t.ticker_metadata.where("is_etf").select("symbol"))


@query("flt_09_column_coverage", "with n as (select count(distinct day) as d from prices), c as (select symbol, count(close) as k from prices where volume > 100 group by symbol) select symbol, N(k) as bars from c, n where k >= greatest(2, cast(floor(d * 0.5) as bigint))")
def _(t):
    return G.covered_symbols(t.prices.where("volume > 100"), t.prices, 0.5)


@query("flt_10_complete_days", "with s as (select count(distinct symbol) as n from prices) select day from prices, s group by day, n having count(close) = n")
def _(t):
    return G.complete_days(t.prices)


@query("flt_11_dislocation_gate", "select N(obs_id) as obs_id from observations where abs(z_depth * 3) >= 2")
def _(t):
    return t.observations.where(F.abs(F.col("z_depth") * 3) >= 2).select("obs_id")


@query("flt_12_finite_outcomes", "select N(obs_id) as obs_id from observations where next_results_t is not null and gross is not null and not isnan(gross)")
def _(t):
    return t.observations.where("next_results_t is not null and gross is not null and not isnan(gross)").select("obs_id")


@query("flt_13_point_in_time", "select symbol, R(avg(close) filter (where day <= date '1995-06-01')) as before_, R(avg(close) filter (where day > date '1995-06-01' and day <= date '1995-06-01' + 40)) as after_ from prices group by symbol")
def _(t):
    at = F.lit("1995-06-01").cast("date")
    return t.prices.groupBy("symbol").agg(F.avg(F.when(F.col("day") <= at, F.col("close"))).alias("before_"), F.avg(F.when((F.col("day") > at) & (F.col("day") <= F.date_add(at, 40)), F.col("close"))).alias("after_"))


@query("flt_14_metadata_coverage", "select R(100.0 * count(sector) / count(*)) as pct, case when 100.0 * count(sector) / count(*) < 20 then 'error' when 100.0 * count(sector) / count(*) < 50 then 'warn' else 'ok' end as level from ticker_metadata")
def _(t):
    pct = 100.0 * F.count("sector") / F.count("*")
    return t.ticker_metadata.agg(pct.alias("pct")).withColumn("level", F.when(F.col("pct") < 20, "error").when(F.col("pct") < 50, "warn").otherwise("ok"))


@query("flt_15_coverage_report", "select N(count(*)) as total, N(count(sector)) as with_sector, N(sum(case when is_etf then 1 else 0 end)) as etfs from ticker_metadata")
def _(t):
    return t.ticker_metadata.agg(F.count("*").alias("total"), F.count("sector").alias("with_sector"), F.sum(F.when(F.col("is_etf"), 1).otherwise(0)).alias("etfs"))


@query("flt_16_left_out_screen", "with f as (select distinct fold from observations), th as (select f.fold, quantile_cont(corr_long, 0.8) as th from f join observations o on o.fold <> f.fold group by f.fold) select N(obs_id) as obs_id from observations join th using (fold) where corr_long >= th")
def _(t):
    return G.left_out_screen(t.observations, "fold", "corr_long", 0.8).select("obs_id")


@query("flt_17_best_run", "with r as (select run_id, min(day) as lo, max(day) as hi, count(*) as n from portfolio_snapshots group by run_id) select run_id, case when hi >= date '2001-07-01' then 'complete' else 'partial' end as status from r where lo <= date '1995-01-15' and hi >= date '1998-01-01' - 100 order by case when hi >= date '2001-07-01' then 0 else 1 end, n desc, run_id limit 1")
def _(t):
    runs = t.portfolio_snapshots.groupBy("run_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count("*").alias("n"))
    full = F.col("hi") >= "2001-07-01"
    ok = runs.where((F.col("lo") <= "1995-01-15") & (F.col("hi") >= F.date_sub(F.lit("1998-01-01").cast("date"), 100)))
    return ok.orderBy(F.when(full, 0).otherwise(1), F.desc("n"), "run_id").limit(1).select("run_id", F.when(full, "complete").otherwise("partial").alias("status"))


@query("flt_18_run_status", "select run_id, case when count(*) >= 340 then 'COMPLETE' when count(*) > 0 then 'PARTIAL' else 'MISSING' end as status from portfolio_snapshots group by run_id")
def _(t):
    n = F.count("day")
    return t.portfolio_snapshots.groupBy("run_id").agg(F.when(n >= 340, "COMPLETE").when(n > 0, "PARTIAL").otherwise("MISSING").alias("status"))


@query("flt_19_parameter_clamp", "select N(p_partkey) as p_partkey, R(greatest(5, least(p_size * 1.5, 40))) as v from part")
def _(t):
    from ..functions.scalar import clip

    return t.part.select("p_partkey", clip(F.col("p_size") * 1.5, 5.0, 40.0).alias("v"))


@query("flt_20_etf_flag_check", "select R(avg(case when is_etf then 1.0 else 0.0 end)) as share, avg(case when is_etf then 1.0 else 0.0 end) < 0.10 as broken from ticker_metadata")
def _(t):
    return t.ticker_metadata.agg(F.avg(F.when(F.col("is_etf"), 1.0).otherwise(0.0)).alias("share")).withColumn("broken", F.col("share") < 0.10)


@query("flt_21_unknown_coverage", "select symbol, min(cast(filed_at as date)) as first_day from filing_events group by symbol having min(cast(filed_at as date)) > date '2023-12-31'")
def _(t):
    return t.filing_events.groupBy("symbol").agg(F.min(F.to_date("filed_at")).alias("first_day")).where("first_day > date '2023-12-31'")


@query("srt_01_unique_lag_top", "with b as (select lead, lag, R(0.3 * corr_long + 0.3 * corr_short + 0.4 * z_depth) as score, obs_id from observations qualify row_number() over (partition by lag order by R(0.3 * corr_long + 0.3 * corr_short + 0.4 * z_depth) desc, obs_id) = 1) select lead, lag, score from b order by score desc, lag limit 4")
def _(t):
    scored = t.observations.withColumn("score", F.round(0.3 * F.col("corr_long") + 0.3 * F.col("corr_short") + 0.4 * F.col("z_depth"), 6))
    return G.top_unique(scored, "lag", 4, F.desc("score"), "obs_id").select("lead", "lag", "score")


@query("srt_02_pairs_by_corr", "select N(obs_id) as obs_id, R(coalesce(case when obs_id % 9 <> 0 then corr_long end, -1)) as corr from observations order by 2 desc, obs_id limit 100")
def _(t):
    corr = F.coalesce(F.when(F.col("obs_id") % 9 != 0, F.col("corr_long")), F.lit(-1.0))
    return t.observations.select("obs_id", corr.alias("corr")).orderBy(F.desc("corr"), "obs_id").limit(100)


@query("srt_03_cap_per_date", "select N(obs_id) as obs_id from observations qualify row_number() over (partition by date order by corr_long desc, obs_id) <= 3")
def _(t):
    return P.top_k(t.observations, ["date"], 3, F.desc("corr_long"), "obs_id").select("obs_id")


@query("srt_04_latest_rows", "select N(o_orderkey) as o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 3")
def _(t):
    return t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(3).select("o_orderkey")


@query("srt_05_worst_report", "select N(obs_id) as obs_id, R(gross) as gross, N(row_number() over (order by gross, obs_id)) as place from observations order by gross, obs_id limit 25")
def _(t):
    worst = t.observations.orderBy("gross", "obs_id").limit(25)
    return worst.select("obs_id", "gross", F.row_number().over(W.orderBy("gross", "obs_id")).cast("long").alias("place"))


@query("set_01_union", "select symbol from ticker_metadata where sector = 'Energy' union all select symbol from ticker_metadata where is_etf")
def _(t):
    return t.ticker_metadata.where("sector = 'Energy'").select("symbol").unionByName(t.ticker_metadata.where("is_etf").select("symbol"))


@query("set_02_leg_symbols", "select distinct unnest([lead, lag]) as symbol from observations")
def _(t):
    return t.observations.select(F.explode(F.array("lead", "lag")).alias("symbol")).distinct()


@query("set_03_difference", "select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def _(t):
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").distinct()


@query("set_04_intersection", "select day from prices where symbol = 'Brand#11' and volume > 150 intersect select day from prices where symbol = 'Brand#12' and volume > 150")
def _(t):
    days = lambda s: t.prices.where((F.col("symbol") == s) & (F.col("volume") > 150)).select("day")
    return days("Brand#11").intersect(days("Brand#12"))


@query("set_05_universe_changed", "select count(*) > 0 as changed from (select coalesce(a.symbol, b.symbol) from (select symbol from ticker_metadata) a full join (select symbol from ticker_metadata where not is_etf) b on a.symbol = b.symbol where a.symbol is null or b.symbol is null)")
def _(t):
    return G.universe_changed(t.ticker_metadata.select("symbol"), t.ticker_metadata.where("not is_etf").select("symbol"))
