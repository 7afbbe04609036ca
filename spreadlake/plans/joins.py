"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import panel as P
from ..registry import query


@query("join_01_common_days", "select a.day, R(a.close) as pl, R(b.close) as pg from prices a join prices b using (day) where a.symbol = 'Brand#11' and b.symbol = 'Brand#12'")
def _(t):
    pair = t.spark.createDataFrame([("Brand#11", "Brand#12")], "lead string, lag string")
    return P.align(t.prices.where("symbol in ('Brand#11', 'Brand#12')"), pair).select("day", "pl", "pg")


@query("join_02_pairs_within_sector", "select a.symbol as lead, b.symbol as lag from ticker_metadata a join ticker_metadata b on a.sector = b.sector and a.symbol < b.symbol")
def _(t):
    return P.pairs_within(t.ticker_metadata.select("sector", "symbol"), "sector").select("lead", "lag")


@query("join_03_sector_of_legs", "select N(obs_id) as obs_id, a.sector as lead_sector, b.sector as lag_sector from observations left join ticker_metadata a on a.symbol = lead left join ticker_metadata b on b.symbol = lag")
def _(t):
    dim = lambda leg: t.ticker_metadata.select(F.col("symbol").alias(leg), F.col("sector").alias(f"{leg}_sector"))
    return t.observations.join(dim("lead"), "lead", "left").join(dim("lag"), "lag", "left").select("obs_id", "lead_sector", "lag_sector")


@query("join_04_needs_refresh", "select distinct e.symbol from filing_events e left join ticker_metadata m on m.symbol = e.symbol and m.exchange <> 'OTC' where m.symbol is null or (m.sector is null and not m.is_etf)")
def _(t):
    meta = t.ticker_metadata.where("exchange <> 'OTC'").select("symbol", "sector", "is_etf", F.lit(True).alias("known"))
    return t.filing_events.select("symbol").distinct().join(meta, "symbol", "left").where("known is null or (sector is null and not is_etf)").select("symbol")


@query("join_05_exists", "select N(c_custkey) as c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 300000)")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("join_06_count_subquery", "select run_id, max(filled_at) as last from trades t where pair_id in (select pair_id from trades group by pair_id having count(*) >= 5) group by run_id")
def _(t):
    busy = t.trades.groupBy("pair_id").agg(F.count("*").alias("n")).where("n >= 5").select("pair_id")
    return t.trades.join(busy, "pair_id", "left_semi").groupBy("run_id").agg(F.max("filled_at").alias("last"))


@query("join_07_first_entry", "select c_custkey, x.entry from customer, lateral (select min(filled_at) as entry from trades where pair_id = c_custkey and side = 'buy') x where x.entry is not null")
def _(t):
    first = t.trades.where("side = 'buy'").groupBy(F.col("pair_id").alias("c_custkey")).agg(F.min("filled_at").alias("entry"))
    return t.customer.select("c_custkey").join(first, "c_custkey")


ROUND = "select b.run_id, b.symbol, N(b.id) as buy_id, N(s.id) as sell_id, R((s.price - b.price) * b.quantity - coalesce(s.slippage, 0)) as pnl, R(epoch(s.filled_at - b.filled_at) / 86400) as hold_days from trades b join trades s on s.run_id = b.run_id and s.symbol = b.symbol and s.pair_id = b.pair_id and s.side = 'sell' and s.filled_at > b.filled_at where b.side = 'buy'"


@query("join_08_round_trips", ROUND)
def _(t):
    from ..operators.metrics import round_trips

    return round_trips(t.trades).select("run_id", "symbol", "buy_id", "sell_id", "pnl", "hold_days")


@query("join_09_pair_pnl", "select fold, N(pair_id) as pair_id, R(max(z_depth)) as z, R(sum(case when side = 'sell' then quantity * price - slippage else -(quantity * price + slippage) end)) as pnl from (select o_custkey as pair_id, max(fold) as fold, max(z_depth) as z_depth from observations join orders on obs_id = o_orderkey group by o_custkey) p join trades using (pair_id) where leg = 'long' group by fold, pair_id having count(distinct side) = 2")
def _(t):
    from ..operators.metrics import pair_pnl

    p = t.observations.join(t.orders, F.col("obs_id") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("pair_id")).agg(F.max("fold").alias("fold"), F.max("z_depth").alias("z"))
    return p.join(pair_pnl(t.trades.where("leg = 'long'")), "pair_id").select("fold", "pair_id", "z", "pnl")


@query("join_14_remapped", "select case symbol when 'Brand#11' then 'Brand#22' else symbol end as symbol, N(count(*)) as n from filing_events group by 1")
def _(t):
    return E.remap(t.filing_events, "symbol", {"Brand#11": "Brand#22"}).groupBy("symbol").agg(F.count("*").alias("n"))


@query("join_10_asof_backward", "select N(obs_id) as obs_id, max(p.day) as day from observations o join prices p on p.symbol = o.lead and p.day <= o.date group by obs_id")
def _(t):
    from ..operators.asof import asof

    obs = t.observations.select("obs_id", F.col("lead").alias("symbol"), F.col("date").alias("at"))
    return asof(obs, t.prices.select("symbol", "day"), ["symbol"], "at", "day").where("day is not null").select("obs_id", "day")


@query("join_11_asof_forward", "select N(obs_id) as obs_id, min(p.day) as day from observations o join prices p on p.symbol = o.lead and p.day >= o.date - 100 group by obs_id")
def _(t):
    from ..operators.asof import asof

    obs = t.observations.select("obs_id", F.col("lead").alias("symbol"), F.date_sub("date", 100).alias("at"))
    return asof(obs, t.prices.select("symbol", "day"), ["symbol"], "at", "day", forward=True).where("day is not null").select("obs_id", "day")


HELD = "select obs_id, lead, lag, cast(date '2024-01-01' + cast(obs_id % 25 as int) as date) as entry, cast(date '2024-01-01' + cast(obs_id % 25 as int) + hold_days as date) as exit from observations"


def _held(t):
    entry = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("obs_id") % 25).cast("int"))
    return t.observations.select("obs_id", "lead", "lag", entry.alias("entry"), F.date_add(entry, F.col("hold_days")).alias("exit"))


@query("join_12_events_in_hold", f"with h as ({HELD}), e as (select symbol, cast(filed_at as date) as day, bool_or(starts_with(form, '8-K') and contains(items, '4.02')) as restatement, bool_or(form = '6-K' and accession % 40 = 0) as rare from filing_events group by 1, 2) select N(obs_id) as obs_id, coalesce(bool_or(restatement), false) as restatement, coalesce(bool_or(rare), false) as rare from h left join e on e.symbol in (lead, lag) and day > entry - 7 and day <= exit group by obs_id")
def _(t):
    ev = t.filing_events.select("symbol", F.to_date("filed_at").alias("day"), (F.col("form").startswith("8-K") & F.col("items").contains("4.02")).alias("restatement"), ((F.col("form") == "6-K") & (F.col("accession") % 40 == 0)).alias("rare"))
    return E.events_in_hold(_held(t), ev.groupBy("symbol", "day").agg(F.bool_or("restatement").alias("restatement"), F.bool_or("rare").alias("rare")), "obs_id")


@query("join_13_hold_classes", f"with h as ({HELD}), e as (select distinct symbol, cast(filed_at as date) as day from filing_events) select N(obs_id) as obs_id, coalesce(bool_or(day > entry), false) as hold, coalesce(bool_or(day <= entry), false) as pre, coalesce(string_agg(distinct cast(day as varchar), ',' order by cast(day as varchar)), '') as hits from h left join e on e.symbol in (lead, lag) and day >= entry - 7 and day <= exit group by obs_id")
def _(t):
    return E.hold_classes(_held(t), t.filing_events.select("symbol", F.to_date("filed_at").alias("day")).distinct(), "obs_id")


@query("join_15_next_event_offset", "with c as (select symbol, day, row_number() over (partition by symbol order by day) as pos from prices), e as (select distinct symbol, cast('1994-01-01' as date) + cast(accession % 700 as int) as d from filing_events), f as (select e.symbol, e.d, min(pos) as pos from e join c on c.symbol = e.symbol and c.day >= e.d group by 1, 2) select N(min(pos)) as t, d from f group by d")
def _(t):
    from ..operators.asof import asof

    cal = t.prices.withColumn("pos", F.row_number().over(P.ordered(["symbol"], "day"))).select("symbol", "day", "pos")
    ev = t.filing_events.select("symbol", F.date_add(F.lit("1994-01-01").cast("date"), (F.col("accession") % 700).cast("int")).alias("d")).distinct()
    return asof(ev, cal, ["symbol"], "d", "day", forward=True).where("pos is not null").groupBy("d").agg(F.min("pos").cast("long").alias("t"))


@query("join_16_run_discovery", "select run_id, N(count(*)) as n from portfolio_snapshots where day between date '1995-01-01' and date '1995-12-31' group by run_id having count(*) >= 10 order by max(day) desc, count(*) desc, run_id limit 1")
def _(t):
    s = t.portfolio_snapshots.where("day between date '1995-01-01' and date '1995-12-31'").groupBy("run_id").agg(F.count("*").alias("n"), F.max("day").alias("last")).where("n >= 10")
    return s.orderBy(F.desc("last"), F.desc("n"), "run_id").limit(1).select("run_id", "n")


@query("join_17_multi_key_merge", "select N(a.obs_id) as obs_id, R(b.g) as g from observations a left join (select fold, date, lead, lag, max(gross) as g from observations where obs_id % 2 = 0 group by all) b using (fold, date, lead, lag)")
def _(t):
    b = t.observations.where("obs_id % 2 = 0").groupBy("fold", "date", "lead", "lag").agg(F.max("gross").alias("g"))
    return t.observations.select("fold", "date", "lead", "lag", "obs_id").join(b, ["fold", "date", "lead", "lag"], "left").select("obs_id", "g")


@query("join_18_grid", "select entry, exit_, N(count(*) filter (where z_depth * 3 >= entry and corr_long >= exit_)) as n from (values (1.0), (1.5), (2.0)) e(entry), (values (0.25), (0.5)) x(exit_), observations group by 1, 2")
def _(t):
    grid = [(e, x) for e in (1.0, 1.5, 2.0) for x in (0.25, 0.5)]  # a handful of points: a row explodes, no join
    points = F.explode(F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(x).alias("exit_")) for e, x in grid]))
    o = t.observations.select("z_depth", "corr_long", points.alias("p")).select("z_depth", "corr_long", "p.*")
    return o.groupBy("entry", "exit_").agg(F.count_if((F.col("z_depth") * 3 >= F.col("entry")) & (F.col("corr_long") >= F.col("exit_"))).alias("n"))


@query("join_19_trial_pivot", "select N(o_custkey) as trial, R(max(case when o_orderpriority = '1-URGENT' then o_totalprice end)) as urgent, R(max(case when o_orderpriority = '5-LOW' then o_totalprice end)) as low, R(max(c_acctbal)) as value from orders join customer on o_custkey = c_custkey group by o_custkey")
def _(t):
    eav = t.orders.select(F.col("o_custkey").alias("trial"), "o_orderpriority", "o_totalprice").join(t.customer.select(F.col("c_custkey").alias("trial"), F.col("c_acctbal").alias("value")), "trial")
    return eav.groupBy("trial", "value").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.max("o_totalprice")).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("join_20_label_lookup", "select N(s_suppkey) as s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def _(t):
    dim = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))  # a row per country
    return t.supplier.join(dim, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")
