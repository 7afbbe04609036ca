"""Scalars, composite operators, studies and the daily loop."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import clustering as C
from ..operators import cointegration as K
from ..operators import density as D
from ..operators import inference as I
from ..operators import loop as L
from ..operators import observe as O
from ..operators import panel as P
from ..operators import runs as R
from ..operators import tuning as T
from ..operators import unit_root as U
from ..operators.ranks import quantiles
from ..registry import query
from .aggregates import ALIGNED, RETURNS, aligned
from .series import SPREAD, ZS

SIC = "case " + " ".join(f"when sic_code between {low} and {high - 1} then '{name}'" for low, high, name in S.SIC_SECTORS) + " else 'Other' end"


@query("scl_01_sic_sector", f"select N(p_partkey) as p_partkey, {SIC} as sector from (select p_partkey, cast(p_partkey * 7 % 9999 as int) as sic_code from part)")
def _(t):
    return t.part.select("p_partkey", S.sic_sector((F.col("p_partkey") * 7 % 9999).cast("string")).alias("sector"))


@query("scl_02_half_life_score", "select N(obs_id) as obs_id, R(greatest(0, least(1, 1 - ln(greatest(halflife_days, 1)) / ln(60)))) as score from observations")
def _(t):
    return t.observations.select("obs_id", S.half_life_score(F.col("halflife_days"), 60).alias("score"))


@query("scl_03_composite", "select N(obs_id) as obs_id, R(0.3 * corr_long + 0.3 * corr_short + 0.4 * z_depth) as score from observations")
def _(t):
    return t.observations.select("obs_id", S.composite_score(F.col("corr_long"), F.col("corr_short"), F.col("z_depth")).alias("score"))


@query("scl_04_coint_score", "select N(obs_id) as obs_id, R(greatest(0, 1 - coint_pvalue / 0.20)) as score from observations")
def _(t):
    return t.observations.select("obs_id", S.coint_score(F.col("coint_pvalue")).alias("score"))


@query("scl_05_quality_k", "select fold, greatest(1, cast(round_even(cast(17 as double) * greatest(0.25, least(1.0, median(corr_short) / 0.7)), 0) as int)) as k from observations group by fold")
def _(t):
    return quantiles(t.observations, ["fold"], "corr_short", {"m": 0.5}).select("fold", S.quality_k(F.col("m"), 0.7, 0.25, 1.0, 17).alias("k"))


@query("scl_06_position_budget", "select N(obs_id) as obs_id, R((0.01 + corr_long * 0.04) * 100000 * 1.5) as cost from observations")
def _(t):
    return t.observations.select("obs_id", ((0.01 + F.col("corr_long") * 0.04) * 100000 * 1.5).alias("cost"))


@query("scl_07_regime_label", "select N(obs_id) as obs_id, case when corr_long >= 0.30 then 'vol_shock' when corr_long < 0.13 and gross >= 0 then 'calm_bull' when corr_long < 0.18 and gross >= 0.005 then 'trend_bull' else 'sideways' end as regime from observations")
def _(t):
    return t.observations.select("obs_id", S.regime_label(F.col("corr_long"), F.col("gross")).alias("regime"))


@query("scl_08_add_months", "select N(o_orderkey) as o_orderkey, cast(cast(o_orderdate as date) + interval 1 month as date) as d from orders")
def _(t):
    return t.orders.select("o_orderkey", F.add_months(F.to_date("o_orderdate"), 1).alias("d"))


@query("scl_09_complexity", "select fold, R(9 / cast(count(distinct date) as double)) as ratio, 9 / cast(count(distinct date) as double) > 0.1 as flagged from observations group by fold")
def _(t):
    x = t.observations.groupBy("fold").agg((F.lit(9.0) / F.countDistinct("date")).alias("ratio"))
    return x.withColumn("flagged", F.col("ratio") > 0.1)


@query("scl_10_weight_normalised", "select N(obs_id) as obs_id, R(corr_long / nullif(corr_long + corr_short + z_depth, 0)) as w from observations")
def _(t):
    return t.observations.select("obs_id", (F.col("corr_long") / F.nullif(F.col("corr_long") + F.col("corr_short") + F.col("z_depth"), F.lit(0.0))).alias("w"))


@query("scl_11_objective", "select R(0.5 * avg(m) + 0.5 * min(m)) as objective from (select avg(gross) as m from observations group by fold)")
def _(t):
    return t.observations.groupBy("fold").agg(F.avg("gross").alias("m")).agg((0.5 * F.avg("m") + 0.5 * F.min("m")).alias("objective"))


@query("scl_12_forward_bps", "select N(obs_id) as obs_id, R(-sign(gross) * (corr_long - corr_short) / (1 + abs(z_depth)) * 1e4) as bps from observations")
def _(t):
    return t.observations.select("obs_id", S.forward_bps(F.col("gross"), F.col("corr_short"), F.col("corr_long"), F.col("z_depth")).alias("bps"))


@query("scl_13_borrow", "select N(obs_id) as obs_id, R(0.01 * (corr_long / (1 + corr_long)) * (hold_days / 252.0) * 1e4) as borrow from observations")
def _(t):
    return t.observations.select("obs_id", S.borrow_bps(F.col("corr_long"), F.col("hold_days")).alias("borrow"))


@query("scl_14_item_groups", "select accession, starts_with(form, '8-K') and contains(items, '2.02') as results, starts_with(form, '8-K') and (contains(items, '1.01') or contains(items, '2.01')) as deals, starts_with(form, '8-K') and contains(items, '5.02') as exec_change, starts_with(form, '8-K') and contains(items, '4.02') as restatement, starts_with(form, '8-K') and contains(items, '7.01') as guidance, form = '6-K' as foreign_ from filing_events")
def _(t):
    g = S.filing_groups(F.col("form"), F.col("items"))
    return t.filing_events.select("accession", *[c.alias("foreign_" if k == "foreign" else k) for k, c in g.items()])


@query("scl_15_instrument_class", "select N(c_custkey) as c_custkey, case when c_nationkey = 1 then 'etf' when regexp_matches(s, '\\.PR[A-Z]?$|-P[A-Z]?$') then 'preferred' else 'stock' end as class from (select *, case c_custkey % 3 when 0 then 'ABC.PRA' when 1 then 'XY-P' else 'Q' end as s from customer)")
def _(t):
    s = F.element_at(F.array(F.lit("ABC.PRA"), F.lit("XY-P"), F.lit("Q")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return t.customer.select("c_custkey", S.instrument_class(s, F.col("c_nationkey") == 1).alias("class"))


@query("scl_16_regime_map", "select run_id, case run_id when 'BUILDING' then 'calm' when 'MACHINERY' then 'shock' else 'other' end as regime from (select distinct run_id from trades)")
def _(t):
    names = F.create_map(F.lit("BUILDING"), F.lit("calm"), F.lit("MACHINERY"), F.lit("shock"))
    return t.trades.select("run_id").distinct().select("run_id", F.coalesce(names[F.col("run_id")], F.lit("other")).alias("regime"))


@query("scl_17_dates", "select N(event_id) as event_id, cast(ts as date) as d, R(epoch(ts - timestamp '2024-01-01 00:00:00') / 86400) as days_ from events")
def _(t):
    diff = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return t.events.select("event_id", F.to_date("ts").alias("d"), (diff / 86400e6).alias("days_"))


@query("scl_18_json_text", "select N(event_id) as event_id, json_extract_string(props, '$.k') as k from events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("scl_19_zero_pad", "select N(c_custkey) as c_custkey, lpad(cast(c_custkey as varchar), 10, '0') as cik from customer")
def _(t):
    return t.customer.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"))


@query("scl_20_winsorised", "select N(obs_id) as obs_id, R(greatest(-500, least(500, gross))) as g from observations")
def _(t):
    return t.observations.select("obs_id", S.clip(F.col("gross"), -500.0, 500.0).alias("g"))


@query("scl_21_iso_time", "select N(event_id) as event_id, date_trunc('second', ts) as at from events")
def _(t):
    return t.events.select("event_id", F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("at"))


@query("scl_22_corr_distance", "select N(obs_id) as obs_id, R(case when obs_id % 11 <> 0 then greatest(0, least(2, 1 - (corr_long * 3 - 1.5))) else 1 end) as d from observations")
def _(t):
    return t.observations.select("obs_id", S.correlation_distance(F.when(F.col("obs_id") % 11 != 0, F.col("corr_long") * 3 - 1.5)).alias("d"))


@query("scl_23_percentile_of", "select fold, R(100 * avg(case when gross <= 0 then 1.0 else 0.0 end)) as pct from observations group by fold")
def _(t):
    return t.observations.groupBy("fold").agg((100 * F.avg(F.when(F.col("gross") <= 0, 1.0).otherwise(0.0))).alias("pct"))


@query("scl_24_null_z", "select fold, R((100 - avg(gross)) / stddev_samp(gross)) as z from observations group by fold")
def _(t):
    return t.observations.groupBy("fold").agg(((100 - F.avg("gross")) / F.stddev_samp("gross")).alias("z"))


@query("scl_25_day_of_regime", "select N(id) as id, N(cast(filled_at as date) - case when filled_at < timestamp '1998-01-01 00:00:00' then date '1995-01-01' else date '1998-01-01' end) as day_ from trades")
def _(t):
    start = F.when(F.col("filled_at") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), F.lit("1995-01-01").cast("date")).otherwise(F.lit("1998-01-01").cast("date"))
    return t.trades.select("id", F.datediff(F.to_date("filled_at"), start).cast("long").alias("day_"))


def _tau_sql(series: str, c: int) -> str:
    """lead, lag, n, lags, tau of a table ser (lead, lag, day, s): regressions by elimination in matrices of products; c: 1 with a constant."""
    one = "[1.0::double]" if c else "[]::double[]"
    step = "list_transform(range(1, w * w + 1), lambda x: case when (x - 1) // w >= k + 1 and (x - 1) % w >= k + 1 and m[k * w + k + 1] > 0 then m[x] - m[(x - 1) // w * w + k + 1] * m[k * w + (x - 1) % w + 1] / m[k * w + k + 1] else m[x] end)"
    return f"""with recursive {series},
rw as (select lead, lag, s, row_number() over p as r, count(*) over (partition by lead, lag) as n, lag(s) over p as level, s - lag(s) over p as d from ser window p as (partition by lead, lag order by day)),
ar as (select lead, lag, any_value(n) as n, greatest(least(cast(ceil(12 * pow(any_value(n) / 100.0, 0.25)) as int), any_value(n) // 2 - 2 - {c}), 0) as most, list(d order by r) as d, list(level order by r) as l from rw group by lead, lag),
cv as (select lead, lag, n, most, r, list_concat([l[r]], {one}, list_transform(range(1, most + 1), lambda k: d[r - k]), [d[r]]) as v from (select *, unnest(range(most + 2, n + 1)) as r from ar)),
cm as (select lead, lag, any_value(n) as n, any_value(most) as most, i, j, sum(v[i] * v[j]) as m from (select *, unnest(range(1, len(v) + 1)) as i from cv), unnest(range(1, len(v) + 1)) q(j) group by lead, lag, i, j),
el as (select lead, lag, any_value(n) as n, any_value(most) as most, max(i) as w, 0 as k, list(m order by i, j) as m from cm group by lead, lag union all select lead, lag, n, most, w, k + 1, {step} from el where k < w - 1),
best as (select lead, lag, n, k - 1 - {c} as p from el where k >= 1 + {c} qualify row_number() over (partition by lead, lag order by (n - 1 - most) * ln(greatest(m[w * w], 1e-300) / (n - 1 - most)) + 2 * k, k) = 1),
fv as (select lead, lag, n, p, list_concat(list_transform(range(1, p + 1), lambda k: d[r - k]), {one}, [l[r]], [d[r]]) as v from (select ar.*, p, unnest(range(p + 2, ar.n + 1)) as r from ar join best using (lead, lag))),
fm as (select lead, lag, any_value(n) as n, any_value(p) as p, i, j, sum(v[i] * v[j]) as m from (select *, unnest(range(1, len(v) + 1)) as i from fv), unnest(range(1, len(v) + 1)) q(j) group by lead, lag, i, j),
fe as (select lead, lag, any_value(n) as n, any_value(p) as p, max(i) as w, 0 as k, list(m order by i, j) as m from fm group by lead, lag union all select lead, lag, n, p, w, k + 1, {step} from fe where k < w - 2),
z as (select lead, lag, n, p, m[w * w] as yy, m[w * w - 1] as sy, m[w * w - w - 1] as ss, greatest(n - 1 - p - (w - 1), 1) as df from fe where k = w - 2)
select lead, lag, N(n) as n, cast(p as int) as lags, R(sy / ss / sqrt((yy - sy * sy / ss) / df / ss)) as tau from z"""


@query("udx_01_unit_root_tau", _tau_sql(f"{ALIGNED}, ft as (select lead, lag, regr_slope(ln(pl), ln(pg)) as u, avg(ln(pl)) as my, avg(ln(pg)) as mx from al group by lead, lag), ser as (select lead, lag, day, ln(pl) - my - u * (ln(pg) - mx) as s from al join ft using (lead, lag))", 0))
def _(t):
    return U.statistics(K.residuals(aligned(t)), ["lead", "lag"], "pos", "s", constant=False)


@query("udx_02_unit_root_tau", _tau_sql(f"{SPREAD}, ser as (select lead, lag, day, s from sp)", 1))
def _(t):
    return U.statistics(P.spread(aligned(t)), ["lead", "lag"], "pos", "s", constant=True)


@query("udx_01_cointegration")
def _(t):
    return K.cointegration(aligned(t))


@query("udx_02_spread_unit_root")
def _(t):
    return K.spread_unit_root(P.spread(aligned(t)))


def _blocks(t):
    """partition, symbol; and the returns of each partition's symbols in blocks."""
    meta = t.ticker_metadata.select("symbol", C.partition_of(F.col("sector"), F.col("is_etf")).alias("partition"))
    return meta, D.return_blocks(P.log_returns(t.prices), meta)


@query("udx_03_clusters")
def _(t):
    meta = t.ticker_metadata.select("symbol", C.partition_of(F.col("sector"), F.col("is_etf")).alias("partition"))
    return D.cluster_returns(P.log_returns(t.prices), meta)


@query("udx_05_partitions", "select symbol, case when is_etf then 'ETF' else coalesce(sector, 'Unknown') end as partition from ticker_metadata")
def _(t):
    return t.ticker_metadata.select("symbol", C.partition_of(F.col("sector"), F.col("is_etf")).alias("partition"))


@query("udx_06_ranked_clusters")
def _(t):
    meta, blocks = _blocks(t)
    corr = D.pair_correlations(blocks)
    return C.ranked_clusters(C.sane(D.cluster_returns(P.log_returns(t.prices), meta), corr, 0.0), corr)


@query("udx_04_kept_components")
def _(t):
    meta, blocks = _blocks(t)
    return C.kept_components(D.pair_correlations(blocks), meta, 0.9)


GROUPS = "with r as (select symbol, day, ln(close) - lag(ln(close)) over (partition by symbol order by day) as r from prices), c as (select substr(a.symbol, 1, 7) as partition, a.symbol as a, b.symbol as b, corr(a.r, b.r) as rho from r a join r b on a.day = b.day and substr(a.symbol, 1, 7) = substr(b.symbol, 1, 7) and a.symbol < b.symbol where a.r is not null and b.r is not null group by 1, 2, 3), m as (select partition, median(rho) as m, avg(rho) as y from c group by partition), g as (select substr(symbol, 1, 7) as partition, symbol, count(*) over (partition by substr(symbol, 1, 7)) as n from ticker_metadata)"


def _groups(t):
    labels = t.ticker_metadata.select(F.substring("symbol", 1, 7).alias("partition"), "symbol", F.lit(0).alias("label"))
    r = P.log_returns(t.prices).where("ret is not null").withColumn("partition", F.substring("symbol", 1, 7))
    a, b = r.select("partition", "day", F.col("symbol").alias("a"), F.col("ret").alias("ra")), r.select("partition", "day", F.col("symbol").alias("b"), F.col("ret").alias("rb"))
    return labels, a.join(b, ["partition", "day"]).where("a < b").groupBy("partition", "a", "b").agg(P.safe_corr("ra", "rb").alias("rho"))


@query("udx_06_sanity_gate", f"{GROUPS} select g.partition, symbol, case when m >= 0.01 then 0 else -1 end as label from g left join m using (partition)")
def _(t):
    return C.sane(*_groups(t), 0.01)


@query("udx_06_cluster_ranks", f"{GROUPS}, k as (select partition, cast(row_number() over (order by round(y * n, 9) desc, partition) as int) as k from (select distinct partition, n, y from g join m using (partition) where m >= 0.01)) select g.partition, symbol, coalesce(k, (select cast(count(*) + 1 as int) from k)) as cluster_rank from g left join k using (partition)")
def _(t):
    labels, corr = _groups(t)
    return C.ranked_clusters(C.sane(labels, corr, 0.01), corr).select("partition", "symbol", "cluster_rank")


AT = "where a.day <= date '1996-06-30' and a.day >= date '1996-06-30' - 1400"
ZS_AT = ZS.replace("on b.symbol = lag and b.day = a.day", f"on b.symbol = lag and b.day = a.day {AT}")
OBSERVED = f"{ZS_AT}, zl as (select lead, lag, arg_max(z, day) as z from zs where z is not null group by lead, lag), rb as (select lead, lag, ln(pl) - lag(ln(pl)) over w as rl, ln(pg) - lag(ln(pg)) over w as rg, row_number() over (partition by lead, lag order by day desc) as k from al window w as (partition by lead, lag order by day)), rc as (select lead, lag, case when count(rl) filter (where k <= 90) >= 90 then corr(rl, rg) filter (where k <= 90) end as corr_long, case when count(rl) filter (where k <= 20) >= 20 then corr(rl, rg) filter (where k <= 20) end as corr_short from rb where rl is not null group by lead, lag)"


@query("udx_12_observations", f"with {OBSERVED} select lead, lag, R(z) as z, R(corr_long) as corr_long, R(corr_short) as corr_short, R(greatest(0, least(1, (-z - 0.2) / 0.3))) as z_depth from zl left join rc using (lead, lag) where abs(z) >= 0.5")
def _(t):
    return O.observations(aligned(t), "1996-06-30", 1400, 20, 0.5, 0.2, 90, 20)


UNIT = f"""with r as (select fold, obs_id, rank() over (partition by fold order by corr_long) + (count(*) over (partition by fold, corr_long) - 1) / 2.0 as a, rank() over (partition by fold order by gross) + (count(*) over (partition by fold, gross) - 1) / 2.0 as b from observations),
d as (select fold, draw, a, b, {I.poisson_weight_sql(7, 'draw', 'obs_id')} as w from r, (select unnest(range(1, 51)) as draw)),
m as (select fold, draw, cast(sum(w) as double) as sw, sum(w * a) as wa, sum(w * b) as wb, sum(w * a * b) as ab, sum(w * a * a) as aa, sum(w * b * b) as bb from d group by fold, draw),
q as (select fold, (ab / sw - wa / sw * (wb / sw)) / nullif(sqrt(greatest((aa / sw - wa / sw * (wa / sw)) * (bb / sw - wb / sw * (wb / sw)), 0)), 0) as rho from m),
ci as (select fold, quantile_cont(rho, 0.025) as low, quantile_cont(rho, 0.975) as high from q group by fold), o as (select fold, count(*) as n, corr(a, b) as rho from r group by fold)
select fold, N(n) as n, R(rho) as rho, R(low) as low, R(high) as high, low > 0 or high < 0 as excludes_zero from o join ci using (fold)"""


@query("udx_23_unit_signal", UNIT)
def _(t):
    return T.unit_signal(t.observations, "fold", "corr_long", "gross", 50, 7, "obs_id")


LINE = """with s as (select fold, cast(count(*) as double) as n, sum(corr_long) as x, sum(gross) as y, sum(corr_long * corr_long) as xx, sum(corr_long * gross) as xy, sum(gross * gross) as yy from observations group by fold),
o as (select fold, n, x, y, xx, xy, yy, sum(n) over () - n as rn, sum(x) over () - x as rx, sum(y) over () - y as ry, sum(xx) over () - xx as rxx, sum(xy) over () - xy as rxy, sum(yy) over () - yy as ryy from s),
f as (select *, (rn * rxy - rx * ry) / nullif(rn * rxx - rx * rx, 0) as u from o), g as (select *, (ry - u * rx) / rn as v from f),
e as (select fold, 1 - (ryy - 2 * u * rxy - 2 * v * ry + u * u * rxx + 2 * u * v * rx + v * v * rn) / nullif(ryy - ry * ry / rn, 0) as train, 1 - (yy - 2 * u * xy - 2 * v * y + u * u * xx + 2 * u * v * x + v * v * n) / nullif(yy - y * y / n, 0) as holdout from g)"""


@query("udx_24_holdout_gap", f"{LINE} select fold as \"group\", R(train) as train, R(holdout) as holdout, R(train - holdout) as gap from e")
def _(t):
    return T.holdout_gap(t.observations, "fold", *T.line("corr_long", "gross"))


NULLS = f"""with recursive o as (select *, row_number() over (order by fold, yr, obs_id) as n from (select fold, cast(date_trunc('year', date) as date) as yr, obs_id, corr_long, gross from observations)),
best as (select *, row_number() over (partition by fold, yr order by corr_long desc, obs_id) as k from o qualify k <= 20),
real as (select avg(m) as real from (select avg(gross) as m from best group by fold, yr)),
cells as (select fold, yr, min(n) as first, count(*) as size, row_number() over (order by fold, yr) - 1 as no from o group by fold, yr),
dr as (select unnest(range(1, 51)) as d),
pr as (select 'random' as "null", d, d + 50 * no as draw, fold, yr, first, size, unnest(range(0, least(20, size))) as spot from cells, dr),
ps as (select 'shuffle', d, d, fold, yr, 1, (select count(*) from o), row_number() over (partition by d order by fold, yr, k) - 1 from best, dr),
pk as materialized (select *, row_number() over (order by "null", d, fold, yr, spot) as id from (select * from pr union all select * from ps)),
walk as ({T.permuted_sql('pk', 7)}),
wk as (select id, l * cast(ceil(sqrt(cast(size as double))) as bigint) + r as place from walk where {T.ARRIVED}),
al as (select "null", d, avg(m) as m from (select "null", d, avg(gross) as m from pk join wk using (id) join o on o.n = first + place group by pk.fold, pk.yr, "null", d) group by "null", d)
select "null", R(any_value(real)) as real, R(avg(m)) as mean, R(stddev_samp(m)) as sd, R((any_value(real) - avg(m)) / stddev_samp(m)) as z, R(100 * avg(case when m <= real then 1.0 else 0.0 end)) as percentile from al, real group by 1"""


@query("udx_25_null_baseline", NULLS)
def _(t):
    o = t.observations.select("fold", F.to_date(F.date_trunc("year", "date")).alias("at_"), "obs_id", "corr_long", "gross")
    return T.null_baseline(o, ["fold", "at_"], "corr_long", "gross", 20, 50, 7, "obs_id")


@query("udx_27_report_panel", f"""{LINE}, u as ({UNIT.replace('with r as', 'with r as', 1)}), n as (select percentile from ({NULLS}) where "null" = 'random'), rg as (select max(gross) - min(gross) as x from observations)
select 'complexity' as guard, case when 9 / cast((select count(distinct date) from observations) as double) > 0.1 then 'RED' else 'GREEN' end as verdict, R(9 / cast((select count(distinct date) from observations) as double)) as value
union all select 'unit signal', case when count(*) filter (where excludes_zero) > 0 then 'PASS' else 'FAIL' end, R(count(*) filter (where excludes_zero)) from u
union all select 'null baseline', case when percentile >= 90 then 'PASS' else 'FAIL' end, R(percentile) from n
union all select 'holdout gap', case when avg(holdout) > 0 and avg(train - holdout) <= abs(avg(holdout)) then 'PASS' else 'FAIL' end, R(avg(train - holdout)) from e
union all select 'seed stability', case when x > 5000 then 'FAIL' else 'PASS' end, R(x) from rg""")
def _(t):
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a row for each group, null or guard
    o = t.observations.select("fold", F.to_date(F.date_trunc("year", "date")).alias("at_"), "obs_id", "corr_long", "gross")
    null = T.null_baseline(o, ["fold", "at_"], "corr_long", "gross", 20, 50, 7, "obs_id").where("`null` = 'random'").first()
    one = t.observations.agg((F.lit(9.0) / F.countDistinct("date")).alias("ratio"), (F.max("gross") - F.min("gross")).alias("range_")).first()
    got = T.report_panel(
        complexity={"ratio": one["ratio"], "flagged": one["ratio"] > 0.1}, unit_signal=rows(T.unit_signal(t.observations, "fold", "corr_long", "gross", 50, 7, "obs_id")), null=null.asDict(),
        holdout=rows(T.holdout_gap(t.observations, "fold", *T.line("corr_long", "gross"))), stability={"range_": one["range_"], "flagged": one["range_"] > 5000},
    )
    return t.spark.createDataFrame(got, "guard string, verdict string, value double")


@query("udx_26_seed_stability", "select fold, R(min(gross)) as low, R(median(gross)) as median_, R(max(gross)) as high, R(max(gross) - min(gross)) as range_ from observations group by fold")
def _(t):
    return T.seed_stability(t.observations, ["fold"], "gross")


@query("udx_28_folds", "select cast(i as int) as fold, cast(date '1992-01-31' + to_months(cast(i * 3 as int)) as date) as train_start, cast(cast(date '1992-01-31' + to_months(cast(i * 3 as int)) as date) + to_months(12) as date) as train_end, cast(cast(date '1992-01-31' + to_months(cast(i * 3 as int)) as date) + to_months(15) as date) as test_end from range(0, 30) r(i) where cast(cast(date '1992-01-31' + to_months(cast(i * 3 as int)) as date) + to_months(15) as date) <= date '1998-07-31' + 1")
def _(t):
    return T.folds(t.spark, "1992-01-31", "1998-07-31", 12, 3)


@query("udx_29_embargoed_splits", "with d as (select date, ntile(6) over (order by date) as part from (select distinct date from observations)), p as (select part, min(date) as lo, max(date) as hi from d group by part) select cast(a.part as int) as split, a.hi as train_end, greatest(b.lo, a.hi + 10) as eval_start, b.hi as eval_end from p a join p b on b.part = a.part + 1 where greatest(b.lo, a.hi + 10) <= b.hi")
def _(t):
    return T.embargoed_splits(t.observations, 5, 10)


@query("udx_30_suggestions")
def _(t):
    return t.spark.createDataFrame([{"trial": i, **T.suggest(i)} for i in range(20)])


@query("udx_32_regime_features", "with b as (select day, avg(close) as x from prices group by day), r as (select day, ln(x / lag(x) over (order by day)) as lr, x / lag(x, 20) over (order by day) - 1 as r20, x from b), v as (select *, case when count(lr) over f >= 20 then stddev_samp(lr) over f * sqrt(252) end as vol from r window f as (order by day rows between 19 preceding and current row)), y as (select year(day) as y, avg(vol) as vol, avg(r20) as ret, arg_max(x, day) / arg_min(x, day) - 1 as total, count(*) as n from v group by 1), sr as (select symbol, day, close / nullif(lag(close) over (partition by symbol order by day), 0) - 1 as r from prices), dd as (select day, stddev_samp(r) as s from sr where r is not null group by day having count(*) >= 20), di as (select year(day) as y, avg(s) as dispersion from dd group by 1) select N(y) as year_, R(vol) as vol, R(ret) as ret, R(total) as total, R(dispersion) as dispersion, case when n < 15 then 'unknown' when vol >= 0.30 then 'vol_shock' when vol < 0.13 and ret >= 0 then 'calm_bull' when vol < 0.18 and ret >= 0.005 then 'trend_bull' else 'sideways' end as regime from y left join di using (y)")
def _(t):
    from pyspark.sql import Window as W

    b = t.prices.groupBy("day").agg(F.avg("close").alias("x"))
    w = W.orderBy("day")  # a calendar
    r = b.withColumn("lr", F.log(F.col("x") / F.lag("x").over(w))).withColumn("r20", F.col("x") / F.lag("x", 20).over(w) - 1)
    f = w.rowsBetween(-19, 0)
    v = r.withColumn("vol", F.when(F.count("lr").over(f) >= 20, F.stddev_samp("lr").over(f) * F.sqrt(F.lit(252.0))))
    y = v.groupBy(F.year("day").cast("long").alias("year_")).agg(F.avg("vol").alias("vol"), F.avg("r20").alias("ret"), (F.max_by("x", "day") / F.min_by("x", "day") - 1).alias("total"), F.count("*").alias("n"))
    spread = P.simple_returns(t.prices).where("ret is not null").groupBy("day").agg(F.stddev_samp("ret").alias("s"), F.count("*").alias("n")).where("n >= 20")
    y = y.join(spread.groupBy(F.year("day").cast("long").alias("year_")).agg(F.avg("s").alias("dispersion")), "year_", "left")
    return y.select("year_", "vol", "ret", "total", "dispersion", F.when(F.col("n") < 15, "unknown").otherwise(S.regime_label(F.col("vol"), F.col("ret"))).alias("regime"))


SIDES = """with g as (select fold, count(distinct date_trunc('week', date)) >= 300 and fold <> 'FURNITURE' as warm, avg(gross) filter (where corr_long > 0.5 and fold <> 'MACHINERY') as a, avg(gross) filter (where corr_long <= 0.5) as b from observations group by fold)"""


def _battery(t):
    x = t.observations.groupBy(F.col("fold").alias("regime"))
    warmth = x.agg(((F.countDistinct(F.date_trunc("week", "date")) >= 300) & (F.first("fold") != "FURNITURE")).alias("warm"))
    side = lambda c: t.observations.where(c).groupBy(F.col("fold").alias("regime")).agg(F.avg("gross").alias("score"))
    return T.battery(side("corr_long > 0.5 and fold <> 'MACHINERY'"), warmth, "tuned"), T.battery(side("corr_long <= 0.5"), warmth, "default")


@query("udx_33_battery", f"{SIDES} select 'tuned' as label, fold as regime, case when not warm then 'cold' when a is null then 'error' else 'done' end as status, R(case when warm then a end) as score from g union all select 'default', fold, case when not warm then 'cold' when b is null then 'error' else 'done' end, R(case when warm then b end) from g")
def _(t):
    a, b = _battery(t)
    return a.unionByName(b)


@query("udx_33_battery_report", f"{SIDES} select fold as regime, R(case when warm then a end) as score_a, R(case when warm then b end) as score_b, case when not warm then 'SKIP' when a is null or b is null then 'N/A' when a > b + 0.01 then 'a' when b > a + 0.01 then 'b' else 'TIE' end as winner from g")
def _(t):
    return T.battery_report(*_battery(t))


@query("udx_33_battery_gate", f"{SIDES} select N(count(*)) as completed, N(count(*) filter (where a > b)) as wins, case when count(*) = 0 then 'INCONCLUSIVE' when count(*) filter (where a > b) >= 2 then 'PASS' else 'FAIL' end as verdict from g where warm and a is not null and b is not null")
def _(t):
    return T.battery_gate(*_battery(t), least_wins=2)


TRIALS = "with tr as (select 's' || cast(o_custkey % 3 as varchar) as study, o_orderkey as trial, case o_orderstatus when 'F' then 'COMPLETE' when 'O' then 'FAIL' else 'PRUNED' end as state, o_totalprice as value, o_custkey % 7 + 1.0 as w_a, o_orderkey % 5 + 1.0 as w_b from orders)"


def _trials(t):
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "O", "FAIL").otherwise("PRUNED")
    return t.orders.select(F.concat(F.lit("s"), F.col("o_custkey") % 3).alias("study"), F.col("o_orderkey").alias("trial"), state.alias("state"), F.col("o_totalprice").alias("value"), (F.col("o_custkey") % 7 + 1).cast("double").alias("w_a"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("w_b"))


@query("loop_01_study_base", f"{TRIALS}, b as (select * from tr where study = 's1' and state = 'COMPLETE' order by value desc, trial limit 1) select R(w_a / (w_a + w_b)) as w_a, R(w_b / (w_a + w_b)) as w_b, cast(20 as int) as max_k, R(0) as short_leg_fraction from b")
def _(t):
    base = T.study_base(_trials(t), "s1", {"max_k": 20}, ("w_a", "w_b"))
    return t.spark.createDataFrame([base], "w_a double, w_b double, max_k int, short_leg_fraction double")


@query("loop_02_phase_gate", f"{TRIALS}, b as (select value as best from tr where study = 's2' and state = 'COMPLETE' order by value desc, trial limit 1), l as (select avg(value) as baseline from tr) select R(best) as best, R(baseline) as baseline, R(best - baseline) as delta, case when best - baseline > 0 then 'PASS' else 'FAIL' end as verdict from b, l")
def _(t):
    x = _trials(t)
    return T.phase_gate(x, "s2", x.agg(F.avg("value").alias("score")))


@query("udx_35_best_per_regime", "select fold, N(arg_max(obs_id, (gross, -obs_id))) as best from observations group by fold")
def _(t):
    return t.observations.groupBy("fold").agg(F.max_by("obs_id", F.struct("gross", -F.col("obs_id"))).alias("best"))


# The day's state: a held pair, one that waits, one without prices; two evaluations, of which one is recent.
DAY = "1996-06-30"
TODAY = L.Settings(lookback=1400, window=20, entry=0.5, exit=0.2, budget=12, cooldown=5, penny=1300.0, max_k=8)
BOOK = [("Brand#11", "Brand#12", True), ("Brand#21", "Brand#23", False), ("Brand#1", "Brand#99", True), ("Brand#2", "Brand#22", True)]
EVALUATED = [("Brand#14", "Brand#13", "1996-06-28"), ("Brand#15", "Brand#13", "1996-06-01")]
START = 1


def _state(t):
    book = t.spark.createDataFrame([(a, b, 0.5, 0.5, 0.5, h) for a, b, h in BOOK], "lead string, lag string, score double, corr_short double, z_depth double, held boolean")
    seen = t.spark.createDataFrame(EVALUATED, "lead string, lag string, d string").select("lead", "lag", F.to_date("d").alias("date"))
    coint = t.spark.createDataFrame([], "lead string, lag string, at date, coint_pvalue double, halflife_days double")
    return L.State(book, seen, coint, START)


def _clustered(t):
    """Clusters are the symbols of a common beginning, in order; pairs carry their correlation over all days."""
    r = P.pair_returns(aligned(t)).where("rl is not null").groupBy("lead", "lag").agg(P.safe_corr("rl", "rg").alias("corr"))
    rank = F.substring("lead", 7, 1).cast("int") - 1
    return r.select(rank.alias("cluster_rank"), F.lit(5).alias("n_clusters"), "corr", "lead", "lag")


def _day(t):
    return L.daily_scoring(t.prices, _clustered(t), _state(t), DAY, TODAY, cointegrated=False)


BOOK_ROWS = ", ".join(f"('{a}', '{b}', {str(h).lower()})" for a, b, h in BOOK)
SEEN_ROWS = ", ".join(f"('{a}', '{b}', date '{d}')" for a, b, d in EVALUATED)
SCORED = f"""{OBSERVED}, bk as (select * from (values {BOOK_ROWS}) v(lead, lag, held)), se as (select * from (values {SEEN_ROWS}) v(lead, lag, date)),
co as (select *, round(0.3 * greatest(0, least(1, coalesce(corr_long, 0))) + 0.3 * greatest(0, least(1, coalesce(corr_short, 0))) + 0.4 * z_depth, 9) as score from (select lead, lag, z, corr_long, corr_short, case when z is null then 0 else greatest(0, least(1, (-z - 0.2) / 0.3)) end as z_depth from (select lead, lag, arg_max_null(z, day) as z from zs group by lead, lag) left join rc using (lead, lag))),
cl as (select lead, lag, (cast(substr(lead, 7, 1) as int) - 1 - {START} + 5) % 5 as turn, round(coalesce(corr(rl, rg), -1), 9) as c from (select a.symbol as lead, b.symbol as lag, ln(a.close) - lag(ln(a.close)) over w as rl, ln(b.close) - lag(ln(b.close)) over w as rg from prices a join prices b on a.day = b.day and substr(a.symbol, 1, 7) = substr(b.symbol, 1, 7) and a.symbol < b.symbol window w as (partition by a.symbol, b.symbol order by a.day)) where rl is not null group by lead, lag),
lc as (select symbol, arg_max(close, day) as c from prices a {AT} group by symbol),
rs as (select cl.*, x.c as c1, y.c as c2 from cl left join lc x on x.symbol = lead left join lc y on y.symbol = lag where lead not in (select unnest([lead, lag]) from bk) and lag not in (select unnest([lead, lag]) from bk)
  and not exists (select 1 from se where least(se.lead, se.lag) = cl.lead and greatest(se.lead, se.lag) = cl.lag and date '{DAY}' - se.date < 5)),
go as (select *, row_number() over (order by turn, c desc, lead, lag) as k from rs where c1 >= 1300 and c2 >= 1300 qualify k <= 12),
ol as (select bk.lead, bk.lag, held, co.score, co.corr_short, co.z_depth, case when co.score is null then 'data_missing' when held and z > -0.2 then 'zscore_exit' end as why from bk left join co using (lead, lag)),
po as (select lead, lag, score, corr_short, z_depth, 0 as src from ol where why is null union all select lead, lag, score, corr_short, z_depth, 1 from go join co using (lead, lag)),
kt as (select greatest(1, cast(round_even(cast(8 as double) * greatest(0.25, least(1.0, coalesce(median(corr_short), 0) / 0.7)), 0) as int)) as k from po where z_depth > 0),
tg as (select lead, lag, row_number() over (order by score desc, src, lead, lag) as place from po qualify row_number() over (partition by lag order by score desc, src, lead) = 1), ch as (select lead, lag, true as chosen from (select lead, lag, row_number() over (order by score desc, src, lead, lag) as place from (select * from po qualify row_number() over (partition by lag order by score desc, src, lead) = 1)), kt where place <= k),
oa as (select ol.*, coalesce(chosen, false) as chosen, coalesce(why, case when held and not coalesce(chosen, false) then 'displaced' end) as reason from ol left join ch using (lead, lag)),
ac as (select lead, lag, score, case when reason is not null then 'sell' when chosen and not held then 'buy' else 'hold' end as action, reason as exit_reason from oa union all select go.lead, go.lag, score, 'buy', null from go join co using (lead, lag) join ch using (lead, lag))"""


@query("ctrl_01_daily_scoring", f"with {SCORED} select lead, lag, R(score) as score, action, exit_reason from ac")
def _(t):
    return _day(t).actions.select("lead", "lag", "score", "action", "exit_reason")


@query("ctrl_01_scanned", f"with {SCORED} select go.lead, go.lag, R(score) as score, R(z_depth) as z_depth, R(corr_short) as corr_short from go join co using (lead, lag)")
def _(t):
    return _day(t).scanned.select("lead", "lag", "score", "z_depth", "corr_short")


@query("ctrl_01_penny", f"with {SCORED}, en as (select max((turn, -c, lead, lag)) as last, count(*) as n from go) select distinct case when c1 < 1300 then lead else lag end as symbol from rs, en where ((n < 12) or (turn, -c, lead, lag) <= last) and (c1 < 1300 or (c1 >= 1300 and c2 < 1300))")
def _(t):
    return _day(t).penny


@query("ctrl_01_cointegration_cache")
def _(t):
    day = L.daily_scoring(t.prices, _clustered(t), _state(t), DAY, TODAY)
    return day.state.coint.select("lead", "lag", "at", "coint_pvalue", "halflife_days")


PRICED = {"min_pct": 0.01, "max_pct": 0.05, "short_fraction": 0.5, "target_deployed": 0.2}


@query("ctrl_02_execution")
def _(t):
    actions = [r.asDict() for r in _day(t).actions.collect()]  # the book and max_k pairs at most
    last = {r["symbol"]: r["c"] for r in t.prices.where(f"day <= date '{DAY}'").groupBy("symbol").agg(F.max_by("close", "day").alias("c")).collect()}  # a row for each symbol
    account = L.Account(50_000.0, 100_000.0, {"Brand#12", "Brand#22"}, {"Brand#2"}, {"Brand#12": 10.0, "Brand#22": 5.0}, {("Brand#2", "Brand#22"): 2.0})
    trades, _ = L.trade_day(actions, account, last, L.Limits(**PRICED))
    return t.spark.createDataFrame(trades, "symbol string, side string, quantity double, price double, leg string, exit_reason string, lead string, lag string")


def _run_settings(t):
    """A run for each market segment: later ones begin later, with more cash and places."""
    no = F.row_number().over(W.orderBy("run")) - 1  # a row for each segment
    named = t.customer.groupBy(F.col("c_mktsegment").alias("run")).agg(F.round(F.sum("c_acctbal"), 2).alias("balance")).withColumn("no", no)
    start = F.date_add(F.lit("1996-01-01").cast("date"), (30 * F.col("no")).cast("int"))
    return named.select(
        "run", start.alias("start"), F.date_add(start, 300).alias("end"), (F.lit(8) + F.col("no")).alias("budget"), (F.lit(4) + F.col("no")).alias("max_k"), F.lit(14).alias("cooldown"),
        F.lit(0.02).alias("min_pct"), F.lit(0.2).alias("max_pct"), F.lit(0.5).alias("short_fraction"), F.lit(0.4).alias("target_deployed"), (100_000 + F.col("balance")).alias("cash"),
    )


SPANS = [("1996-01-01", "1996-04-30"), ("1996-05-01", "1996-08-31"), ("1996-09-01", "1997-04-30")]


@query("ctrl_02_runs")
def _(t):
    runs = _run_settings(t)
    events, _ = R.run_days(t.prices, _clustered(t), runs, R.opened(runs), TODAY, SPANS)
    return events.where("kind = 'trade'").select("run", "day", "lead", "lag", "symbol", "side", F.col("reason").alias("exit_reason"), F.col("x").alias("quantity"), F.col("y").alias("price"))


@query("ctrl_03_run_states")
def _(t):
    runs = _run_settings(t)
    _, state = R.run_days(t.prices, _clustered(t), runs, R.opened(runs), TODAY, SPANS)
    return state.select("run", "kind", "lead", "lag", "x", "y", "day")


@query("flt_08_mirror_conflict", "with h as (select symbol, leg from (select symbol, leg, row_number() over (partition by symbol order by id desc) as k from trades) where k = 1), p as (select distinct 'C' || cast(c_custkey as varchar) as lead, 'C' || cast(c_custkey + 1 as varchar) as lag from customer) select lead, lag from p where not exists (select 1 from h where symbol = lag and leg = 'short') and not exists (select 1 from h where symbol = lead and leg = 'long')")
def _(t):
    from ..operators.gates import without_mirrors

    held = t.trades.groupBy("symbol").agg(F.max_by("leg", "id").alias("leg"))
    pairs = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey")).alias("lead"), F.concat(F.lit("C"), F.col("c_custkey") + 1).alias("lag")).distinct()
    return without_mirrors(pairs, held)


@query("ctrl_03_indicators", "with l as (select symbol, arg_max(close, day) as c from prices group by symbol), v as (select sum(case when not is_etf then 10 * c else 0 end) as lo, sum(case when is_etf then 10 * c else 0 end) as sh from ticker_metadata join l using (symbol)) select R(50000 + lo - sh) as portfolio_value, R(lo / (50000 + lo - sh)) as gross_long_pct, R(sh / (50000 + lo - sh)) as gross_short_pct, R(50000 / (50000 + lo - sh)) as cash_ratio from v")
def _(t):
    pos = t.ticker_metadata.select("symbol", F.lit(10.0).alias("quantity"), F.when(F.col("is_etf"), "short").otherwise("long").alias("leg"))
    return L.indicators(pos, t.prices, 50000.0)


RUNS = "with rn as (select 'r' || cast(o_custkey % 40 as varchar) as run_id, case when o_custkey % 40 = 7 then 'paper' else 'backtest' end as mode, min(o_orderdate) as started_at, case when o_custkey % 40 < 36 then null else max(o_orderdate) end as completed_at, 't' || cast(o_custkey % 40 as varchar) as token from orders group by 1, 2, o_custkey % 40), sn as (select 'r' || cast(o_custkey % 40 as varchar) as run_id, count(*) as n from orders group by 1)"


def _runs(t):
    k = F.col("o_custkey") % 40
    x = t.orders.groupBy(k.alias("k")).agg(F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("last"))
    name = F.concat(F.lit("r"), F.col("k"))
    return x.select(name.alias("run_id"), F.when(F.col("k") == 7, "paper").otherwise("backtest").alias("mode"), "started_at", F.when(F.col("k") >= 36, F.col("last")).alias("completed_at"), F.to_json(F.struct(F.concat(F.lit("t"), F.col("k")).alias("tuning_trial_token"))).alias("settings"))


@query("ctrl_05_run_by_token", f"{RUNS} select run_id, 'token' as how from rn where token in ('t37', 't12') and completed_at is not null")
def _(t):
    runs = _runs(t)
    return T.run_by_token(runs, "t37").unionByName(T.run_by_token(runs, "t12"))  # the second one never ended


@query("ctrl_05_run_attribution", f"{RUNS}, c as (select rn.run_id, completed_at is not null as done, started_at, after_ from rn join sn using (run_id), (values (timestamp '1995-01-01 00:00:00'), (timestamp '1995-01-04 00:00:00')) v(after_) where started_at >= after_ and mode = 'backtest' and (completed_at is not null or n >= 5)) select cast(after_ as varchar) as after_, run_id, case when done then 'completed' else 'partial' end as how from c qualify row_number() over (partition by after_ order by done desc, started_at desc, run_id) = 1")
def _(t):
    runs, shots = _runs(t), t.orders.select(F.concat(F.lit("r"), F.col("o_custkey") % 40).alias("run_id"))
    parts = [T.latest_run(runs, shots, at).withColumn("after_", F.lit(at)) for at in ("1995-01-01 00:00:00", "1995-01-04 00:00:00")]
    return parts[0].unionByName(parts[1])


@query("ctrl_06_fold_workers", "select N(o_orderkey) as trial, cast(o_orderkey % 5 as int) as worker from orders")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("trial"), F.pmod("o_orderkey", F.lit(5)).cast("int").alias("worker"))


@query("ctrl_07_study_gate", f"with {RETURNS}, c as (select substr(lead, 1, 7) as g, lead, lag, corr(rl, rg) as rho from rt where rl is not null group by 1, 2, 3) select N(count(*) filter (where rho > 0.15)) as strong, R(avg(case when rho > 0 then 1.0 else 0.0 end)) as positive, avg(case when rho > 0 then 1.0 else 0.0 end) >= 0.5 as passed from c")
def _(t):
    r = P.pair_returns(aligned(t)).where("rl is not null").groupBy("lead", "lag").agg(P.safe_corr("rl", "rg").alias("rho"))
    x = r.agg(F.count_if(F.col("rho") > 0.15).alias("strong"), F.avg(F.when(F.col("rho") > 0, 1.0).otherwise(0.0)).alias("positive"))
    return x.withColumn("passed", F.col("positive") >= 0.5)
