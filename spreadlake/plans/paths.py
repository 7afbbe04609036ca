"""Replayed observations, event policies over their forward paths, and the studies on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cointegration as K
from ..operators import observe as O
from ..operators import tuning as T
from ..registry import query
from .aggregates import ALIGNED, aligned

ENTRIES = [100, 140, 180, 220, 260, 300]
HOLDS, LEADS = (2, 4, 8), (1, 2)
REPLAY = O.Replay()
KEY = "partition by lead, lag, entry order by t"

OBS = f"""{ALIGNED}, en as (select unnest({ENTRIES}) as entry),
x0 as (select lead, lag, entry, day, pos, pos - entry as t, ln(greatest(pl, 1e-9)) as ll, ln(greatest(pg, 1e-9)) as lg from al, en where pos between entry - 104 and entry + 40),
hd as (select lead, lag, entry, regr_slope(lg, ll) as hedge from x0 where t <= 0 group by lead, lag, entry having count(*) >= 47),
x1 as (select x0.*, hedge, lg - hedge * ll as s, ll - lag(ll) over ({KEY}) as rl, lg - lag(lg) over ({KEY}) as rg from x0 join hd using (lead, lag, entry)),
x2 as (select *, lag(s) over ({KEY}) as sp, case when count(s) over w >= 32 then (s - avg(s) over w) / nullif(stddev_samp(s) over w, 0) end as z from x1 window w as ({KEY} rows 31 preceding)),
x3 as (select lead, lag, entry, max(day) filter (where t = 0) as date, max(z) filter (where t = 0) as z0, max(s) filter (where t = 0) as s0, max(hedge) as hedge, regr_slope(s, sp) filter (where t <= 0) as rho,
  case when count(rl) filter (where t between -89 and 0) >= 90 then corr(rl, rg) filter (where t between -89 and 0) end as corr_long, case when count(rl) filter (where t between -19 and 0) >= 20 then corr(rl, rg) filter (where t between -19 and 0) end as corr_short, max(t) as n
  from x2 group by lead, lag, entry having max(z) filter (where t = 0) is not null and max(t) >= 1),
pa as (select lead, lag, entry, t, abs(z) as az, -sign(z0) * (s - s0) / (1 + abs(x3.hedge)) * 1e4 as bps from x2 join x3 using (lead, lag, entry) where t >= 0),
ex as (select lead, lag, entry, coalesce(min(t) filter (where t >= 1 and az <= 0.5), max(t)) as exit_t from pa group by lead, lag, entry),
ob as (select x3.*, greatest(0, least(1, (-z0 - 0.5) / 1.0)) as z_depth, exit_t, bps as gross from x3 join ex using (lead, lag, entry) join pa using (lead, lag, entry) where pa.t = exit_t)"""

EVENTS = f"""{OBS}, ev as (select symbol, cast(date '1992-01-01' + cast(accession % 2400 as int) as date) as day, bool_or(form = '8-K' and items = '2.02,9.01') as results, bool_or(form = '8-K/A' and items = '4.02') as surprise from filing_events group by 1, 2),
le as (select lead, lag, ev.day, bool_or(results) as results, bool_or(surprise) as surprise from (select distinct lead, lag from ob) join ev on symbol in (lead, lag) where results or surprise group by 1, 2, 3),
ep as (select le.lead, le.lag, le.day, le.results, le.surprise, min(al.pos) as pos from le join al on al.lead = le.lead and al.lag = le.lag and al.day >= le.day group by all),
nx as (select lead, lag, entry, min(pos - entry) filter (where results) as nr, min(pos - entry) filter (where surprise) as su from ep join en on pos > entry and pos <= entry + 40 group by all),
oe as (select ob.*, entry // 100 as fold, case when nr <= n then nr end as next_results_t, case when su <= n then su end as surprise_t, round(0.3 * greatest(0, least(1, coalesce(corr_long, 0))) + 0.5 * greatest(0, least(1, coalesce(corr_short, 0))) + 0.2 * z_depth, 9) as score from ob left join nx using (lead, lag, entry))"""


def _policies(source: str = "oe") -> str:
    """po: a row for each observation of the source and policy."""
    values = lambda xs: ", ".join(f"({x})" for x in xs)
    return f"""g1 as (select *, case when next_results_t <= exit_t then least(exit_t, greatest(1, next_results_t - l)) else exit_t end as x from {source}, (values {values(HOLDS)}) a(h), (values {values(LEADS)}) b(l), (values (false), (true)) c(r)),
g2 as (select * replace (least(n, case when r and surprise_t <= x then least(n, surprise_t + 1) else x end) as x), not coalesce(next_results_t <= h, false) as traded from g1),
po as (select g2.*, case when traded then pa.bps end as pol from g2 join pa on pa.lead = g2.lead and pa.lag = g2.lag and pa.entry = g2.entry and pa.t = g2.x)"""


SUMMED = "count(*) as n, count(*) filter (where traded) as n_traded, avg(pol) as mean, 1 - coalesce(sum(pol) filter (where pol < -100) / nullif(sum(gross) filter (where gross < -100), 0), 0) as loss_cut, 1 - count(*) filter (where traded) / cast(count(*) as double) as excluded"
BEST = "loss_cut >= 0.5 desc, round(mean, 9) desc, round(excluded, 9), h, l, r"
OUT = "cast(h as int) as h, cast(l as int) as l, r, R(mean) as mean, R(loss_cut) as loss_cut, R(excluded) as excluded"


def replayed(t):
    """The replay is stored like a view: the queries below all read it."""
    return t.kept("replay", ("lineitem", "part"), lambda: O.replayed(aligned(t), ENTRIES, REPLAY))


def dated(t):
    ev = t.filing_events.select("symbol", F.date_add(F.lit("1992-01-01").cast("date"), (F.col("accession") % 2400).cast("int")).alias("day"), ((F.col("form") == "8-K") & (F.col("items") == "2.02,9.01")).alias("results"), ((F.col("form") == "8-K/A") & (F.col("items") == "4.02")).alias("surprise"))
    return t.kept("dated_replay", ("lineitem", "part", "events"), lambda: O.with_event_days(replayed(t), aligned(t), ev.where("results or surprise"), ENTRIES, REPLAY.horizon)).withColumn("fold", F.floor(F.col("entry") / 100).cast("long"))


def _chosen(x):
    return x.select("h", "l", "r", "mean", "loss_cut", "excluded")


@query("udx_12_replay", f"with {OBS} select lead, lag, N(entry) as entry, date, R(z0) as z0, R(corr_long) as corr_long, R(corr_short) as corr_short, R(z_depth) as z_depth, R(case when abs(rho) < 1 and rho <> 0 then greatest(1, least(252, -ln(2) / ln(abs(rho)))) end) as half_life, N(exit_t) as exit_t, R(gross) as forward_gross from ob where abs(z0) >= 1.5")
def _(t):
    x = replayed(t).where(F.abs("z0") >= REPLAY.entry_z)
    return x.select("lead", "lag", F.col("entry").cast("long").alias("entry"), "date", "z0", "corr_long", "corr_short", "z_depth", "half_life", F.col("exit_t").cast("long").alias("exit_t"), F.col("gross").alias("forward_gross"))


@query("udx_12_replay_cointegration")
def _(t):
    rows = O.entry_rows(aligned(t), ENTRIES, REPLAY).where("t <= 0")
    tradeable = rows.where("t = 0").where(F.abs("z") >= REPLAY.entry_z).select("lead", "lag", "entry")  # the cheap gate before the costly test
    pre = rows.join(tradeable, ["lead", "lag", "entry"], "left_semi").select("lead", "lag", "entry", F.col("t").alias("pos"), F.exp("ll").alias("pl"), F.exp("lg").alias("pg"))
    return K.cointegration(pre, keys=("lead", "lag", "entry"))


@query("udx_14_exit_replay", f"with {OBS} select lead, lag, N(entry) as entry, N(exit_t) as exit_t, R(gross) as gross from ob where entry <> 140")
def _(t):
    # The stored outcome comes row by row: first passage, then the spread there. Those of one entry are stale.
    rows = O.entry_rows(aligned(t), ENTRIES, REPLAY).withColumn("az", F.abs("z"))
    at0 = rows.where("t = 0 and z is not null").select("lead", "lag", "entry", F.col("z").alias("z0"), F.col("s").alias("s0"))
    hit = rows.where("t >= 1").groupBy("lead", "lag", "entry").agg(F.coalesce(F.min(F.when(F.col("az") <= REPLAY.exit_z, F.col("t"))), F.max("t")).alias("t"))
    stored = rows.join(hit, ["lead", "lag", "entry", "t"]).join(at0, ["lead", "lag", "entry"])
    gross = S.forward_bps(F.col("z0"), F.col("s0"), F.col("s"), F.col("hedge")) + F.when(F.col("entry") == 140, 5.0).otherwise(0.0)
    x = O.verified(replayed(t), stored.select("lead", "lag", "entry", gross.alias("forward_gross")))
    return x.select("lead", "lag", F.col("entry").cast("long").alias("entry"), F.col("exit_t").cast("long").alias("exit_t"), "gross")


@query("join_15_event_days", f"with {EVENTS} select lead, lag, N(entry) as entry, N(next_results_t) as next_results_t, N(surprise_t) as surprise_t from oe")
def _(t):
    return dated(t).select("lead", "lag", *[F.col(c).cast("long").alias(c) for c in ("entry", "next_results_t", "surprise_t")])


@query("udx_16_config_select", f"with {EVENTS}, {_policies()}, m as (select h, l, r, {SUMMED} from po group by h, l, r) select {OUT} from m order by {BEST} limit 1")
def _(t):
    return _chosen(O.select_policy(O.policy_metrics(O.policy_sums(O.policies(dated(t), HOLDS, LEADS), ["h", "l", "r"]))))


@query("udx_34_calendar_shift_null", f"""with {EVENTS}, {_policies()}, m as (select h, l, r, {SUMMED} from po group by h, l, r), ch as (select h, l, r from m order by {BEST} limit 1),
dr as (select oe.*, ch.*, d, case when d > 0 then least({S.mixed_sql(7, 'd', "cast('0x' || substr(md5(lead), 1, 7) as bigint)")} % 241 - 120, {S.mixed_sql(7, 'd', "cast('0x' || substr(md5(lag), 1, 7) as bigint)")} % 241 - 120) else 0 end as o from oe, ch, range(0, 201) k(d)),
sh as (select * replace (case when next_results_t + o between 1 and 40 then next_results_t + o end as next_results_t, case when surprise_t + o between 1 and 40 then surprise_t + o end as surprise_t) from dr),
s1 as (select *, case when next_results_t <= exit_t then least(exit_t, greatest(1, next_results_t - l)) else exit_t end as x from sh),
s2 as (select * replace (least(n, case when r and surprise_t <= x then least(n, surprise_t + 1) else x end) as x), not coalesce(next_results_t <= h, false) as traded from s1),
de as (select d, avg(case when traded then pa.bps end) - avg(gross) as delta from s2 join pa on pa.lead = s2.lead and pa.lag = s2.lag and pa.entry = s2.entry and pa.t = s2.x group by d)
select R(max(delta) filter (where d = 0)) as real, R(quantile_cont(delta, 0.9) filter (where d > 0)) as null_p90, max(delta) filter (where d = 0) > quantile_cont(delta, 0.9) filter (where d > 0) as passed from de""")
def _(t):
    obs = dated(t)
    chosen = O.select_policy(O.policy_metrics(O.policy_sums(O.policies(obs, HOLDS, LEADS), ["h", "l", "r"])))
    return O.shifted_calendar_null(obs, chosen, draws=200, seed=7, horizon=REPLAY.horizon)


def _dropped_sql(group: str) -> str:
    return f"with {EVENTS}, {_policies()}, m as (select d.g, h, l, r, {SUMMED} from (select distinct {group} as g from oe) d join po on po.{group} <> d.g group by d.g, h, l, r) select N(g) as {group}, {OUT} from m qualify row_number() over (partition by g order by {BEST}) = 1"


@query("agg_45_drop_one_fold", _dropped_sql("fold"))
def _(t):
    return O.dropped_one(O.policies(dated(t), HOLDS, LEADS), "fold").select("fold", "h", "l", "r", "mean", "loss_cut", "excluded")


@query("agg_45_drop_one_date", _dropped_sql("entry"))
def _(t):
    return O.dropped_one(O.policies(dated(t), HOLDS, LEADS), "entry").select(F.col("entry").cast("long").alias("entry"), "h", "l", "r", "mean", "loss_cut", "excluded")


BOOK = "bk as (select * from oe qualify row_number() over (partition by entry order by score desc, lead, lag) <= 20)"


@query("agg_46_book_policy", f"with {EVENTS}, {BOOK}, {_policies('bk')}, m as (select h, l, r, {SUMMED} from po group by h, l, r) select {OUT}, N(n) as n from m order by {BEST} limit 1")
def _(t):
    book = O.book_of(dated(t), 20).drop("score")
    x = O.select_policy(O.policy_metrics(O.policy_sums(O.policies(book, HOLDS, LEADS), ["h", "l", "r"])))
    return x.select("h", "l", "r", "mean", "loss_cut", "excluded", "n")


POINTS = [{k: (v if isinstance(v, int) else round(v, 6)) for k, v in T.suggest(7 + i).items() if k in ("corr_window_long", "corr_window_short", "w_corr_long", "w_corr_short", "w_z_depth")} for i in range(12)]


def _window_sql() -> str:
    points = ", ".join(f"({i}, {p['corr_window_long']}, {p['corr_window_short']}, cast({p['w_corr_long']!r} as double), cast({p['w_corr_short']!r} as double), cast({p['w_z_depth']!r} as double))" for i, p in enumerate(POINTS))
    part = lambda c: f"greatest(0, least(1, coalesce({c}, 0)))"
    return f"""with {OBS}, pt as (select * from (values {points}) v(trial, wl, ws, a, b, c)), wi as (select distinct w from (select unnest([wl, ws]) as w from pt)),
rb as (select lead, lag, entry, rl, rg, -t as i from x2 where t <= 0 and rl is not null),
rh as (select lead, lag, entry, w, case when count(*) >= w then corr(rl, rg) end as rho from rb join wi on i < w group by lead, lag, entry, w),
sc as (select trial, ob.lead, ob.lag, ob.entry, ob.entry // 100 as fold, gross, round(a * {part('l.rho')} + b * {part('s.rho')} + c * z_depth, 9) as score from ob cross join pt left join rh l on l.lead = ob.lead and l.lag = ob.lag and l.entry = ob.entry and l.w = wl left join rh s on s.lead = ob.lead and s.lag = ob.lag and s.entry = ob.entry and s.w = ws),
tp as (select * from sc qualify row_number() over (partition by trial, entry order by score desc, lead, lag) <= 10), dm as (select trial, fold, entry, avg(gross) as m from tp group by 1, 2, 3), fm as (select trial, fold, avg(m) as m from dm group by 1, 2)
select cast(trial as int) as trial, R(0.5 * avg(m) + 0.5 * min(m)) as objective from fm group by trial"""


@query("udx_31_study", _window_sql())
def _(t):
    return O.window_study(replayed(t), POINTS, 10, F.floor(F.col("entry") / 100))


