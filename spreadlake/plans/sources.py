"""Scans, sinks and table changes."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import panel as P
from ..registry import query
from ..sources import filings, tables
from ..sources.folders import shared_folder
from ..sources.versioned import VersionedTable, violations

SYMS = "('Brand#11', 'Brand#12', 'Brand#23', 'Brand#55')"
SYM = ["Brand#11", "Brand#12", "Brand#23", "Brand#55"]
SPAN = "between date '1995-01-01' and date '1995-12-31'"


@query("src_01_price_scan", f"select symbol, day, R(close) as close from prices where symbol in {SYMS} and day {SPAN}")
def _(t):
    return tables.price_scan(t.prices, SYM, "1995-01-01", "1995-12-31").select("symbol", "day", "close")


@query("src_02_wide_panel", f"select day, R(max(close) filter (where symbol = 'Brand#11')) as \"Brand#11\", R(max(close) filter (where symbol = 'Brand#23')) as \"Brand#23\" from prices where symbol in ('Brand#11', 'Brand#23') group by day")
def _(t):
    return tables.wide(t.prices.where(F.col("symbol").isin("Brand#11", "Brand#23")), ["Brand#11", "Brand#23"])


@query("src_03_pivot_last", "with q as (select o_orderpriority, o_orderstatus, arg_max(o_totalprice, o_orderkey) as x from orders group by 1, 2) select o_orderpriority, R(max(x) filter (where o_orderstatus = 'F')) as f, R(max(x) filter (where o_orderstatus = 'O')) as o from q group by 1")
def _(t):
    last = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.max_by("o_totalprice", "o_orderkey").alias("x"))
    wide = last.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.first("x"))
    return wide.withColumnsRenamed({"F": "f", "O": "o"})


@query("src_04_flat_bars", "select symbol, day, R(close) as close, volume from prices where volume > 0 and close is not null")
def _(t):
    return t.prices.where("volume > 0 and close is not null").select("symbol", "day", "close", "volume")


@query("src_05_universe", "select distinct symbol from ticker_metadata")
def _(t):
    return t.ticker_metadata.select("symbol").distinct().orderBy("symbol")


@query("src_06_tradeable_assets", "select symbol, exchange from ticker_metadata where exchange in ('NYSE', 'NASDAQ') and symbol not like '%.%' and upper(coalesce(name, '')) not like '%ETF%'")
def _(t):
    return tables.tradeable_assets(t.ticker_metadata).select("symbol", "exchange")


@query("src_07_cik_map", "select p_brand as ticker, cast(10000 + min(p_size) as bigint) as cik from part group by p_brand")
def _(t):
    obj = t.part.groupBy("p_brand").agg((F.min("p_size") + 10000).alias("cik")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", F.struct(F.col("p_brand").alias("ticker"), F.col("cik").alias("cik_str")))))).alias("json"))
    return filings.cik_map(obj, "json")


@query("src_08_filing_extract", "select cast(accession as bigint) as accession, form, items, cast(filed_at as date) as filed from filing_events where form in ('8-K', '6-K') and cast(filed_at as date) >= date '2024-01-10'")
def _(t):
    blocks = t.filing_events.withColumn("blk", F.expr("accession div 1000")).groupBy("blk").agg(*[F.transform(F.sort_array(F.collect_list(F.struct("accession", "form", "items", F.date_format("filed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at")))), _field(c)).alias(n) for c, n in (("accession", "accessionNumber"), ("form", "form"), ("at", "acceptanceDateTime"), ("items", "items"))])
    return filings.extract(blocks, ["8-K", "6-K"], "2024-01-10").select(F.col("accession").cast("long").alias("accession"), "form", "items", F.to_date("filed_at").alias("filed"))


@query("src_09_page_pruning", "with pages_ as (select accession % 7 as page, case when accession % 7 = 3 then least(max(cast(filed_at as date)), date '2024-01-05') else max(cast(filed_at as date)) end as filing_to from filing_events group by accession % 7) select N(page) as page, filing_to from pages_ where filing_to >= date '2024-01-10'")
def _(t):
    last = t.filing_events.groupBy((F.col("accession") % 7).alias("page")).agg(F.max(F.to_date("filed_at")).alias("last"))
    pages = last.select("page", F.when(F.col("page") == 3, F.least("last", F.lit("2024-01-05").cast("date"))).otherwise(F.col("last")).alias("filing_to"))  # one page ends early
    return filings.pages_since(pages, "2024-01-10")


@query("src_10_normalized_ticker", "select distinct replace(replace(upper(concat(p_brand, '.b/c')), '.', '-'), '/', '-') as ticker from part")
def _(t):
    return t.part.select(S.normalized_ticker(F.concat("p_brand", F.lit(".b/c"))).alias("ticker")).distinct()


@query("src_11_nav_rows", "select concat('X', upper(p_brand), 'X') as symbol, N(p_partkey) as k, R(p_retailprice - 950) as nav from part where p_retailprice - 950 > 0")
def _(t):
    return t.part.select(S.mirror_symbol(F.col("p_brand")).alias("symbol"), F.col("p_partkey").alias("k"), (F.col("p_retailprice") - 950).alias("nav")).where("nav > 0")


@query("src_12_filing_scan", f"select symbol, accession, form from filing_events where symbol in {SYMS} and cast(filed_at as date) between date '2024-01-05' and date '2024-01-20' and form in ('8-K', '6-K')")
def _(t):
    return filings.scan(t.filing_events, SYM, "2024-01-05", "2024-01-20", ["8-K", "6-K"]).select("symbol", "accession", "form")


@query("src_13_nav_scan", f"select symbol, day, R(close * 0.98) as nav from prices where symbol in {SYMS} and day >= date '1997-01-01'")
def _(t):
    return t.prices.where(F.col("symbol").isin(SYM) & (F.col("day") >= "1997-01-01")).orderBy("symbol", "day").select("symbol", "day", (F.col("close") * 0.98).alias("nav"))


@query("src_14_metadata_scan", f"select symbol, sector, is_etf from ticker_metadata where symbol in {SYMS}")
def _(t):
    return t.ticker_metadata.where(F.col("symbol").isin(SYM)).select("symbol", "sector", "is_etf")


@query("src_15_fold_union", "select fold, N(count(*)) as n from observations where fold in ('BUILDING', 'MACHINERY') group by fold")
def _(t):
    parts = [t.observations.where(F.col("fold") == f) for f in ("BUILDING", "MACHINERY")]
    return parts[0].unionByName(parts[1]).groupBy("fold").agg(F.count("*").alias("n"))


@query("src_17_read_through", "with c as (select symbol, day, close, 1 as p from prices where day < date '1996-01-01'), f as (select symbol, day, close * 2 as close, 0 as p from prices where day >= date '1995-07-01'), u as (select * from c union all select * from f) select symbol, day, R(close) as close from u qualify row_number() over (partition by symbol, day order by p) = 1")
def _(t):
    cached = t.prices.where("day < date '1996-01-01'").select("symbol", "day", "close")
    fresh = t.prices.where("day >= date '1995-07-01'").select("symbol", "day", (F.col("close") * 2).alias("close"))
    return tables.merge_fresh(cached, fresh, ["symbol", "day"])


@query("src_18_coverage_gaps", "with w as (select distinct p_brand as symbol from part union all select 'ABSENT'), c as (select symbol, min(day) as lo, max(day) as hi from prices where volume > 50 or symbol > 'Brand#3' group by symbol) select symbol from w left join c using (symbol) where lo is null or lo > date '1995-02-01' + 2 or hi < date '2001-10-01' - 2")
def _(t):
    wanted = t.part.select(F.col("p_brand").alias("symbol")).distinct().unionByName(t.spark.createDataFrame([("ABSENT",)], "symbol string"))
    return tables.coverage_gaps(t.prices.where("volume > 50 or symbol > 'Brand#3'"), wanted, "1995-02-01", "2001-10-01", days=2)


@query("src_19_merge_fresh", "with u as (select p_brand as symbol, p_size as k, p_retailprice as x, 1 as p, p_partkey as id from part where p_partkey % 2 = 0 union all select p_brand, p_size, p_retailprice, 0, p_partkey from part where p_partkey % 3 = 0) select symbol, N(k) as k, R(x) as x from u qualify row_number() over (partition by symbol, k order by p, id) = 1")
def _(t):
    rows = lambda m: t.part.where(f"p_partkey % {m} = 0").select(F.col("p_brand").alias("symbol"), F.col("p_size").cast("long").alias("k"), F.col("p_retailprice").alias("x"), F.col("p_partkey").alias("id"))
    return tables.merge_fresh(rows(2), rows(3), ["symbol", "k"], "id").drop("id")


@query("src_23_active_pairs", "select symbol, N(id) as id, run_id, R(coalesce(price, 0)) as price from trades where run_id = 'BUILDING' qualify row_number() over (partition by symbol order by id desc) = 1")
def _(t):
    return tables.latest(t.trades.where("run_id = 'BUILDING'"), ["symbol"], F.desc("id")).select("symbol", "id", "run_id", F.coalesce("price", F.lit(0.0)).alias("price"))


@query("src_24_cache_slice", "select lead, lag, N(obs_id) as obs_id, R(coint_pvalue) as coint_pvalue, R(halflife_days) as halflife_days from observations where date >= date '1995-03-15' and hold_days = 5")
def _(t):
    return t.observations.where("date >= date '1995-03-15' and hold_days = 5").select("lead", "lag", "obs_id", "coint_pvalue", "halflife_days")


@query("src_25_snapshot_scan", "select day, R(pv) as pv from portfolio_snapshots where run_id = 'BUILDING'")
def _(t):
    return t.portfolio_snapshots.where("run_id = 'BUILDING'").orderBy("day").select("day", "pv")


@query("src_26_benchmark_fallback", "with a as (select day, avg(close) as x, 0 as p from prices where symbol = 'Brand#11' group by day union all select day, avg(close), 1 from prices group by day) select day, R(x) as x from a qualify row_number() over (partition by day order by p) = 1")
def _(t):
    own = t.prices.where("symbol = 'Brand#11'").groupBy("day").agg(F.avg("close").alias("x"))
    return tables.merge_fresh(t.prices.groupBy("day").agg(F.avg("close").alias("x")), own, ["day"])


@query("src_27_cached_days", f"select N(count(distinct day)) as n from prices where day {SPAN}")
def _(t):
    return t.prices.where(f"day {SPAN}").agg(F.countDistinct("day").alias("n"))


@query("src_29_latest_json_metric", "select o_custkey % 10 as study, R(arg_max(o_totalprice, o_orderkey)) as score from orders where o_orderstatus <> 'P' group by 1")
def _(t):
    rows = t.orders.select((F.col("o_custkey") % 10).alias("study"), "o_orderkey", F.to_json(F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("holdout"))).alias("metrics"))
    return rows.withColumn("x", F.get_json_object("metrics", "$.holdout").cast("double")).where("x is not null").groupBy("study").agg(F.max_by("x", "o_orderkey").alias("score"))


def _field(name):
    return lambda x: x.getField(name)


KEYED = "select o_orderkey % 4000 as k, o_orderkey as id, o_totalprice as v from orders"


def _old_new(t):
    rows = t.orders.select((F.col("o_orderkey") % 4000).alias("k"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return tables.latest(rows.where("id % 2 = 0"), ["k"], "id"), tables.latest(rows.where("id % 3 = 0"), ["k"], "id")


OLD_NEW = f"with r as ({KEYED}), old_ as (select * from r where id % 2 = 0 qualify row_number() over (partition by k order by id) = 1), new_ as (select * from r where id % 3 = 0 qualify row_number() over (partition by k order by id) = 1)"


@query("dml_01_insert_ignore", f"{OLD_NEW} select N(k) as k, N(id) as id, R(v) as v from old_ union all select N(k), N(id), R(v) from new_ where k not in (select k from old_)")
def _(t):
    return tables.insert_ignore(*_old_new(t), ["k"])


@query("dml_02_upsert", f"{OLD_NEW} select N(k) as k, N(id) as id, R(v) as v from new_ union all select N(k), N(id), R(v) from old_ where k not in (select k from new_)")
def _(t):
    return tables.upsert(*_old_new(t), ["k"])


@query("dml_03_placeholder_upsert", f"{OLD_NEW} select N(k) as k, N(old_.id) as id, R(coalesce(new_.v, old_.v)) as fetched from old_ full join new_ using (k)")
def _(t):
    old, new = _old_new(t)
    return old.join(new.select("k", F.col("v").alias("w")), "k", "full").select("k", "id", F.coalesce("w", "v").alias("fetched"))


@query("dml_04_unpivot", "select o_orderkey, 'a' as symbol, R(o_totalprice) as close from orders where o_orderstatus = 'F' union all select o_orderkey, 'b', R(o_totalprice / 2) from orders where o_custkey % 2 = 0")
def _(t):
    wide = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("a"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice") / 2).alias("b"))
    return wide.unpivot("o_orderkey", ["a", "b"], "symbol", "close").where("close is not null")


@query("dml_05_insert_or_get_id", f"{OLD_NEW} select N(new_.k) as k, N(coalesce(old_.id, new_.id + 1000000)) as id from new_ left join old_ using (k)")
def _(t):
    old, new = _old_new(t)
    return new.select("k", F.col("id").alias("n")).join(old.select("k", "id"), "k", "left").select("k", F.coalesce("id", F.col("n") + 1000000).alias("id"))


@query("dml_06_point_update", "select N(id) as id, case when leg = 'short' then false else true end as active, R(case when side = 'sell' then price * 1.1 else price end) as price from trades")
def _(t):
    return t.trades.select("id", (F.col("leg") != "short").alias("active"), F.when(F.col("side") == "sell", F.col("price") * 1.1).otherwise(F.col("price")).alias("price"))


@query("dml_07_pattern_delete", "select c_custkey, c_name from customer where c_name not like '%1%'")
def _(t):
    return t.customer.where(~F.col("c_name").like("%1%")).select("c_custkey", "c_name")


# Tables that are written and read back: each call works in a folder of its own under the shared one.


def _table(t, name, schema, day=None):
    return VersionedTable(t.spark, f"{shared_folder(t.spark)}/tables/{name}-{uuid.uuid4().hex}", schema, day)


EARN = "select symbol, cast(filed_at as date) as d from filing_events where starts_with(form, '8-K') and contains(items, '2.02')"


@query("src_16_csv_cache", f"with w as (select unnest([lead, lag]) as symbol from observations union select 'ABSENT'), e as (select distinct * from ({EARN})) select w.symbol, N(count(d)) as n, min(d) as first from w left join e using (symbol) group by w.symbol")
def _(t):
    wanted = t.observations.select(F.explode(F.array("lead", "lag")).alias("symbol")).distinct().unionByName(t.spark.createDataFrame([("ABSENT",)], "symbol string"))
    dates = t.filing_events.where(F.col("form").startswith("8-K") & F.col("items").contains("2.02")).select("symbol", F.to_date("filed_at").alias("earn_date")).distinct()
    folder = f"{shared_folder(t.spark)}/tables/earnings-{uuid.uuid4().hex}"
    for part in (wanted.where("symbol < 'Brand#3'"), wanted):  # the second call goes on where the first one stopped
        cache = tables.resume_csv(t.spark, folder, part, lambda todo: dates.join(todo, "symbol", "left_semi"), "symbol string, earn_date date")
    return cache.groupBy("symbol").agg(F.count("earn_date").alias("n"), F.min("earn_date").alias("first"))


@query("src_20_batch_outcome", "select cast(batch as int) as batch, N(count(*)) as asked, N(count(*) filter (where a)) as got, case when count(*) >= 50 and count(*) filter (where a) = 0 then 'outage' when count(*) filter (where a) < count(*) then 'partial' else 'ok' end as status from (select o_orderkey % 7 as batch, o_orderkey % 7 <> 3 and (o_orderkey % 7 = 5 or o_orderkey % 5 <> 0) as a from orders) group by batch")
def _(t):
    b, k = F.col("o_orderkey") % 7, F.col("o_orderkey")
    return tables.batch_outcome(t.orders.select(b.cast("int").alias("batch"), k.alias("symbol"), ((b != 3) & ((b == 5) | (k % 5 != 0))).alias("answered")))


@query("src_21_retry_waits", "select cast(k as int) as try_, R(15.0 * (1 << k)) as wait from range(0, 2) r(k)")
def _(t):
    return t.spark.createDataFrame(list(enumerate(tables.retry_waits())), "try_ int, wait double")


@query("src_22_warm_cache", "with c as (select symbol, day, close from prices where symbol < 'Brand#4' and day < date '1998-08-01'), f as (select symbol, day, close * 2 as close from prices where symbol < 'Brand#3' and day between date '1998-10-31' - 126 and date '1998-10-31') select symbol, day, R(close) as close from f union all select symbol, day, R(close) from c where not exists (select 1 from f where f.symbol = c.symbol and f.day = c.day)")
def _(t):
    cache = t.prices.where("symbol < 'Brand#4' and day < date '1998-08-01'").select("symbol", "day", "close")
    source = t.prices.select("symbol", "day", (F.col("close") * 2).alias("close"))
    return tables.warm(cache, source, t.ticker_metadata.where("symbol < 'Brand#3'").select("symbol"), "1998-10-31", 126)


@query("src_28_prewarm", "with f as (select * from prices where day between date '1995-06-01' - 150 and date '1995-12-31'), c as (select symbol, day from prices where day < date '1995-03-01' union select symbol, day from f), b as (select symbol, cast((row_number() over (order by symbol) - 1) // 10 as int) as batch from ticker_metadata) select batch, N(count(distinct c.symbol)) as symbols, N(count(*)) as rows_, N(count(distinct day)) as days_ from c join b using (symbol) group by batch")
def _(t):
    price = t.prices.select("symbol", "day", "close")
    cache = price.where("day < date '1995-03-01'")
    after = tables.prewarm(cache, price, t.ticker_metadata.select("symbol"), "1995-06-01", "1995-12-31", 150)
    return after.join(tables.batches(t.ticker_metadata, 10), "symbol").groupBy("batch").agg(F.countDistinct("symbol").alias("symbols"), F.count("*").alias("rows_"), F.countDistinct("day").alias("days_"))


@query("dml_08_snapshot_restore", "select N(o_orderkey) as id, o_orderpriority as reason, cast(o_orderdate as date) as failed_at from orders")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("reason"), F.to_date("o_orderdate").alias("failed_at"))
    table = _table(t, "failed", rows.schema)
    table.overwrite(rows)
    before = table.snapshot()
    table.delete(F.col("reason").like("%URGENT%"))
    table.append(rows.limit(3).withColumn("reason", F.lit("since")))
    table.restore(before)
    return table.read()


TRADE = "select N(id) as id, run_id, symbol, side, R(price) as price, filled_at from trades where"


@query("dml_09_append_facts", f"{TRADE} filled_at >= timestamp '1996-01-01 00:00:00' and filled_at < timestamp '1998-01-01 00:00:00'")
def _(t):
    rows = t.trades.select("id", "run_id", "symbol", "side", "price", "filled_at")
    table = _table(t, "trades", rows.schema, "filled_at")
    for year in (1996, 1997):
        table.append(rows.where(F.year("filled_at") == year))
    return table.read()


@query("dml_10_update_else_insert", f"{OLD_NEW} select N(old_.k) as k, N(old_.id) as id, R(coalesce(new_.v, old_.v)) as v from old_ left join new_ using (k) union all select N(k), N(id), R(v) from new_ where k not in (select k from old_)")
def _(t):
    old, new = _old_new(t)
    table = _table(t, "studies", old.schema)
    table.overwrite(old)
    table.update_else_insert(new, ["k"], ["v"])
    return table.read()


@query("dml_11_schema_evolution", "select N(id) as id, side, case when filled_at >= timestamp '1998-01-01 00:00:00' then exit_reason end as exit_reason, case when filled_at >= timestamp '1998-01-01 00:00:00' then leg else 'long' end as leg from trades")
def _(t):
    rows = t.trades.select("id", "side", "exit_reason", "leg", "filled_at")
    table = _table(t, "trades", rows.select("id", "side", "filled_at").schema, "filled_at")
    table.append(rows.where("filled_at < timestamp_ntz '1998-01-01 00:00:00'").select("id", "side", "filled_at"))
    for _ in range(2):  # a change that is there already changes nothing
        table.add_columns({"exit_reason": "string", "leg": "string"})
    table.append(rows.where("filled_at >= timestamp_ntz '1998-01-01 00:00:00'"))
    return table.read().select("id", "side", "exit_reason", F.coalesce("leg", F.lit("long")).alias("leg"))


@query("dml_11_constraints", "select 'leg' as rule, N(count(*) filter (where not leg in ('long', 'short'))) as n from trades union all select 'reason', N(count(*) filter (where not exit_reason in ('zscore_exit', 'displaced'))) from trades union all select 'quantity', N(count(*) filter (where not quantity > 1)) from trades")
def _(t):
    return violations(t.trades, {"leg": F.col("leg").isin("long", "short"), "reason": F.col("exit_reason").isin("zscore_exit", "displaced"), "quantity": F.col("quantity") > 1})


@query("dml_12_retention", "select symbol, day, R(close) as close from prices where strftime(day, '%Y-%m') >= strftime(date '1998-11-01' - 730, '%Y-%m')")
def _(t):
    rows = t.prices.select("symbol", "day", "close")
    table = _table(t, "prices", rows.schema, "day")
    table.append(rows)
    table.retain("1998-11-01", 730)
    table.compact("1998-11-01", 90, ["symbol", "day"])
    table.vacuum()
    return table.read()


@query("dml_13_order_sink", "select symbol, N(quantity) as qty, side, 'market' as type, 'day' as time_in_force from trades where filled_at < timestamp '1995-02-01 00:00:00'")
def _(t):
    orders = t.trades.where("filled_at < timestamp_ntz '1995-02-01 00:00:00'").select("symbol", F.col("quantity").cast("long").alias("qty"), F.upper("side").alias("side"))
    return tables.orders_to_send(orders, "paper").unionByName(tables.orders_to_send(orders, "backtest"))


SECTOR = "case " + " ".join(f"when sic between {low} and {high - 1} then '{name}'" for low, high, name in S.SIC_SECTORS) + " else 'Other' end"


@query("ctrl_04_metadata_load", f"with w as (select symbol from ticker_metadata union all select 'GHOST'), k as (select symbol, sector, is_etf from ticker_metadata where symbol < 'Brand#3'), c as (select lower(p_brand) as t, min(p_partkey) as cik from part where p_brand < 'Brand#5' group by 1) select symbol, sector, is_etf, 'stored' as source from k union all select w.symbol, case when sic is not null then {SECTOR} end, false, case when c.cik is null then 'none' else 'industry code' end from w left join c on c.t = lower(w.symbol) left join (select p_partkey as cik, p_partkey * 7 % 9999 as sic from part) s on s.cik = c.cik where w.symbol not in (select symbol from k)")
def _(t):
    wanted = t.ticker_metadata.select("symbol").unionByName(t.spark.createDataFrame([("GHOST",)], "symbol string"))
    ciks = t.part.where("p_brand < 'Brand#5'").select(F.lower("p_brand").alias("ticker"), F.col("p_partkey").alias("cik"))
    codes = t.part.select(F.col("p_partkey").alias("cik"), (F.col("p_partkey") * 7 % 9999).alias("sic"))
    return tables.load_metadata(t.ticker_metadata.where("symbol < 'Brand#3'"), wanted, ciks, codes)
