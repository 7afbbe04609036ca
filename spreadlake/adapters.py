"""Market-data views over the driver's tables: one SQL text each, run by Spark here and by the oracle there."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sources.folders import Files, shared_folder

# {name} is a driver table; JSON_K is the engine's way to read props.k.
VIEWS: dict[str, str] = {
    "prices": """select p_brand as symbol, cast(date_trunc('week', l_shipdate) as date) as day, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / (100 * sum(l_quantity)) as close, cast(sum(l_quantity) as bigint) as volume
  from {lineitem} join {part} on l_partkey = p_partkey group by p_brand, cast(date_trunc('week', l_shipdate) as date)""",
    "ticker_metadata": """select p_brand as symbol, case substr(p_brand, 7, 1) when '1' then 'Technology' when '2' then 'Energy' when '3' then 'Health' when '4' then null else 'Finance' end as sector,
  substr(p_brand, 8, 1) = '5' as is_etf, cast(min(p_size) * 97 + cast(substr(p_brand, 7, 2) as int) * 170 as int) as sic_code, case when substr(p_brand, 8, 1) in ('1', '2') then 'NYSE' when substr(p_brand, 8, 1) = '3' then 'OTC' else 'NASDAQ' end as exchange,
  case when substr(p_brand, 8, 1) = '5' then concat('Fund etf ', p_brand) when substr(p_brand, 7, 2) = '22' then null else concat('Company ', p_brand) end as name from {part} group by p_brand""",
    "trades": """select o_orderkey as id, c_mktsegment as run_id, o_custkey as pair_id, concat('C', cast(o_custkey as varchar(20))) as symbol,
  case when row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) % 2 = 1 then 'buy' else 'sell' end as side,
  cast(1 + o_orderkey % 10 as double) as quantity, o_totalprice / 1000 as price, o_totalprice / 10000 as slippage, o_orderdate as filled_at,
  case o_orderstatus when 'F' then 'zscore_exit' when 'O' then 'displaced' else 'data_missing' end as exit_reason, case when o_orderkey % 5 = 0 then 'short' else 'long' end as leg
  from {orders} join {customer} on o_custkey = c_custkey""",
    "portfolio_snapshots": """select c_mktsegment as run_id, cast(date_trunc('week', o_orderdate) as date) as day, 1000000 + sum(o_totalprice) / 10 as pv, 400 + avg(o_totalprice) / 10000 as spy,
  avg(o_custkey % 100) / 100 as cash_ratio, cast(count(*) as bigint) as active_pairs from {orders} join {customer} on o_custkey = c_custkey group by c_mktsegment, cast(date_trunc('week', o_orderdate) as date)""",
    "filing_events": """select concat('Brand#', cast(1 + user_id % 5 as varchar(4)), cast(1 + (user_id - user_id % 5) / 5 % 5 as varchar(4))) as raw_symbol,
  concat('Brand#', cast(1 + user_id % 5 as varchar(4)), cast(1 + event_id % 5 as varchar(4))) as symbol, event_id as accession,
  case event_type when 'purchase' then '8-K' when 'signup' then '8-K/A' when 'error' then '6-K' else '10-Q' end as form,
  case event_id % 6 when 0 then '2.02,9.01' when 1 then '1.01' when 2 then '5.02,7.01' when 3 then '4.02' when 4 then '' else '2.01,2.02' end as items, ts as filed_at from {events}""",
    "observations": """select c_mktsegment as fold, cast(o_orderdate as date) as date, concat('Brand#', cast(1 + o_custkey % 5 as varchar(4)), cast(1 + o_orderkey % 3 as varchar(4))) as lead, concat('Brand#', cast(1 + o_custkey % 5 as varchar(4)), cast(4 + o_orderkey % 2 as varchar(4))) as lag, o_orderkey as obs_id,
  cast(o_orderkey % 97 as double) / 97 as corr_long, cast(o_custkey % 89 as double) / 89 as corr_short, case when o_orderkey % 3 = 0 then cast(0 as double) else cast(o_orderkey % 53 as double) / 53 end as z_depth, cast(o_orderkey % 61 as double) / 20 as z_entry,
  cast(o_orderkey % 100 as double) / 100 as coint_pvalue, cast(1 + o_custkey % 80 as double) as halflife_days, o_totalprice / 100 - 1500 as gross, cast(1 + o_orderkey % 20 as int) as hold_days,
  case when o_orderkey % 4 = 0 then null else cast(1 + o_orderkey % 25 as int) end as next_results_t, case when o_orderkey % 7 = 0 then cast(1 + o_orderkey % 15 as int) end as surprise_t from {orders} join {customer} on o_custkey = c_custkey""",
}
# Fixed decimals of the quotients above are doubles on both sides.
DOUBLES = {"observations": ("corr_long", "corr_short", "coint_pvalue", "z_entry"), "portfolio_snapshots": ("cash_ratio",)}


# Views that stand for stored tables of the engine: written once for a session and directory, by day, so that a range of
# days reaches the scan and no query aggregates them anew.
STORED = {"prices": ("lineitem", "part")}
_written: dict[tuple, str] = {}
_schemas: dict[str, StructType] = {}


class Tables:
    """The driver's tables and the views over them, of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in VIEWS:
            return self.table(name)
        text = re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{self.dir}/{m[1]}.parquet`", VIEWS[name].replace("varchar(20)", "string").replace("varchar(4)", "string").replace("/ 5 % 5", "div 5 % 5"))
        df = self.spark.sql(text)
        df = df.withColumns({c: F.col(c).cast("double") for c in DOUBLES.get(name, ())})
        return self._stored(name, df) if name in STORED else df

    def _stored(self, name: str, df: DataFrame) -> DataFrame:
        """The view as Parquet in the shared folder, sorted by day within ranges of days."""
        return self.kept(name, STORED[name], lambda: df.repartitionByRange("day").sortWithinPartitions("day", "symbol"))

    def kept(self, name: str, tables: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, written once for the session and directory and read from there; anew if one of the tables has changed or it is gone."""
        files = Files(self.spark, self.dir)
        stamp = tuple(files.fs.getFileStatus(files.path(f"{self.dir}/{t}.parquet")).getModificationTime() for t in tables)
        key = (self.spark.sparkContext.applicationId, self.dir, name, stamp)
        if key not in _written or not Files(self.spark, _written[key]).exists(f"{_written[key]}/_SUCCESS"):
            folder, df = f"{shared_folder(self.spark)}/views/{name}-{uuid.uuid4().hex}", make()
            df.write.parquet(folder)
            _written[key], _schemas[folder] = folder, df.schema
        return self.spark.read.schema(_schemas[_written[key]]).parquet(_written[key])


def oracle(sql: str) -> str:
    """The query with the views that it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = []
    for v in used:
        body = re.sub(r"\{(\w+)\}", r"\1", VIEWS[v]).replace("varchar(20)", "varchar").replace("varchar(4)", "varchar").replace("/ 5 % 5", "// 5 % 5")
        if v in DOUBLES:
            body = f"select * replace ({', '.join(f'cast({c} as double) as {c}' for c in DOUBLES[v])}) from ({body})"
        parts.append(f"{v} as ({body})")
    sql = sql.strip()
    for word in ("with recursive ", "with "):
        if sql.lower().startswith(word):
            return word + ",\n".join([*parts, sql[len(word) :]])
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + sql
