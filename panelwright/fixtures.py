"""Panel views over the test tables: plain SQL that runs unchanged in Spark and DuckDB.

Engine and oracle share these definitions; later views use earlier ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

VIEWS: dict[str, str] = {
    "codes": """
select s_suppkey as k,
  case s_suppkey % 5
    when 0 then concat('600', lpad(cast(s_suppkey as varchar(10)), 3, '0'), '.SH')
    when 1 then concat('000', lpad(cast(s_suppkey as varchar(10)), 3, '0'), '.SZ')
    when 2 then concat('300', lpad(cast(s_suppkey as varchar(10)), 3, '0'), '.SZ')
    when 3 then concat('688', lpad(cast(s_suppkey as varchar(10)), 3, '0'), '.SH')
    else concat('920', lpad(cast(s_suppkey as varchar(10)), 3, '0'), '.BJ') end as code,
  s_name as name, n_name as industry
from supplier join nation on s_nationkey = n_nationkey
""",
    "bars": """
with t as (
  select c.k, c.code, cast(l_shipdate as date) as date, l_extendedprice / l_quantity as px, l_quantity as q,
    l_extendedprice as amt,
    row_number() over (partition by l_suppkey, cast(l_shipdate as date)
      order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) as seq
  from lineitem join codes c on c.k = l_suppkey)
select k, code, date, min_by(px, seq) as open, max(px) as high, min(px) as low, max_by(px, seq) as close,
  cast(sum(cast(q as bigint)) * 100 as double) as volume,
  cast(sum(cast(amt as decimal(18,2))) as double) * 100 as amount, false as is_suspended
from t group by k, code, date
""",
    "calendar": """
select distinct date from bars where day(date) not in (7, 19)
""",
    "bars_dirty": """
with b as (select *, cast(volume / 100 as bigint) as v from bars)
select code, date, case when v % 13 = 0 then -open else open end as open,
  case when v % 7 = 0 then low * 0.5 else high end as high, low, close,
  case when v % 23 = 0 then -volume else volume end as volume, amount, v % 19 = 0 as is_suspended, 1 as ingest_seq
from b
union all
select code, date, open, high, low, close * 1.01 as close, volume, amount, false as is_suspended, 2 as ingest_seq
from b where v % 11 = 0
""",
    "suspensions": """
select c.date, x.code from calendar c cross join codes x
left join bars b on b.code = x.code and b.date = c.date
where b.code is null and (x.k * 31 + year(c.date) * 372 + month(c.date) * 31 + day(c.date)) % 4 = 0
""",
    "corp_events_raw": """
with o as (
  select c.k, c.code as std, cast(o_orderdate as date) as date, o_orderkey as ok, o_totalprice as tp
  from orders cross join (select count(*) as n from supplier) z join codes c on c.k = o_custkey % z.n where o_orderkey % 40 in (0, 5))
select case right(std, 2) when 'SZ' then 0 when 'SH' then 1 else 2 end as market, substring(std, 1, 6) as code, date,
  case when ok % 40 = 0 then 1 else 5 end as category,
  cast(ok % 7 as double) as f1, round(tp / 100000, 2) as f2,
  cast(case when ok % 40 = 0 then ok % 3 * 5 else 1000 + ok % 900 end as double) as f3,
  cast(case when ok % 40 = 0 then ok % 2 * 3 else 2000 + ok % 900 end as double) as f4, ok as seq
from o
""",
    "renames": """
select c.code, case when c_mktsegment = 'MACHINERY' then concat('ST N', cast(c_custkey as varchar(10)))
    else concat('N', cast(c_custkey as varchar(10))) end as name,
  cast('1995-01-01' as date) + cast(c_custkey * 37 % 2400 as int) as change_date, c_custkey as seq
from customer cross join (select count(*) as n from supplier) z join codes c on c.k = c_custkey % z.n where c_custkey % 5 < 3
""",
    "securities": """
select code, case when k % 11 = 0 then concat('*ST', name) else name end as name,
  cast('1994-06-01' as date) + cast(k * 13 % 900 as int) as list_date,
  case when k % 9 = 4 then cast('1999-01-01' as date) + cast(k * 7 % 600 as int) end as delist_date,
  right(code, 2) as exchange, industry
from codes
""",
    "index_members": """
select d.index_code, d.snapshot_date, c.code, cast(1 + c.k % 7 as double) as weight
from codes c cross join (
  select '000300' as index_code, cast('1996-01-01' as date) as snapshot_date, 0 as r
  union all select '000300', cast('1998-01-01' as date), 1
  union all select '000300', cast('2000-01-01' as date), 2) d
where (c.k + d.r) % 3 = 0
""",
    "fundamentals": """
select code, cast(date_trunc('month', date) as date) as pub_date,
  avg(close) / 1000 - 2 as pe, min(low) / 500 - 1 as pb, max(high) / 2000 as ps,
  cast(min(k) % 10 as double) / 200 as dividend_yield, sum(close - open) / sum(close) as roe,
  sum(high - low) / sum(high) as gross_margin, cast(count(*) as double) / 40 as debt_to_asset, sum(amount) as total_mv
from bars group by code, cast(date_trunc('month', date) as date)
""",
    "minute_bars": """
with t as (
  select event_type as code, date_trunc('minute', ts) as datetime, value, event_id from events)
select code, datetime, min_by(value, event_id) as open, max(value) as high, min(value) as low,
  max_by(value, event_id) as close, cast(count(*) * 100 as double) as volume,
  cast(sum(cast(value as decimal(18,2))) as double) as amount
from t group by code, datetime
""",
    "fills": """
with r as (select code, date, close, row_number() over (partition by code order by date) as rn from bars)
select code, date, cast(rn as bigint) as seq, case when rn % 4 in (1, 2) then 1 else -1 end as side,
  case rn % 4 when 1 then 200 when 2 then 400 else 300 end as shares, close as price
from r
""",
    "equity": """
select date, 1.0 + cast(sum(cast(volume as bigint)) / 100 % 100 as double) / 400 as equity
from bars group by date
""",
}


def needed(sql: str) -> list[str]:
    """The views that a query names, and those that they name, in order of definition."""
    seen: set[str] = set()

    def walk(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b(from|join)\s+{name}\b", text):
                walk(VIEWS[name])
                seen.add(name)

    walk(sql)
    return [n for n in VIEWS if n in seen]


#: Added before rounding down instead of a half: prices over quantities often end in an exact half.
HALF = 0.4871


def oracle(sql: str, doubles: str = "", places: int = 6) -> str:
    """DuckDB's form of a query over the views, with the named double columns rounded."""
    names = needed(sql)
    head = "with " + ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in names) + "\n" if names else ""
    rounded = ", ".join(f"floor({c} * 1e{places} + {HALF}) / 1e{places} as {c}" for c in doubles.split())
    return f"{head}select *{f' replace ({rounded})' if rounded else ''} from ({sql.strip()}) as result"


class Views:
    """The views of one folder of tables, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in VIEWS:
                text = re.sub(r"\b(from|join)\s+(\w+)\b", r"\1 {\2}", VIEWS[name])
                own = set(re.findall(r"\{(\w+)\}", text)) - set(TABLES) - set(VIEWS)
                for n in own:  # the view's own subqueries
                    text = text.replace(f"{{{n}}}", n)
                args = {n: self(n) for n in set(re.findall(r"\{(\w+)\}", text))}
                self._known[name] = self.spark.sql(text, **args)
            else:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        """A query whose {names} are views or tables."""
        return self.spark.sql(text, **{n: self(n) for n in set(re.findall(r"\{(\w+)\}", text))})
