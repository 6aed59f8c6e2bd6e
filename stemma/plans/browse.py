"""Catalog browsing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators import catalog as C
from stemma.operators import graph as G
from stemma.operators import history as H
from stemma.plans.registry import Inputs, query
from stemma.plans.star import RELATIONS

ASSET_COLUMNS = "asset_id, asset_type, name, description, owner, impact_score"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*ASSET_COLUMNS.split(", "))


@query(
    "asset_lookup",
    """
select e.target_asset_id as asset_id, a.asset_type, a.name, a.owner, a.impact_score
from (select distinct target_asset_id from {edges}) e left join {assets} a on a.asset_id = e.target_asset_id
""",
)
def asset_lookup(t: Inputs) -> DataFrame:
    ids = t("edges").select(F.col("target_asset_id").alias("asset_id")).distinct()
    return C.asset_lookup(ids, t("assets")).select("asset_id", "asset_type", "name", "owner", "impact_score")


@query(
    "list_tables",
    f"select {ASSET_COLUMNS} from {{assets}} where asset_type = 'table' and (contains(lower(name), 'er.c1') or contains(lower(asset_id), 'er.c1'))",
)
def list_tables(t: Inputs) -> DataFrame:
    return _shown(C.list_tables(t("assets"), "ER.c1"))


@query(
    "list_reports",
    f"select {ASSET_COLUMNS} from {{assets}} where asset_type = 'report' and contains(lower(coalesce(owner, 'None')), 'urgent')",
)
def list_reports(t: Inputs) -> DataFrame:
    return _shown(C.list_reports(t("assets"), "Urgent"))


@query("list_etl_processes", f"select {ASSET_COLUMNS} from {{assets}} where asset_type = 'etl'")
def list_etl_processes(t: Inputs) -> DataFrame:
    return _shown(C.list_etl_processes(t("assets")))


@query(
    "search_by_owner",
    f"select {ASSET_COLUMNS} from {{assets}} where contains(lower(coalesce(owner, 'None')), 'none')",
)
def search_by_owner(t: Inputs) -> DataFrame:
    return _shown(C.search_by_owner(t("assets"), "NONE"))


@query(
    "catalog_summary",
    """
select count(*) as total_assets,
 cast(coalesce(sum(case when asset_type = 'table' then 1 else 0 end), 0) as bigint) as tables,
 cast(coalesce(sum(case when asset_type = 'view' then 1 else 0 end), 0) as bigint) as views,
 cast(coalesce(sum(case when asset_type = 'report' then 1 else 0 end), 0) as bigint) as reports,
 cast(coalesce(sum(case when asset_type = 'sql' then 1 else 0 end), 0) as bigint) as sql_assets,
 cast(coalesce(sum(case when asset_type = 'etl' then 1 else 0 end), 0) as bigint) as etl_processes,
 'never' as last_refresh
from {assets}
""",
)
def catalog_summary(t: Inputs) -> DataFrame:
    never = F.coalesce(F.col("last_refresh").cast("string"), F.lit("never"))
    return C.catalog_summary(t("assets")).withColumn("last_refresh", never)


@query(
    "display_limits",
    """
with n as (
 select neighbour_id, asset_id, asset_type, row_number() over (partition by asset_id order by neighbour_id, relationship_type) as position,
  count(*) over (partition by asset_id) as total
 from {x_neighbours} where side = 'downstream')
select n.asset_id, cast(position as integer) as position, '- `'||neighbour_id||'`'||case when n.asset_type is null then '' else ' ('||n.asset_type||')' end as line
 from n join {assets} a on a.asset_id = n.asset_id where position <= 12
union all select n.asset_id, 13, '- … and '||(total - 12)||' more' from n join {assets} a on a.asset_id = n.asset_id where position = 13
union all select asset_id, 1, '- (none)' from {assets} where asset_id not in (select asset_id from n)
""",
)
def display_limits(t: Inputs) -> DataFrame:
    assets = t("assets")
    return C.bullet_lines(assets, G.downstream_assets(t("edges"), assets))


@query(
    "catalog_listing",
    """
with tables as (select asset_id from {assets} where asset_type = 'table'),
jobs as (select asset_id from {assets} where asset_type = 'etl')
select 'summary' as section, '- **Total assets:** '||count(*) as line from {assets}
union all select 'summary', '- **Tables:** '||count(*) from tables
union all select 'summary', '- **SQL assets:** '||count(*) from {assets} where asset_type = 'sql'
union all select 'summary', '- **ETL jobs:** '||count(*) from jobs
union all select 'tables', '## Tables ('||count(*)||')' from tables
union all select 'tables_more', '- … and '||(count(*) - 25)||' more' from tables having count(*) > 25
union all select 'jobs', '## ETL processes ('||count(*)||')' from jobs
union all (select 'table', '- `'||asset_id||'`' from tables order by asset_id limit 25)
union all (select 'job', '- `'||asset_id||'`' from jobs order by asset_id limit 15)
""",
)
def catalog_listing(t: Inputs) -> DataFrame:
    return C.catalog_listing(t("assets"))


@query(
    "short_texts",
    """
select asset_id, asset_id||' ('||asset_type||')' as label, substring(coalesce(description, ''), 1, 400) as shown_description from {assets}
""",
)
def short_texts(t: Inputs) -> DataFrame:
    return C.short_texts(t("assets"))


@query(
    "catalog_cube",
    """
select asset_type, owner, split_part(asset_id, '.', 1) as "schema",
 cast(grouping(asset_type, owner, split_part(asset_id, '.', 1)) as int) as level, count(*) as assets,
 cast(sum(case when impact_score > 0 then 1 else 0 end) as bigint) as scored, max(impact_score) as max_score
from {assets} group by cube (asset_type, owner, split_part(asset_id, '.', 1))
""",
)
def catalog_cube(t: Inputs) -> DataFrame:
    return C.catalog_cube(t("assets"))


# Each order is a version of its customer's record; every shipped line asks for the record of its day.
RELATIONS["record_versions"] = """
select 'customer.c'||o_custkey as asset_id, o_orderdate as valid_from, o_orderkey, o_orderpriority as owner, o_orderstatus = 'P' as ended
from {orders}
"""
RELATIONS["record_requests"] = """
select 'customer.c'||o_custkey as asset_id, l_shipdate as at, l_orderkey, l_linenumber from {lineitem} join {orders} on o_orderkey = l_orderkey
union all select 'customer.c'||c_custkey, cast('1992-06-30 00:00:00' as timestamp), 0, 0 from {customer}
"""


@query(
    "asset_as_of",
    """
with v as (
 select asset_id, valid_from, max((ended, o_orderkey, owner)) as x from {record_versions} group by asset_id, valid_from
)
select r.asset_id, r.at, r.l_orderkey, r.l_linenumber, case when not x[1] then x[2] end as version_order, case when not x[1] then x[3] end as owner,
 case when not x[1] then v.valid_from end as valid_from
from {record_requests} r asof left join v on r.asset_id = v.asset_id and r.at >= v.valid_from
""",
)
def asset_as_of(t: Inputs) -> DataFrame:
    found = H.as_of(t("record_requests"), t("record_versions"))
    return found.select(
        "asset_id", "at", "l_orderkey", "l_linenumber", F.col("version.o_orderkey").alias("version_order"), "version.owner", "version.valid_from"
    )
