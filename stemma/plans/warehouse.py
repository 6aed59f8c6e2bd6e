"""Warehouse catalog scans and the documents built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators import documents as D
from stemma.plans.registry import Inputs, query
from stemma.plans.star import RELATIONS
from stemma.sources import warehouse as WH

# ---- comparison-only relations ------------------------------------------------

RELATIONS["x_kept"] = """
select table_schema, table_name, table_schema||'.'||table_name as qualified_name from {wh_tables}
where table_type = 'BASE TABLE' and table_schema not in ('pg_catalog', 'information_schema')
 and table_schema||'.'||table_name not in (select qualified_name from {wh_exclude})
"""
RELATIONS["x_columns"] = """
select c.table_schema, c.table_name, c.ordinal_position, c.column_name as name, c.data_type as type,
 c.is_nullable = 'YES' as nullable, c.column_default as "default"
from {wh_columns} c join {x_kept} k on k.table_schema = c.table_schema and k.table_name = c.table_name
"""
RELATIONS["x_comments"] = """
select k.table_schema, k.table_name, c.description
from {wh_classes} c join {wh_namespaces} n on n.oid = c.relnamespace
join {x_kept} k on k.table_schema = n.nspname and k.table_name = c.relname
where c.relkind = 'r' and c.description <> ''
"""
RELATIONS["x_primary"] = """
select k.table_schema, k.table_name, u.ordinal_position, u.column_name
from {wh_constraints} c join {wh_key_usage} u on u.constraint_name = c.constraint_name and u.table_schema = c.table_schema and u.table_name = c.table_name
join {x_kept} k on k.table_schema = c.table_schema and k.table_name = c.table_name
where c.constraint_type = 'PRIMARY KEY'
"""
RELATIONS["x_foreign"] = """
select k.table_schema, k.table_name, u.column_name as "column", r.table_schema||'.'||r.table_name as "references",
 r.column_name as foreign_column, r.table_schema||'.'||r.table_name as source, k.qualified_name as target, 'foreign_key' as relationship_type
from {wh_constraints} c join {wh_key_usage} u on u.constraint_name = c.constraint_name and u.table_schema = c.table_schema and u.table_name = c.table_name
join {wh_constraint_usage} r on r.constraint_name = c.constraint_name and r.table_schema = c.table_schema
join {x_kept} k on k.table_schema = c.table_schema and k.table_name = c.table_name
where c.constraint_type = 'FOREIGN KEY'
"""
DETAIL = (
    "name||' ('||type||')'||case when nullable then ' nullable' else '' end"
    "||case when coalesce(\"default\", '') <> '' then ' default='||\"default\" else '' end"
)
RELATIONS["x_table_docs"] = f"""
with col as (
 select table_schema, table_name, string_agg(name, ', ' order by ordinal_position) as names,
  string_agg({DETAIL}, '; ' order by ordinal_position) as details
 from {{x_columns}} group by all),
pk as (select table_schema, table_name, string_agg(column_name, ', ' order by ordinal_position) as keys from {{x_primary}} group by all),
fk as (
 select table_schema, table_name,
  string_agg("column"||' -> '||"references"||'.'||foreign_column, '; ' order by "column", "references", foreign_column) as keys,
  count(*) as n
 from {{x_foreign}} group by all)
select k.qualified_name as id, k.table_schema, k.table_name, coalesce(c.description, '') as description,
 col.names, col.details, pk.keys as primary_keys, fk.keys as foreign_keys, coalesce(fk.n, 0) as foreign_key_rows,
 'Table '||k.qualified_name||': '||coalesce(c.description, 'No description')||'.'
 ||coalesce(' Primary keys: '||pk.keys||'.', '')||coalesce(' Foreign keys: '||fk.keys||'.', '')
 ||coalesce(' Columns: '||col.names||'. Details: '||col.details||'.', '') as text
from {{x_kept}} k left join {{x_comments}} c using (table_schema, table_name) left join col using (table_schema, table_name)
left join pk using (table_schema, table_name) left join fk using (table_schema, table_name)
"""


# ---- scans --------------------------------------------------------------------


def kept(t: Inputs) -> DataFrame:
    return WH.scan_base_tables(t("wh_tables"), exclude=t("wh_exclude"))


@query("scan_base_tables", "select * from {x_kept} order by table_schema, table_name")
def scan_base_tables(t: Inputs) -> DataFrame:
    return WH.ordered_tables(kept(t))


@query("scan_columns", "select * from {x_columns}")
def scan_columns(t: Inputs) -> DataFrame:
    return WH.scan_columns(t("wh_columns"), kept(t))


@query("scan_table_comments", "select * from {x_comments}")
def scan_table_comments(t: Inputs) -> DataFrame:
    return WH.scan_table_comments(t("wh_classes"), t("wh_namespaces"), kept(t))


@query("scan_primary_keys", "select * from {x_primary}")
def scan_primary_keys(t: Inputs) -> DataFrame:
    return WH.scan_primary_keys(t("wh_constraints"), t("wh_key_usage"), kept(t))


def _foreign(t: Inputs) -> DataFrame:
    return WH.scan_foreign_keys(t("wh_constraints"), t("wh_key_usage"), t("wh_constraint_usage"), kept(t))


@query("scan_foreign_keys", "select * from {x_foreign}")
def scan_foreign_keys(t: Inputs) -> DataFrame:
    return _foreign(t)


@query(
    "foreign_key_edges",
    "select distinct source as source_asset_id, target as target_asset_id, relationship_type from {x_foreign}",
)
def foreign_key_edges(t: Inputs) -> DataFrame:
    return WH.foreign_key_edges(_foreign(t))


def metadata(t: Inputs) -> DataFrame:
    return WH.assemble_table_metadata(
        kept(t),
        WH.scan_columns(t("wh_columns")),
        WH.scan_table_comments(t("wh_classes"), t("wh_namespaces")),
        WH.scan_primary_keys(t("wh_constraints"), t("wh_key_usage")),
        WH.scan_foreign_keys(t("wh_constraints"), t("wh_key_usage"), t("wh_constraint_usage")),
    )


def _flat(tables: DataFrame) -> DataFrame:
    return tables.select(
        "table_schema", "table_name", "name", "description", "owner", "asset_type",
        F.array_join(F.transform("columns", lambda c: c["name"]), ", ").alias("columns"),
        F.array_join("primary_keys", ", ").alias("primary_keys"),
        F.array_join(
            F.transform("foreign_keys", lambda k: F.concat(k["column"], F.lit(" -> "), k["references"], F.lit("."), k["foreign_column"])),
            "; ",
        ).alias("foreign_keys"),
    )


@query(
    "assemble_table_metadata",
    """
select table_schema, table_name, id as name, description, 'unknown' as owner, 'table' as asset_type, coalesce(names, '') as columns,
 coalesce(primary_keys, '') as primary_keys, coalesce(foreign_keys, '') as foreign_keys
from {x_table_docs}
""",
)
def assemble_table_metadata(t: Inputs) -> DataFrame:
    return _flat(metadata(t))


@query(
    "scan_tables_minimal",
    """
select table_schema, table_name, id as name, description, 'unknown' as owner, 'table' as asset_type, coalesce(names, '') as columns,
 '' as primary_keys, '' as foreign_keys
from {x_table_docs}
""",
)
def scan_tables_minimal(t: Inputs) -> DataFrame:
    comments = WH.scan_table_comments(t("wh_classes"), t("wh_namespaces"))
    return _flat(WH.assemble_table_metadata(kept(t), WH.scan_columns(t("wh_columns")), comments))


# Names users ask for: qualified, unqualified and unknown ones.
RELATIONS["asked_tables"] = """
select case when o_orderstatus = 'P' then 'o'||o_orderkey else case substring(o_orderpriority, 1, 1) when '1' then 'urgent' when '2' then 'high' when '3' then 'medium' when '4' then 'plain' else 'low' end||'.o'||o_orderkey end as table_ref
from {orders}
"""
RELATIONS["x_asked"] = """
select distinct table_ref, case when contains(table_ref, '.') then split_part(table_ref, '.', 1) else 'public' end as table_schema,
 case when contains(table_ref, '.') then split_part(table_ref, '.', 2) else table_ref end as table_name
from {asked_tables}
"""


@query(
    "table_schema_lookup",
    """
select a.table_ref, a.table_schema, a.table_name, c.ordinal_position, c.column_name as name, c.data_type as type,
 c.is_nullable = 'YES' as nullable, c.column_default as "default"
from {x_asked} a join {wh_columns} c using (table_schema, table_name)
""",
)
def table_schema_lookup(t: Inputs) -> DataFrame:
    return WH.table_schema_lookup(t("asked_tables"), t("wh_columns"))


@query(
    "table_comment_lookup",
    """
select a.table_ref, a.table_schema, a.table_name, c.description
from {x_asked} a left join (
 select n.nspname, c.relname, c.description from {wh_classes} c join {wh_namespaces} n on n.oid = c.relnamespace) c
 on c.nspname = a.table_schema and c.relname = a.table_name
""",
)
def table_comment_lookup(t: Inputs) -> DataFrame:
    return WH.table_comment_lookup(t("asked_tables"), t("wh_classes"), t("wh_namespaces"))


@query(
    "run_sql",
    "select n_name, count(*) as customers, sum(cast(c_acctbal as decimal(12,2)))::double as balance from {customer} join {nation} on n_nationkey = c_nationkey group by n_name",
)
def run_sql(t: Inputs) -> DataFrame:
    text = """
select n_name, count(*) as customers, cast(sum(cast(c_acctbal as decimal(12,2))) as double) as balance
from {customer} join {nation} on n_nationkey = c_nationkey group by n_name
"""
    return WH.run_sql(t.spark, text, {"customer": t("customer"), "nation": t("nation")})


# ---- documents ----------------------------------------------------------------


def table_docs(t: Inputs) -> DataFrame:
    return D.table_documents(metadata(t))


@query(
    "table_document",
    "select id, text, 'table' as asset_type, id as name, 'unknown' as owner, description, foreign_key_rows as edges from {x_table_docs}",
)
def table_document(t: Inputs) -> DataFrame:
    return table_docs(t).select(
        "id", "text", "asset_type", "name", "owner", "description",
        F.size("lineage_edges").cast("bigint").alias("edges"),
    )
