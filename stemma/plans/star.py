"""Catalog relations derived from the given star schema.

Each relation is one SELECT that both Spark and the comparison engine run as is (those in ``BUILT`` Spark derives by
DataFrames); ``{name}`` stands for a given table or another relation. All rows of the given
tables take part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.session import TABLES, materialize, table

RELATIONS: dict[str, str] = {}

# Relations that several scans of one query read: written once, not derived again each time.
STORED = ("wh_columns", "wh_key_usage")

RELATIONS["edges"] = """
select 'supplier.s'||l_suppkey as source_asset_id, 'part.p'||l_partkey as target_asset_id, 'supplies' as relationship_type from (select distinct l_suppkey, l_partkey from {lineitem}) s
union all select 'part.p'||l_partkey, 'ord.o'||l_orderkey, 'line_item' from (select distinct l_partkey, l_orderkey from {lineitem}) l
union all select 'customer.c'||o_custkey, 'ord.o'||o_orderkey, 'foreign_key' from {orders}
union all select 'nation.n'||c_nationkey, 'customer.c'||c_custkey, 'foreign_key' from {customer}
"""

# Pending orders and nations are not registered, so they are missing neighbours.
RELATIONS["assets"] = """
select 'part.p'||p_partkey as asset_id, 'table' as asset_type, p_name as name, p_type as description, p_brand as owner, cast(null as varchar(10)) as metadata, cast(0.0 as double) as impact_score from {part}
union all select 'supplier.s'||s_suppkey, 'etl', s_name, 'supplier feed', 'nation '||s_nationkey, '{{}}', cast(0.0 as double) from {supplier}
union all select 'ord.o'||o_orderkey, case when o_orderstatus = 'O' then 'sql' when o_orderpriority = '5-LOW' then 'view' else 'report' end, 'order '||o_orderkey, 'order document', o_orderpriority, cast(null as varchar(10)), cast(case when o_totalprice > 400000 then 0.95 else 0.0 end as double) from {orders} where o_orderstatus <> 'P'
union all select 'customer.c'||c_custkey, 'table', c_name, 'customer master', case when c_acctbal < 0 then null else c_mktsegment end, cast(null as varchar(10)), cast(0.0 as double) from {customer}
"""

RELATIONS["change_requests"] = """
select event_id as request_id,
  case when event_type = 'error' and value < 20 then '  ' else 'customer.c'||user_id end as field_asset,
  case event_type when 'click' then 'Drop column value on customer.c'||user_id
    when 'view' then 'Rename column c_name to legal_name on part.p'||(user_id*3)
    when 'purchase' then 'migrate data to warehouse.fact'||user_id
    when 'signup' then 'ALTER TABLE Supplier.S'||user_id||' ADD COLUMN sku text'
    else 'Rename order_id column' end as change_text
from {events}
"""

RELATIONS["sql_texts"] = """
select o_orderkey as sql_id, substring(o_orderpriority, 1, 1)||o_orderstatus as shape,
 case substring(o_orderpriority, 1, 1)||o_orderstatus
  when '1F' then 'SELECT * FROM public.orders o JOIN public.customer c ON o.k = c.k WHERE o.id = '||o_orderkey
  when '2F' then 'DROP TABLE t'||o_orderkey
  when '3F' then 'select p_name, l.qty q from part, lineitem l group by p_name'
  when '4F' then 'INSERT INTO sales.fact SELECT a FROM stage.s'||o_custkey
  when '5F' then 'UPDATE dim SET deleted_at = 1'
  when '1O' then 'WITH t AS (SELECT k FROM a.base) SELECT k FROM t JOIN region r'
  when '2O' then ''
  when '3O' then 'grant all on orders'
  when '4O' then 'select o.id, count(*) as n from orders o left outer join "Sales"."Items" i on i.id = o.id where o.note <> ''from nowhere'' -- join x'||chr(10)||' group by o.id'
  when '5O' then 'select extract(year from d) from facts f where f.k in (select k from dims where id = '||o_orderkey||')'
  when '1P' then '  '
  when '2P' then 'delete from stage.s'||o_custkey
  when '3P' then 'create table mart.m'||o_custkey||' as select x from src_a a, src_b b cross join src_c'
  when '4P' then 'select sub.n from (select n from base_'||o_custkey||') sub natural join names'
  else 'show tables' end as sql
from {orders}
"""

RELATIONS["llm_replies"] = """
select conv_id*1000+turn as reply_id, turn,
 case turn
  when 1 then '```sql'||chr(10)||'SELECT a FROM t'||conv_id||';'||chr(10)||'```'||chr(10)||'EXPLANATION: uses t'
  when 3 then 'Sure, here it is: select b from u where k = '||conv_id||'; hope it helps'
  when 5 then 'DROP TABLE x'||chr(10)||'is what you asked for'
  when 7 then 'SELECT c FROM v explanation: short'
  when 2 then ''
  when 4 then 'sql'||chr(10)||'WITH q AS (SELECT 1) SELECT * FROM q'
  else '`update w set a = 1`' end as reply
from {conversations} where role = 'assistant'
"""

# ---- a warehouse catalog: one table per order, one column per order line ------

RELATIONS["wh_tables"] = """
select case substring(o_orderpriority, 1, 1) when '1' then 'urgent' when '2' then 'high' when '3' then 'medium' when '4' then 'plain' else 'low' end as table_schema,
 'o'||o_orderkey as table_name,
 case when o_orderstatus = 'P' then 'VIEW' else 'BASE TABLE' end as table_type
from {orders}
union all select 'pg_catalog', 'n'||n_nationkey, 'BASE TABLE' from {nation}
union all select 'public', 'c'||c_custkey, 'BASE TABLE' from {customer}
"""

RELATIONS["wh_lines"] = """
select l_orderkey, l_linenumber, min(l_returnflag) as flag, max(l_linestatus) as status, max(l_tax) as tax
from {lineitem} group by l_orderkey, l_linenumber
"""

RELATIONS["wh_columns"] = """
select t.table_schema, t.table_name, 'col'||l.l_linenumber as column_name,
 case l.flag when 'A' then 'integer' when 'N' then 'text' else 'numeric' end as data_type,
 case when l.status = 'O' then 'YES' else 'NO' end as is_nullable,
 case when l.tax > 0.07 then 'nextval(''s'||l.l_linenumber||''')' when l.tax < 0.02 then '' end as column_default,
 l.l_linenumber as ordinal_position
from {wh_lines} l join {wh_tables} t on t.table_name = 'o'||l.l_orderkey
"""

RELATIONS["wh_classes"] = """
select o_orderkey as oid, 'o'||o_orderkey as relname, cast(substring(o_orderpriority, 1, 1) as bigint) as relnamespace,
 case when o_orderstatus = 'P' then 'v' else 'r' end as relkind,
 case when o_totalprice > 250000 then 'order of customer '||o_custkey when o_totalprice > 100000 then '' end as description
from {orders}
"""

RELATIONS["wh_namespaces"] = """
select distinct cast(substring(o_orderpriority, 1, 1) as bigint) as oid,
 case substring(o_orderpriority, 1, 1) when '1' then 'urgent' when '2' then 'high' when '3' then 'medium' when '4' then 'plain' else 'low' end as nspname
from {orders}
"""

# Key lines 1 and 2 form the primary key; returned lines form one foreign key per table.
RELATIONS["wh_key_usage"] = """
select table_name||'_pkey' as constraint_name, table_schema, table_name, column_name, ordinal_position from {wh_columns} where ordinal_position <= 2
union all select table_name||'_fk', table_schema, table_name, column_name, ordinal_position from {wh_columns} where data_type = 'integer'
"""

RELATIONS["wh_constraints"] = """
select distinct constraint_name, table_schema, table_name,
 case when constraint_name like '%_pkey' then 'PRIMARY KEY' else 'FOREIGN KEY' end as constraint_type
from {wh_key_usage}
"""

RELATIONS["wh_constraint_usage"] = """
select k.constraint_name, k.table_schema, 'c'||o.o_custkey as table_name, 'ref_'||k.column_name as column_name
from {wh_key_usage} k join {orders} o on k.table_name = 'o'||o.o_orderkey where k.constraint_name like '%_fk'
"""

# Tables of cheap orders are left out of the catalog.
RELATIONS["wh_exclude"] = """
select case substring(o_orderpriority, 1, 1) when '1' then 'urgent' when '2' then 'high' when '3' then 'medium' when '4' then 'plain' else 'low' end||'.o'||o_orderkey as qualified_name
from {orders} where o_totalprice < 20000
"""

# ---- job definition texts, one small JSON file per order ----------------------

RELATIONS["etl_texts"] = """
select 'jobs/load_o'||o_orderkey||'.json' as source, 'jobs/load_o'||o_orderkey||'.json' as path, substring(o_orderpriority, 1, 1) as shape, o_orderkey, o_custkey, o_orderstatus,
 case substring(o_orderpriority, 1, 1)
  when '1' then '{{"name": "load", "description": "Load order '||o_orderkey||'", "owner": "team '||o_orderstatus||'", "schedule": "0 2 * * *", "sources": ["Stage.C'||o_custkey||'", "orders", ""], "targets": ["mart.o'||o_orderkey||'"], "transformations": ["join", "sum"], "dependencies": ["etl:first", "second", {{"name": "third"}}]}}'
  when '2' then '{{"etl_jobs": [{{"name": "a", "sources": "public.x'||o_custkey||'", "targets": []}}, "noise", {{"name": "a", "sources": ["dup"]}}, {{"sources": ["b'||o_custkey||'"], "dependencies": [{{"etl": "up'||o_orderkey||'"}}]}}]}}'
  when '3' then '[{{"name": "l'||o_orderkey||'", "targets": ["''Quoted''"]}}, 5]'
  when '4' then '{{"jobs": 3, "processes": [{{"name": "p", "owner": "", "dependencies": [""]}}]}}'
  else '{{"broken": ' end as text
from {orders}
"""


#: Line items whose pairs one task makes distinct.
PAIR_ROWS = 500_000


def dealt(items: DataFrame) -> int:
    """Tasks over which rows are dealt of which there are about as many as line items."""
    return max(items.sparkSession.sparkContext.defaultParallelism, math.ceil(items.count() / PAIR_ROWS))


def dealt_edges(parts: dict[str, DataFrame]) -> DataFrame:
    """The rows of ``edges`` with the pairs of line items dealt over a number of tasks that grows with the line items.

    Adaptive execution merges shuffled partitions by their compressed bytes. Pairs of numbers compress well, so a task
    would hold many millions of them, beside the counts per text id that follow in the same stage.
    """
    items = parts["lineitem"]
    n = dealt(items)

    def pairs(a: str, b: str) -> DataFrame:
        return items.select(a, b).repartition(n, a, b).distinct()

    def named(rows: DataFrame, a: tuple[str, str], b: tuple[str, str], kind: str) -> DataFrame:
        ends = [F.concat(F.lit(head), F.col(key).cast("string")).alias(name)
                for (head, key), name in ((a, "source_asset_id"), (b, "target_asset_id"))]
        return rows.select(*ends, F.lit(kind).alias("relationship_type"))

    supplier, part, order = ("supplier.s", "l_suppkey"), ("part.p", "l_partkey"), ("ord.o", "l_orderkey")
    return (
        named(pairs("l_suppkey", "l_partkey"), supplier, part, "supplies")
        .unionAll(named(pairs("l_partkey", "l_orderkey"), part, order, "line_item"))
        .unionAll(named(parts["orders"], ("customer.c", "o_custkey"), ("ord.o", "o_orderkey"), "foreign_key"))
        .unionAll(named(parts["customer"], ("nation.n", "c_nationkey"), ("customer.c", "c_custkey"), "foreign_key"))
    )


# Relations that Spark derives by DataFrames, with the rows of their SELECT.
BUILT: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = {"edges": dealt_edges}


def names_in(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def relation(
    spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None
) -> DataFrame:
    """A given table or a derived relation; ``known`` keeps those already built."""
    known = {} if known is None else known
    if name not in known:
        if name in TABLES:
            known[name] = table(spark, sf_dir, name)
        else:
            text = RELATIONS[name]
            parts = {n: relation(spark, sf_dir, n, known) for n in names_in(text)}
            derived = BUILT[name](parts) if name in BUILT else spark.sql(text, **parts)
            known[name] = materialize(derived, name) if name in STORED else derived
    return known[name]


def comparison(text: str) -> str:
    """Comparison SQL: each ``{relation}`` in the text becomes a named sub-select in front."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for n in names_in(sql):
            if n not in TABLES and n not in needed:
                visit(RELATIONS[n])
                needed.append(n)

    def plain(sql: str) -> str:
        return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", sql).replace("{{", "{").replace("}}", "}").strip()

    visit(text)
    heads = ",\n".join(f"{n} as (\n{plain(RELATIONS[n])}\n)" for n in needed)
    body = plain(text)
    if not heads:
        return body
    for start in ("with recursive ", "with "):
        if body.lower().startswith(start):
            return f"{start}{heads},\n{body[len(start):]}"
    return f"with {heads}\n{body}"
