"""SQL and job documents, and the refresh of assets, edges and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions import etl_rules as E
from stemma.operators import documents as D
from stemma.operators import graph as G
from stemma.plans import texts, warehouse
from stemma.plans.registry import Inputs, query
from stemma.plans.star import RELATIONS
from stemma.session import materialize
from stemma.sources.files import parse_etl_configs

# ---- SQL documents ------------------------------------------------------------

RELATIONS["x_sql_docs"] = f"""
select 'sql:reports/q'||sql_id||'.sql' as id, 'reports/q'||sql_id||'.sql' as source, {texts.DESCRIBED} as description, tables, statement_type, joins, trim(sql) as sql
from (select p.*, s.sql from {{x_parsed}} p join {{sql_texts}} s on s.sql_id = p.sql_id)
where trim(sql) <> ''
"""
SQL_TEXT = (
    "'SQL asset '||source||': '||description||'. Statement type: '||statement_type||'.'"
    "||case when tables <> '' then ' Tables: '||tables||'.' else '' end"
    "||case when joins <> '' then ' Joins: '||joins||'.' else '' end||' SQL: '||substring(sql, 1, 2000)"
)


def sql_files(t: Inputs) -> DataFrame:
    path = F.concat(F.lit("reports\\q"), F.col("sql_id").cast("string"), F.lit(".sql"))
    return t.spread("sql_texts", "sql_id").select(path.alias("source"), "sql")


def sql_docs(t: Inputs) -> DataFrame:
    return D.sql_documents(sql_files(t))


def _document_row(docs: DataFrame) -> DataFrame:
    return docs.select("id", "text", "asset_type", "name", "owner", "description")


@query(
    "sql_document",
    f"select id, {SQL_TEXT} as text, 'sql' as asset_type, source as name, 'unknown' as owner, description from {{x_sql_docs}}",
)
def sql_document(t: Inputs) -> DataFrame:
    return _document_row(sql_docs(t))


RELATIONS["x_sql_edges"] = """
select unnest(string_split(tables, ', ')) as source_asset_id, id as target_asset_id, 'sql_reference' as relationship_type
from {x_sql_docs} where tables <> ''
"""


@query("sql_lineage_edges", "select * from {x_sql_edges}")
def sql_lineage_edges(t: Inputs) -> DataFrame:
    return D.document_edges(sql_docs(t))


# ---- job documents ------------------------------------------------------------

# Expected jobs per text shape, by hand.
RELATIONS["x_jobs"] = """
select source, 'load' as name, 'Load order '||o_orderkey as description, 'team '||o_orderstatus as owner, '0 2 * * *' as schedule,
 'stage.c'||o_custkey||', public.orders' as sources, 'mart.o'||o_orderkey as targets, 'join; sum' as transformations,
 'etl:first, second, {{"name":"third"}}' as dependencies, 'etl:first, etl:second, etl:third' as dependency_ids, true as described
from {etl_texts} where shape = '1'
union all select source, 'a', '', '', '', 'public.x'||o_custkey, '', '', '', '', false from {etl_texts} where shape = '2'
union all select source, 'load_o'||o_orderkey, '', '', '', 'public.b'||o_custkey, '', '', '{{"etl":"up'||o_orderkey||'"}}', 'etl:up'||o_orderkey, false from {etl_texts} where shape = '2'
union all select source, 'l'||o_orderkey, '', '', '', '', 'public.quoted', '', '', '', false from {etl_texts} where shape = '3'
union all select source, 'p', '', '', '', '', '', '', '', '', false from {etl_texts} where shape = '4'
"""
JOB_TEXT = (
    "'ETL process '||name||'.'||case when description <> '' then ' '||description else '' end"
    "||case when sources <> '' then ' Reads from: '||sources||'.' else '' end"
    "||case when targets <> '' then ' Writes to: '||targets||'.' else '' end"
    "||case when transformations <> '' then ' Transformations: '||transformations||'.' else '' end"
    "||case when schedule <> '' then ' Schedule: '||schedule||'.' else '' end"
)


def jobs(t: Inputs) -> DataFrame:
    return parse_etl_configs(t.spread("etl_texts", "o_orderkey").select("source", "path", "text"))


def _job_row(df: DataFrame) -> DataFrame:
    def joined(c: str, sep: str = ", "):
        return F.array_join(c, sep).alias(c)

    return df.select(
        "source", "name", "description", "owner", "schedule", joined("sources"), joined("targets"),
        joined("transformations", "; "), joined("dependencies"), joined("dependency_ids"),
    )


@query("etl_extract_jobs", "select source, name from {x_jobs}")
def etl_extract_jobs(t: Inputs) -> DataFrame:
    return jobs(t).select("source", "name")


@query(
    "etl_normalize_job",
    "select source, name, description, owner, schedule, sources, targets, transformations, dependencies, dependency_ids from {x_jobs}",
)
def etl_normalize_job(t: Inputs) -> DataFrame:
    return _job_row(jobs(t))


@query("etl_documentation", f"select source, name, {JOB_TEXT} as documentation from {{x_jobs}}")
def etl_documentation(t: Inputs) -> DataFrame:
    return jobs(t).select("source", "name", E.job_documentation().alias("documentation"))


def etl_docs(t: Inputs) -> DataFrame:
    return D.etl_documents(jobs(t))


RELATIONS["x_etl_docs"] = f"""
select 'etl:'||source||'#'||name as id,
 'ETL asset '||name||' ('||source||'): '||{JOB_TEXT}
 ||case when dependencies <> '' then ' Dependencies: '||dependencies||'.' when name = 'p' then ' Dependencies: .' else '' end as text,
 'etl' as asset_type, name, case when owner = '' then 'unknown' else owner end as owner, description
from {{x_jobs}}
"""


@query("etl_document", "select * from {x_etl_docs}")
def etl_document(t: Inputs) -> DataFrame:
    return _document_row(etl_docs(t))


RELATIONS["x_etl_edges"] = """
select unnest(string_split(sources, ', ')) as source_asset_id, 'etl:'||source||'#'||name as target_asset_id, 'etl_source' as relationship_type from {x_jobs} where sources <> ''
union all select 'etl:'||source||'#'||name, unnest(string_split(targets, ', ')), 'etl_target' from {x_jobs} where targets <> ''
union all select unnest(string_split(dependency_ids, ', ')), 'etl:'||source||'#'||name, 'etl_depends_on' from {x_jobs} where dependency_ids <> ''
"""


@query("etl_lineage_edges", "select * from {x_etl_edges}")
def etl_lineage_edges(t: Inputs) -> DataFrame:
    return D.document_edges(etl_docs(t))


RELATIONS["raw_dependencies"] = """
select o_orderkey as id,
 case o_orderpriority when '1-URGENT' then 'etl:load_'||o_orderkey when '2-HIGH' then '  job_'||o_orderkey||' ' when '3-MEDIUM' then '' when '4-NOT SPECIFIED' then null else 'sql:x' end as raw,
 case when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then 'e'||o_orderkey end as etl,
 case when o_orderstatus = 'O' and o_orderpriority = '4-NOT SPECIFIED' then 'n'||o_orderkey end as name
from {orders}
"""


@query(
    "normalize_dependency",
    """
select id, case when etl is not null then 'etl:'||etl when name is not null then 'etl:'||name
 when trim(coalesce(raw, '')) = '' then '' when trim(raw) like 'etl:%' then trim(raw) else 'etl:'||trim(raw) end as dependency
from {raw_dependencies}
""",
)
def normalize_dependency(t: Inputs) -> DataFrame:
    dep = E.normalize_dependency(F.col("raw"), F.col("etl"), F.col("name"))
    return t("raw_dependencies").select("id", dep.alias("dependency"))


# ---- all documents and the refresh --------------------------------------------


def documents(t: Inputs) -> DataFrame:
    return D.build_documents(warehouse.table_docs(t), sql_docs(t), etl_docs(t))


RELATIONS["x_documents"] = f"""
select id, text, 'table' as asset_type, id as name, 'unknown' as owner, description from {{x_table_docs}}
union all select id, {SQL_TEXT}, 'sql', source, 'unknown', description from {{x_sql_docs}}
union all select id, text, asset_type, name, owner, description from {{x_etl_docs}}
"""
RELATIONS["x_document_edges"] = """
select source as source_asset_id, target as target_asset_id, relationship_type from {x_foreign}
union all select * from {x_sql_edges}
union all select * from {x_etl_edges}
"""


@query("build_documents", "select * from {x_documents}")
def build_documents(t: Inputs) -> DataFrame:
    return _document_row(documents(t))


@query("doc_counts_by_type", "select asset_type, count(*) as n from {x_documents} group by asset_type")
def doc_counts_by_type(t: Inputs) -> DataFrame:
    return D.counts_by_type(documents(t))


@query(
    "refresh_assets_edges",
    """
select 'asset' as kind, id as a, asset_type as b, name as c, case when description = '' then substring(text, 1, 500) else description end as d, owner as e from {x_documents}
union all select distinct 'edge', source_asset_id, target_asset_id, relationship_type, '', '' from {x_document_edges}
""",
)
def refresh_assets_edges(t: Inputs) -> DataFrame:
    docs = materialize(documents(t), "documents")
    edges = D.document_edges(docs).distinct()
    assets = D.document_assets(docs).select(
        F.lit("asset").alias("kind"), F.col("asset_id").alias("a"), F.col("asset_type").alias("b"),
        F.col("name").alias("c"), F.col("description").alias("d"), F.col("owner").alias("e"),
    )
    return assets.unionByName(
        edges.select(
            F.lit("edge").alias("kind"), F.col("source_asset_id").alias("a"),
            F.col("target_asset_id").alias("b"), F.col("relationship_type").alias("c"),
            F.lit("").alias("d"), F.lit("").alias("e"),
        )
    )


@query(
    "refresh_summary",
    """
select count(*) as tables_updated, count(*) as records_processed,
 cast(sum(case when asset_type = 'etl' then 1 else 0 end) as bigint) as etl_processes_parsed,
 cast(sum(case when asset_type = 'sql' then 1 else 0 end) as bigint) as sql_queries_parsed,
 count(*) as embeddings_generated, count(*) as documents_added, count(*) as assets_registered,
 (select count(*) from {x_document_edges}) as relationships_added
from {x_documents}
""",
)
def refresh_summary(t: Inputs) -> DataFrame:
    return D.refresh_summary(documents(t))


@query(
    "document_impact",
    """
with e as (select distinct * from {x_document_edges}),
d as (select id, count(*) as n from (select source_asset_id as id from e union all select target_asset_id from e) group by id)
select x.id as asset_id, coalesce(d.n, 0) as degree, least(1.0::double, coalesce(d.n, 0) / 10.0::double) as impact_score
from {x_documents} x left join d on d.id = x.id
""",
)
def document_impact(t: Inputs) -> DataFrame:
    docs = materialize(documents(t), "documents")
    assets = D.document_assets(docs).withColumn("impact_score", F.lit(0.0))
    edges = D.document_edges(docs).distinct()
    return G.impact_scores(edges, assets).select(
        "asset_id", "degree", F.col("calculated_score").alias("impact_score")
    )
