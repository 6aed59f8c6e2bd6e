"""Maintenance of stored relations, on data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators import catalog as C
from stemma.operators import store as ST
from stemma.plans.registry import Inputs, query
from stemma.plans.star import RELATIONS, dealt
from stemma.schemas import ASSETS
from stemma.session import new_folder
from stemma.sources import snapshots as SN

# Incoming batch: labelled documents in a new wording, and pages as new documents.
RELATIONS["incoming_docs"] = """
select 'doc-'||doc_id as id, cast(null as varchar(10)) as doc_id, cast(null as varchar(10)) as text, 'reviewed '||doc_id as content, cast(quality as varchar(10)) as quality, cast(null as varchar(10)) as url from {labels}
union all select '', 'page-'||page_id, html, 'unused', cast(null as varchar(10)), url from {pages}
"""
RELATIONS["x_incoming"] = """
select coalesce(nullif(id, ''), doc_id) as id, coalesce(nullif(text, ''), content, '') as text,
 concat_ws(';', 'quality='||quality, 'url='||url) as metadata
from {incoming_docs}
"""
RELATIONS["x_stored"] = "select 'doc-'||doc_id as id, text, 'lang='||lang||';source='||source as metadata from {documents}"


def stored_documents(t: Inputs) -> DataFrame:
    return t("documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        "text",
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"),
    )


def _flat(docs: DataFrame) -> DataFrame:
    entries = F.transform(
        F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return docs.withColumn("metadata", F.array_join(entries, ";"))


@query(
    "upsert_documents",
    "select * from {x_incoming} union all select * from {x_stored} where id not in (select id from {x_incoming})",
)
def upsert_documents(t: Inputs) -> DataFrame:
    return _flat(ST.upsert_documents(stored_documents(t), t("incoming_docs")))


@query(
    "delete_documents",
    "select id, text from {x_stored} where id not in (select 'doc-'||doc_id from {labels} where toxic = 1)",
)
def delete_documents(t: Inputs) -> DataFrame:
    ids = t("labels").where(F.col("toxic") == 1).select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"))
    return ST.delete_documents(stored_documents(t), ids).select("id", "text")


@query(
    "update_document_metadata",
    """
select 'doc-'||d.doc_id as id, 'lang='||d.lang||coalesce(';quality='||l.quality, '')||';source='||case when l.doc_id is null then d.source else 'reviewed' end as metadata
from {documents} d left join {labels} l on l.doc_id = d.doc_id
""",
)
def update_document_metadata(t: Inputs) -> DataFrame:
    changes = t("labels").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.create_map(
            F.lit("source"), F.lit("reviewed"), F.lit("quality"), F.col("quality").cast("string")
        ).alias("metadata"),
    )
    return _flat(ST.update_document_metadata(stored_documents(t), changes)).select("id", "metadata")


@query("clear_documents", "select count(*) as documents_before, 0::bigint as documents_after from {x_stored}")
def clear_documents(t: Inputs) -> DataFrame:
    docs = stored_documents(t)
    store = new_folder(t.spark, "store")
    SN.save_snapshot(docs, store, "documents")
    before = SN.load_snapshot(t.spark, store, "documents", docs.schema)
    SN.save_snapshot(ST.clear_documents(before), store, "documents")
    after = SN.load_snapshot(t.spark, store, "documents", docs.schema)
    return before.agg(F.count("id").alias("documents_before")).withColumn(
        "documents_after", after.agg(F.count("id")).scalar()
    )


@query(
    "flatten_metadata",
    """
select c_custkey as id, concat_ws(';',
 case when c_acctbal >= 0 then 'balance_known=true' end,
 'names=["'||c_name||'","'||c_mktsegment||'"]',
 'place={{"nation":'||c_nationkey||'}}',
 case when c_mktsegment <> 'BUILDING' then 'segment='||c_mktsegment end) as metadata
from {customer}
""",
)
def flatten_metadata(t: Inputs) -> DataFrame:
    rows = t("customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.lit(True)).alias("balance_known"),
        F.array("c_name", "c_mktsegment").alias("names"),
        F.struct(F.col("c_nationkey").alias("nation")).alias("place"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
    )
    return _flat(rows.select("id", ST.flatten_metadata(rows.dtypes[1:]).alias("metadata")))


# ---- assets and edges ---------------------------------------------------------

RELATIONS["incoming_assets"] = """
select 'supplier.s'||s_suppkey as asset_id, 'etl' as asset_type, s_name as name, 'rated feed' as description, 'buying' as owner, '{{}}' as metadata from {supplier}
union all select 'nation.n'||n_nationkey, 'table', n_name, 'nation', 'geo', '{{}}' from {nation}
union all select 'ord.o'||o_orderkey, 'report', 'big order', 'large order', o_orderpriority, '{{}}' from {orders} where o_totalprice > 450000
union all select '', 'table', r_name, 'no id', 'geo', '{{}}' from {region}
"""


@query(
    "register_assets",
    """
with n as (select * from {incoming_assets} where asset_id <> '')
select n.asset_id, n.asset_type, n.name, n.description, n.owner, coalesce(a.impact_score, 0.0) as impact_score from n left join {assets} a using (asset_id)
union all select asset_id, asset_type, name, description, owner, impact_score from {assets} where asset_id not in (select asset_id from n)
""",
)
def register_assets(t: Inputs) -> DataFrame:
    return ST.register_assets(t("assets"), t("incoming_assets")).drop("metadata")


RELATIONS["incoming_edges"] = """
select 'customer.c'||o_custkey as source_asset_id, 'ord.o'||o_orderkey as target_asset_id, 'foreign_key' as relationship_type from {orders}
union all select 'customer.c'||o_custkey, 'ord.o'||o_orderkey, 'feeds' from {orders}
union all select 'customer.c'||o_custkey, 'segment.'||o_orderpriority, 'feeds' from {orders}
union all select '', 'ord.o'||o_orderkey, 'feeds' from {orders}
union all select 'region.r'||r_regionkey, null, 'feeds' from {region}
"""


@query(
    "add_edges",
    """
select * from {edges} union
select * from {incoming_edges} where coalesce(source_asset_id, '') <> '' and coalesce(target_asset_id, '') <> ''
""",
)
def add_edges(t: Inputs) -> DataFrame:
    return ST.add_edges(t("edges"), t("incoming_edges"), dealt(t("lineitem")))


@query(
    "update_impact_scores",
    """
select a.asset_id, case when o.o_totalprice > 250000 then 0.5 when o.o_orderkey is not null then 0.25 else a.impact_score end::double as impact_score
from {assets} a left join {orders} o on a.asset_id = 'ord.o'||o.o_orderkey
""",
)
def update_impact_scores(t: Inputs) -> DataFrame:
    scores = t("orders").select(
        F.concat(F.lit("ord.o"), F.col("o_orderkey").cast("string")).alias("asset_id"),
        F.when(F.col("o_totalprice") > 250000, 0.5).otherwise(0.25).alias("impact_score"),
    )
    return ST.update_impact_scores(t("assets"), scores).select("asset_id", "impact_score")


# ---- snapshots ----------------------------------------------------------------


@query(
    "load_metadata_snapshot",
    "select asset_id, asset_type, owner, coalesce(metadata, '{{}}') as metadata, impact_score from {assets}",
)
def load_metadata_snapshot(t: Inputs) -> DataFrame:
    assets, _ = SN.load_metadata(t("assets"), t("edges"))
    return assets.select("asset_id", "asset_type", "owner", "metadata", "impact_score")


@query("save_snapshot", "select asset_id, asset_type, name, description, owner, metadata, impact_score from {assets}")
def save_snapshot(t: Inputs) -> DataFrame:
    store = new_folder(t.spark, "store")
    SN.save_snapshot(t("assets"), store, "assets")
    return SN.load_snapshot(t.spark, store, "assets", ASSETS)


@query(
    "load_vector_collection",
    "select 'v'||vec_id as id, 'vector '||vec_id as text, 'label='||label as metadata, 64 as dimensions from {embeddings}",
)
def load_vector_collection(t: Inputs) -> DataFrame:
    name = F.col("vec_id").cast("string")
    vectors = t("embeddings").select(
        F.concat(F.lit("v"), name).alias("id"),
        F.concat(F.lit("vector "), name).alias("text"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
    store = new_folder(t.spark, "store")
    SN.save_snapshot(vectors, store, "vectors")
    loaded = SN.load_vector_collection(t.spark, store)
    return _flat(loaded).select("id", "text", "metadata", F.size("embedding").alias("dimensions"))


@query(
    "hit_projection",
    """
select doc_id as hit, case when lang = 'en' then 'doc-'||doc_id else text end as data_asset, text as description, quality_score as relevance_score,
 case when lang = 'en' then 'lang=en' else '' end as metadata, '' as sql_context, '' as impact_info
from (select *, 1.0::double / (1 + n_chars) as quality_score from {documents})
""",
)
def hit_projection(t: Inputs) -> DataFrame:
    english = F.col("lang") == "en"
    hits = t("documents").select(
        F.col("doc_id").alias("hit"),
        F.when(english, F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).otherwise("").alias("id"),
        "text",
        (F.lit(1.0) / (F.lit(1) + F.col("n_chars"))).alias("score"),
        F.when(english, F.create_map(F.lit("lang"), "lang")).alias("metadata"),
    )
    shown = _flat(C.hit_projection(hits))
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("sql_context", "impact_info")]
    return shown.select("hit", "data_asset", "description", "relevance_score", "metadata", *empty)
