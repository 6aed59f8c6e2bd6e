"""Lineage, scores, usage, change impact and comparison over the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions import changes
from stemma.functions import scores as S
from stemma.functions.changes import resolve_change_targets
from stemma.functions.text import strip
from stemma.operators import graph as G
from stemma.plans.registry import Inputs, query
from stemma.plans.star import RELATIONS, dealt

RELATIONS["lineage_requests"] = """
select case when event_type = 'error' and value < 20 then '   ' when event_type = 'view' then ' part.p'||user_id||' ' else 'customer.c'||user_id end as asset_id,
 case event_type when 'click' then ' Upstream ' when 'view' then 'DOWNSTREAM' when 'purchase' then 'both' when 'signup' then 'sideways' end as direction
from {events}
"""

RELATIONS["asset_pairs"] = """
select 'part.p'||p_partkey as asset1, 'part.p'||(p_partkey+1) as asset2 from {part}
union all select 'supplier.s'||s_suppkey, 'supplier.s'||(s_suppkey+1) from {supplier}
union all select 'customer.c'||c_custkey, 'customer.c'||(c_custkey+1) from {customer}
"""

# Comparison-only relations: both ends of every edge with the neighbour's attributes.
RELATIONS["x_ends"] = """
select target_asset_id as asset_id, 'upstream' as side, source_asset_id as neighbour_id, relationship_type as rel from {edges}
union all select source_asset_id, 'downstream', target_asset_id, relationship_type from {edges}
"""
RELATIONS["x_neighbours"] = """
select e.asset_id, e.side, e.neighbour_id, a.asset_type, a.name, a.description, a.owner, a.impact_score,
 case when a.asset_id is null then e.rel end as relationship_type, a.asset_id is null as missing
from {x_ends} e left join {assets} a on a.asset_id = e.neighbour_id
"""
RELATIONS["x_degree"] = """
select asset_id, cast(sum(case when side = 'upstream' then 1 else 0 end) as bigint) as upstream_count,
 cast(sum(case when side = 'downstream' then 1 else 0 end) as bigint) as downstream_count
from {x_ends} group by asset_id
"""
RELATIONS["x_usage"] = """
select asset_id,
 cast(sum(case when side = 'upstream' then 1 else 0 end) as bigint) as upstream_count,
 cast(sum(case when side = 'downstream' then 1 else 0 end) as bigint) as downstream_count,
 cast(sum(case when side = 'downstream' and asset_type = 'sql' then 1 else 0 end) as bigint) as query_count,
 cast(sum(case when side = 'downstream' and asset_type in ('report', 'etl') then 1 else 0 end) as bigint) as report_count,
 cast(sum(case when side = 'downstream' and asset_type = 'etl' then 1 else 0 end) as bigint) as etl_count,
 cast(sum(case when side = 'downstream' and asset_type = 'table' then 1 else 0 end) as bigint) as table_count
from {x_neighbours} group by asset_id
"""
RELATIONS["x_scores"] = """
select a.asset_id, a.asset_type, coalesce(a.impact_score, 0.0) as stored_score,
 coalesce(d.upstream_count + d.downstream_count, 0) as degree,
 least(1.0::double, coalesce(d.upstream_count + d.downstream_count, 0) / 10.0::double) as calculated_score
from {assets} a left join {x_degree} d on d.asset_id = a.asset_id
"""

NEIGHBOUR_COLUMNS = (
    "asset_id, side, neighbour_id, asset_type, name, description, owner, impact_score, relationship_type, missing"
)


@query("upstream_assets", f"select {NEIGHBOUR_COLUMNS} from {{x_neighbours}} where side = 'upstream'")
def upstream_assets(t: Inputs) -> DataFrame:
    return G.upstream_assets(t("edges"), t("assets"))


@query("downstream_assets", f"select {NEIGHBOUR_COLUMNS} from {{x_neighbours}} where side = 'downstream'")
def downstream_assets(t: Inputs) -> DataFrame:
    return G.downstream_assets(t("edges"), t("assets"))


ONE_SIDED = "select asset_id as asset, neighbour_id as {0}, asset_type, relationship_type, missing from {{x_neighbours}} where side = '{0}'"


@query("upstream_lineage", ONE_SIDED.format("upstream"))
def upstream_lineage(t: Inputs) -> DataFrame:
    return G.upstream_assets(t("edges"), t("assets")).select(
        F.col("asset_id").alias("asset"), F.col("neighbour_id").alias("upstream"),
        "asset_type", "relationship_type", "missing",
    )


@query("downstream_lineage", ONE_SIDED.format("downstream"))
def downstream_lineage(t: Inputs) -> DataFrame:
    return G.downstream_assets(t("edges"), t("assets")).select(
        F.col("asset_id").alias("asset"), F.col("neighbour_id").alias("downstream"),
        "asset_type", "relationship_type", "missing",
    )


@query(
    "asset_lineage",
    """
with req as (
 select distinct trim(asset_id) as asset_id,
  case when lower(trim(direction)) in ('upstream', 'downstream') then lower(trim(direction)) else 'both' end as direction
 from {lineage_requests})
select r.asset_id, r.direction, n.side, n.neighbour_id, n.asset_type, n.name, n.description, n.owner,
 n.impact_score, n.relationship_type, n.missing, a.asset_id is not null as asset_known
from req r
left join {x_neighbours} n on n.asset_id = r.asset_id and r.direction in ('both', n.side)
left join {assets} a on a.asset_id = r.asset_id
""",
)
def asset_lineage(t: Inputs) -> DataFrame:
    return G.asset_lineage(t("lineage_requests"), t("edges"), t("assets"))


@query(
    "asset_details",
    f"""
select n.* from {{x_neighbours}} n join {{assets}} a on a.asset_id = n.asset_id
union all
select a.asset_id, null, null, null, null, null, null, null, null, null
from {{assets}} a where a.asset_id not in (select asset_id from {{x_degree}})
""",
)
def asset_details(t: Inputs) -> DataFrame:
    return G.asset_details(t("assets"), t("edges"), t("assets")).select(
        *NEIGHBOUR_COLUMNS.split(", ")
    )


@query(
    "search_by_table",
    """
with req as (select distinct asset1 as asset_id from {asset_pairs})
select r.asset_id, n.side, n.neighbour_id, n.asset_type, n.relationship_type, n.missing,
 a.asset_id is not null as asset_known, 0 as related_queries
from req r left join {x_neighbours} n on n.asset_id = r.asset_id
left join {assets} a on a.asset_id = r.asset_id
""",
)
def search_by_table(t: Inputs) -> DataFrame:
    ids = t("asset_pairs").select(F.col("asset1").alias("asset_id"))
    return G.search_by_table(ids, t("edges"), t("assets")).select(
        "asset_id", "side", "neighbour_id", "asset_type", "relationship_type", "missing",
        "asset_known", F.size("related_queries").alias("related_queries"),
    )


# ---- scores -------------------------------------------------------------------


@query("impact_score", "select asset_id, degree, calculated_score as impact_score from {x_scores}")
def impact_score(t: Inputs) -> DataFrame:
    return G.impact_scores(t("edges"), t("assets")).select(
        "asset_id", "degree", F.col("calculated_score").alias("impact_score")
    )


@query(
    "resolve_impact_score",
    """
select asset_id, stored_score, calculated_score, greatest(calculated_score, stored_score) as score,
 greatest(calculated_score, stored_score) > stored_score as changed
from {x_scores}
""",
)
def resolve_impact_score(t: Inputs) -> DataFrame:
    return G.resolve_impact_scores(t("edges"), t("assets")).select(
        "asset_id", "stored_score", "calculated_score", "score", "changed"
    )


@query(
    "recompute_impact_scores",
    """
select a.asset_id, a.asset_type, a.name, a.description, a.owner, s.calculated_score as impact_score
from {assets} a join {x_scores} s on s.asset_id = a.asset_id
""",
)
def recompute_impact_scores(t: Inputs) -> DataFrame:
    return G.recompute_impact_scores(t("edges"), t("assets")).drop("metadata")


RISK = "case when {0} > 0.6 then 'high' when {0} > 0.3 then 'medium' else 'low' end"


@query(
    "risk_level",
    f"""
select asset_id, asset_type, degree, greatest(calculated_score, stored_score) as score,
 {RISK.format('greatest(calculated_score, stored_score)')} as risk_level,
 {RISK.format('calculated_score')} as calculated_risk_level
from {{x_scores}}
""",
)
def risk_level(t: Inputs) -> DataFrame:
    return G.risk_report(t("edges"), t("assets")).select(
        "asset_id", "asset_type", "degree", "score", "risk_level",
        S.risk_level(S.clamp01(F.col("calculated_score"))).alias("calculated_risk_level"),
    )


@query(
    "score_bar",
    """
with filled as (
 select asset_id, calculated_score as score, cast(round_even(calculated_score * 16, 0) as integer) as n from {x_scores})
select asset_id, score, repeat('█', n)||repeat('░', 16 - n) as bar from filled
""",
)
def score_bar(t: Inputs) -> DataFrame:
    score = F.col("calculated_score")
    return G.impact_scores(t("edges"), t("assets")).select(
        "asset_id", score.alias("score"), S.score_bar(score).alias("bar")
    )


@query(
    "asset_label",
    """
select distinct neighbour_id, case when asset_type is null then neighbour_id else neighbour_id||' ('||asset_type||')' end as label
from {x_neighbours}
""",
)
def asset_label(t: Inputs) -> DataFrame:
    rows = G.describe_neighbours(G.edge_ends(t("edges")), t("assets"))
    return rows.select(
        "neighbour_id", S.asset_label(F.col("neighbour_id"), F.col("name"), F.col("asset_type")).alias("label")
    ).distinct()


# ---- usage and change ---------------------------------------------------------


@query(
    "data_usage",
    """
select a.asset_id, true as asset_known, a.asset_type,
 coalesce(u.upstream_count, 0) as upstream_count, coalesce(u.downstream_count, 0) as downstream_count,
 coalesce(u.query_count, 0) as query_count, coalesce(u.report_count, 0) as report_count,
 coalesce(u.etl_count, 0) as etl_count, coalesce(u.table_count, 0) as table_count,
 greatest(s.calculated_score, s.stored_score) as impact_score
from {assets} a join {x_scores} s on s.asset_id = a.asset_id left join {x_usage} u on u.asset_id = a.asset_id
""",
)
def data_usage(t: Inputs) -> DataFrame:
    return G.data_usage(t("assets"), t("edges"), t("assets"))


@query(
    "data_usage_items",
    """
select asset_id, side as list_name, neighbour_id, asset_type, relationship_type, missing from {x_neighbours}
union all select asset_id, 'queries', neighbour_id, asset_type, relationship_type, missing from {x_neighbours} where side = 'downstream' and asset_type = 'sql'
union all select asset_id, 'reports', neighbour_id, asset_type, relationship_type, missing from {x_neighbours} where side = 'downstream' and asset_type in ('report', 'etl')
union all select asset_id, 'etl_jobs', neighbour_id, asset_type, relationship_type, missing from {x_neighbours} where side = 'downstream' and asset_type = 'etl'
union all select asset_id, 'downstream_tables', neighbour_id, asset_type, relationship_type, missing from {x_neighbours} where side = 'downstream' and asset_type = 'table'
""",
)
def data_usage_items(t: Inputs) -> DataFrame:
    return G.usage_items(t("edges"), t("assets")).select(
        "asset_id", "list_name", "neighbour_id", "asset_type", "relationship_type", "missing"
    )


@query(
    "group_by_type_dedup",
    """
with rows_ as (
 select distinct asset_id, neighbour_id, case when asset_type in ('table', 'sql', 'etl', 'report') then asset_type else 'other' end as bucket
 from {x_neighbours} where side = 'downstream')
select asset_id, neighbour_id, bucket,
 case bucket when 'table' then 1 when 'sql' then 2 when 'etl' then 3 when 'report' then 4 else 5 end as bucket_order
from rows_
""",
)
def group_by_type_dedup(t: Inputs) -> DataFrame:
    return G.grouped_usage(t("edges"), t("assets"))


# Comparison-only: the change target by the same three patterns.
RELATIONS["x_targets"] = """
with named as (
 select request_id, field_asset, change_text, trim(field_asset) as typed,
  lower(coalesce(
   nullif(regexp_extract(change_text, '(?i)\\bon\\s+((?:[a-z][a-z0-9_]+\\.)?[a-z][a-z0-9_]+)\\b', 1), ''),
   nullif(regexp_extract(change_text, '(?i)\\bto\\s+([a-z][a-z0-9_]+\\.[a-z][a-z0-9_]+)\\b', 1), ''),
   regexp_extract_all(change_text, '(?i)\\b([a-z][a-z0-9_]*\\.[a-z][a-z0-9_]+)\\b', 1)[-1])) as raw
 from {change_requests})
select request_id, field_asset, change_text, typed,
 case when contains(raw, '.') then raw else 'public.'||raw end as inferred
from named
"""


@query("extract_change_target", "select request_id, change_text, inferred as target from {x_targets}")
def extract_change_target(t: Inputs) -> DataFrame:
    target = changes.extract_change_target(F.col("change_text"))
    return t.spread("change_requests", "request_id").select("request_id", "change_text", target.alias("target"))


WARNING = (
    "case when inferred is not null and typed <> '' and lower(typed) <> inferred then "
    "'Asset id field was `'||typed||'` but the proposed change targets `'||inferred||'` — analysis uses **'||inferred||'**.' end"
)


@query(
    "resolve_change_target",
    f"""
select request_id, coalesce(inferred, typed) as asset_id, nullif(typed, '') as field_asset, inferred as inferred_asset,
 case when inferred is not null then 'change_text' else 'field' end as source, {WARNING} as warning
from {{x_targets}}
""",
)
def resolve_change_target(t: Inputs) -> DataFrame:
    resolved = resolve_change_targets(t.spread("change_requests", "request_id"))
    return resolved.select(
        "request_id", "asset_id", F.nullif(strip(F.col("field_asset")), F.lit("")).alias("field_asset"),
        "inferred_asset", "source", "warning",
    )


@query(
    "change_impact",
    f"""
with r as (
 select request_id, field_asset, change_text, coalesce(inferred, typed) as asset_id,
  case when inferred is not null then 'change_text' else 'field' end as source, {WARNING} as warning
 from {{x_targets}}),
s as (
 select r.*, coalesce(u.report_count, 0) as reports, coalesce(u.query_count, 0) as queries, coalesce(u.etl_count, 0) as jobs,
  coalesce(u.downstream_count, 0) as downstream,
  greatest(least(1.0::double, coalesce(u.upstream_count + u.downstream_count, 0) / 10.0::double), coalesce(a.impact_score, 0.0)) as score
 from r left join {{x_usage}} u on u.asset_id = r.asset_id left join {{assets}} a on a.asset_id = r.asset_id)
select request_id, asset_id, case when asset_id <> '' then field_asset end as asset_id_field,
 case when asset_id <> '' then source end as asset_resolved_from, warning as resolution_warning, change_text as change,
 reports as affected_reports, queries as affected_queries, jobs as affected_etl, downstream as downstream_count,
 score as impact_score, {RISK.format('score')} as risk_level,
 case when asset_id = '' then 'Provide an asset id or include a table in the change text (e.g. on public.customers).' end as error
from s
""",
)
def change_impact(t: Inputs) -> DataFrame:
    return G.change_impact(t.spread("change_requests", "request_id"), t("edges"), t("assets"))


@query(
    "change_impact_items",
    """
with targets as (select distinct coalesce(inferred, typed) as asset_id from {x_targets} where coalesce(inferred, typed) <> '')
select n.asset_id, n.neighbour_id, n.asset_type, n.relationship_type, n.missing
from {x_neighbours} n join targets using (asset_id) where n.side = 'downstream'
""",
)
def change_impact_items(t: Inputs) -> DataFrame:
    return G.affected_assets(t.spread("change_requests", "request_id"), t("edges"), t("assets")).select(
        "asset_id", "neighbour_id", "asset_type", "relationship_type", "missing"
    )


@query(
    "compare_data_assets",
    """
with items as (
 select asset_id, side, neighbour_id, relationship_type, missing, neighbour_id||coalesce('|'||relationship_type, '') as item from {x_neighbours}),
pairs as (select distinct asset1, asset2 from {asset_pairs}),
one as (
 select p.asset1, p.asset2, i.side, i.neighbour_id, i.relationship_type, i.missing,
  exists (select 1 from items j where j.asset_id = p.asset2 and j.side = i.side and j.item = i.item) as shared
 from pairs p join items i on i.asset_id = p.asset1),
two as (
 select p.asset1, p.asset2, i.side, i.neighbour_id, i.relationship_type, i.missing,
  exists (select 1 from items j where j.asset_id = p.asset1 and j.side = i.side and j.item = i.item) as shared
 from pairs p join items i on i.asset_id = p.asset2)
select asset1, asset2, side, neighbour_id, relationship_type, missing,
 case when shared then 'similarities' else 'asset1_only_'||side end as list_name from one
union all
select asset1, asset2, side, neighbour_id, relationship_type, missing, 'asset2_only_'||side from two where not shared
""",
)
def compare_data_assets(t: Inputs) -> DataFrame:
    # A line item gives two edges at most, an edge two ends, and an end takes part in two pairs.
    return G.compare_assets(t("asset_pairs"), t("edges"), t("assets"), 8 * dealt(t("lineitem")))
