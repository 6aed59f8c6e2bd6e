"""Lineage of any depth over the derived graph, with chains of orders and with cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators import paths as P
from stemma.plans.registry import Inputs, query
from stemma.plans.star import RELATIONS

# Orders of one customer and priority feed the next one; the last orders of indebted customers feed the customer again.
RELATIONS["order_chain"] = """
select o_orderkey, o_custkey, lead(o_orderkey) over (partition by o_custkey, o_orderpriority order by o_orderkey) as next_order
from {orders}
"""
RELATIONS["deep_edges"] = """
select source_asset_id, target_asset_id, relationship_type from {edges}
union all select 'ord.o'||o_orderkey, 'ord.o'||next_order, 'feeds' from {order_chain} where next_order is not null
union all select 'ord.o'||o_orderkey, 'customer.c'||o_custkey, 'feedback' from {order_chain} join {customer} on c_custkey = o_custkey
 where next_order is null and c_acctbal < 0
"""

# Comparison-only: no shortest path is longer than this many hops.
HOPS = 40
RELATIONS["x_path_steps"] = """
select distinct 'downstream' as side, source_asset_id as node, target_asset_id as next_node from {deep_edges}
union all select distinct 'upstream', target_asset_id, source_asset_id from {deep_edges}
"""


@query(
    "transitive_lineage",
    f"""
with recursive req as (
 select distinct trim(asset_id) as asset_id, case when lower(trim(direction)) in ('upstream', 'downstream') then lower(trim(direction)) else 'both' end as direction
 from {{lineage_requests}} where trim(asset_id) <> ''
), asked as (
 select distinct asset_id, s.side from req, (values ('upstream'), ('downstream')) s(side) where direction in ('both', s.side)
), reach(asset_id, side, node, depth) as (
 select asset_id, side, asset_id, 0 from asked
 union select r.asset_id, r.side, s.next_node, r.depth + 1 from reach r join {{x_path_steps}} s on s.side = r.side and s.node = r.node where r.depth < {HOPS}
)
select asset_id, side, node, min(depth) as depth from reach group by asset_id, side, node having min(depth) > 0
""",
)
def transitive_lineage(t: Inputs) -> DataFrame:
    return P.transitive_lineage(t("lineage_requests"), t("deep_edges"))


# Comparison-only: cycles run through a customer and its orders, so reaching is listed there only.
CYCLES = """
with recursive inner_edges as (
 select distinct source_asset_id as a, target_asset_id as b from {deep_edges}
 where source_asset_id not like 'nation.%' and source_asset_id not like 'supplier.%' and source_asset_id not like 'part.%'
), reach(a, b) as (
 select a, b from inner_edges union select r.a, e.b from reach r join inner_edges e on e.a = r.b
), cycles as (
 select x.a as node, min(x.b) as cycle from reach x join reach y on x.a = y.b and x.b = y.a group by x.a
)"""


@query(
    "lineage_layers",
    CYCLES + """, nodes as (
 select source_asset_id as node from {deep_edges} union select target_asset_id from {deep_edges}
), units as (
 select n.node, coalesce(c.cycle, n.node) as unit, c.cycle from nodes n left join cycles c on c.node = n.node
), links as (
 select distinct p.unit as a, q.unit as b from {deep_edges} e join units p on p.node = e.source_asset_id
 join units q on q.node = e.target_asset_id where p.unit <> q.unit
), depths(unit, depth) as (
 select distinct unit, 0 from units where unit not in (select b from links)
 union select l.b, d.depth + 1 from depths d join links l on l.a = d.unit
)
select u.node as asset_id, d.layer, u.cycle from units u join (select unit, max(depth) as layer from depths group by unit) d on d.unit = u.unit
""",
)
def lineage_layers(t: Inputs) -> DataFrame:
    return P.lineage_layers(t("deep_edges"))


REACHED = """
with recursive links as (
 select distinct source_asset_id as a, target_asset_id as b from {deep_edges}
), reach(a, b) as (
 select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b
), nodes as (
 select a as node from links union select b from links
)
select node as asset_id, count(b) as affected"""


@query("affected_counts", REACHED + " from nodes left join reach on a = node group by node")
def affected_counts(t: Inputs) -> DataFrame:
    return P.affected_counts(t("deep_edges"))


@query("affected_estimates", REACHED + ", true as close from nodes left join reach on a = node group by node")
def affected_estimates(t: Inputs) -> DataFrame:
    """The sketches' estimates beside the exact counts: within eight standard deviations each."""
    edges = t("deep_edges")
    units = P.unit_layers(edges)
    off = 8 * 1.04 / 2 ** (P.LG_REGISTERS / 2)
    close = F.abs(F.col("estimate") - F.col("affected")) <= F.col("affected") * off
    both = P.affected_counts(edges, units=units).join(P.affected_estimates(edges, units=units), "asset_id")
    return both.select("asset_id", "affected", close.alias("close"))
