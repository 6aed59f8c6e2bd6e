"""Lineage graph: neighbours, degrees, impact scores, usage, change impact, comparison.

The graph is two relations: ``edges`` (source_asset_id, target_asset_id,
relationship_type) and ``assets`` (one row per asset_id). An edge endpoint need
not be registered; such a neighbour is *missing*: no type, no owner, but counted.

Neighbourhoods are never collected into one row. A hub may own a large share of
all edges, so lists are relations with one row per neighbour, and every figure
per asset is a count that Spark pre-aggregates before it shuffles. Joins always
keep the many-rows side on the left of a left join (or use an inner join), the
form adaptive execution can split when a hub makes one partition too large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.changes import resolve_change_targets
from stemma.functions.scores import degree_score, risk_level
from stemma.functions.text import strip

UPSTREAM, DOWNSTREAM = "upstream", "downstream"
ASSET_ATTRIBUTES = ("asset_type", "name", "description", "owner", "impact_score")
# Bucket order of grouped views.
BUCKETS = ("table", "sql", "etl", "report", "other")
NO_TARGET = (
    "Provide an asset id or include a table in the change text (e.g. on public.customers)."
)


# ---- neighbours ---------------------------------------------------------------


def edge_ends(edges: DataFrame) -> DataFrame:
    """Two rows per edge, one from each end: (asset_id, side, neighbour_id, relationship_type)."""
    ends = F.array(
        F.struct(
            F.col("target_asset_id").alias("asset_id"),
            F.lit(UPSTREAM).alias("side"),
            F.col("source_asset_id").alias("neighbour_id"),
        ),
        F.struct(
            F.col("source_asset_id").alias("asset_id"),
            F.lit(DOWNSTREAM).alias("side"),
            F.col("target_asset_id").alias("neighbour_id"),
        ),
    )
    return edges.select(F.inline(ends), "relationship_type")


def one_side(edges: DataFrame, side: str) -> DataFrame:
    here, there = (
        ("target_asset_id", "source_asset_id")
        if side == UPSTREAM
        else ("source_asset_id", "target_asset_id")
    )
    return edges.select(
        F.col(here).alias("asset_id"),
        F.lit(side).alias("side"),
        F.col(there).alias("neighbour_id"),
        "relationship_type",
    )


def describe_neighbours(ends: DataFrame, assets: DataFrame) -> DataFrame:
    """Attach asset attributes to ``neighbour_id``.

    A registered neighbour shows its attributes and hides the relationship type;
    an unregistered one shows only its id and the relationship type.
    """
    known = assets.select(
        F.col("asset_id").alias("neighbour_id"), *ASSET_ATTRIBUTES, F.lit(True).alias("_known")
    )
    return (
        ends.join(known, "neighbour_id", "left")
        .withColumn("missing", F.col("_known").isNull())
        .withColumn("relationship_type", F.when(F.col("missing"), F.col("relationship_type")))
        .drop("_known")
    )


def upstream_assets(edges: DataFrame, assets: DataFrame) -> DataFrame:
    return describe_neighbours(one_side(edges, UPSTREAM), assets)


def downstream_assets(edges: DataFrame, assets: DataFrame) -> DataFrame:
    return describe_neighbours(one_side(edges, DOWNSTREAM), assets)


def around(ids: Sequence[str], edges: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of the graph that questions about a few given ids need.

    The ids go into the filter of the edge scan, and the assets are cut to those
    the remaining edges mention, so the joins that follow move only that part.
    """
    source, target = F.col("source_asset_id"), F.col("target_asset_id")
    near = edges.where(source.isin(*ids) | target.isin(*ids))
    mentioned = near.select(F.explode(F.array(source, target)).alias("asset_id")).distinct()
    known = assets.join(mentioned, "asset_id", "left_semi")
    alone = assets.where(F.col("asset_id").isin(*ids)).join(mentioned, "asset_id", "left_anti")
    return near, known.unionByName(alone)


def lineage_requests(requests: DataFrame) -> DataFrame:
    """Trimmed asset_id and a valid direction per request."""
    wanted = F.lower(strip(F.coalesce("direction", F.lit("both"))))
    return requests.select(
        strip(F.coalesce("asset_id", F.lit(""))).alias("asset_id"),
        F.when(wanted.isin(UPSTREAM, DOWNSTREAM), wanted).otherwise("both").alias("direction"),
    )


def asset_lineage(requests: DataFrame, edges: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per request and neighbour on the wanted sides.

    A request without neighbours (or with an empty id) keeps one row with a null side.
    ``asset_known`` tells whether the requested asset itself is registered.
    """
    registered = assets.select("asset_id", F.lit(True).alias("_registered"))
    wanted = (
        lineage_requests(requests)
        .distinct()
        .join(registered, "asset_id", "left")
        .select("asset_id", "direction", F.col("_registered").isNotNull().alias("asset_known"))
    )
    return _neighbours_of(wanted, edges, assets)


def _neighbours_of(wanted: DataFrame, edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Neighbours of distinct (asset_id, direction, ...) on the wanted sides, or one row with a null side."""
    # One row per wanted side: the edges then join on (asset_id, side), for which both
    # inputs are shuffled anew, the form in which adaptive execution splits a hub.
    sides = F.when(
        F.col("direction") == "both", F.array(F.lit(UPSTREAM), F.lit(DOWNSTREAM))
    ).otherwise(F.array("direction"))
    asked = wanted.withColumn("side", F.explode(sides))
    found = edge_ends(edges).join(asked, ["asset_id", "side"], "inner")

    # Each end once: copies are dropped before the shuffle, so that the edges are not joined a second time. Spark moves a
    # small set of asked sides below the distinct.
    sides_there = edge_ends(edges).select("asset_id", "side").distinct().join(asked, ["asset_id", "side"], "left_semi")
    answered = asked.join(sides_there, ["asset_id", "side"]).select("asset_id", "direction").distinct()
    alone = wanted.join(answered, ["asset_id", "direction"], "left_anti")
    return describe_neighbours(found, assets).unionByName(alone, allowMissingColumns=True)


def asset_details(ids: DataFrame, edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Both sides of registered assets only; an unregistered id gives no rows."""
    registered = ids.select("asset_id").join(assets, "asset_id", "left_semi")
    wanted = lineage_requests(registered.withColumn("direction", F.lit("both"))).distinct()
    return _neighbours_of(wanted, edges, assets).drop("direction")


def search_by_table(ids: DataFrame, edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Both sides of any id; ``related_queries`` is part of the shape and always empty."""
    return asset_lineage(
        ids.select("asset_id", F.lit("both").alias("direction")), edges, assets
    ).withColumn("related_queries", F.array().cast("array<string>")).drop("direction")


# ---- degrees and scores -------------------------------------------------------


def _sum_when(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def degree_counts(edges: DataFrame) -> DataFrame:
    """Edges per id and side. A self-loop counts on both sides, a missing neighbour counts."""
    return (
        edge_ends(edges)
        .groupBy("asset_id")
        .agg(
            _sum_when(F.col("side") == UPSTREAM).alias("upstream_count"),
            _sum_when(F.col("side") == DOWNSTREAM).alias("downstream_count"),
        )
    )


def _degrees(edges: DataFrame) -> DataFrame:
    return degree_counts(edges).select(
        "asset_id", (F.col("upstream_count") + F.col("downstream_count")).alias("degree")
    )


def impact_scores(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Score of every registered asset from its degree, next to the stored score."""
    return (
        assets.select(
            "asset_id", "asset_type", F.coalesce("impact_score", F.lit(0.0)).alias("stored_score")
        )
        .join(_degrees(edges), "asset_id", "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
        .withColumn("calculated_score", degree_score(F.col("degree")))
    )


def resolve_impact_scores(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Higher of calculated and stored score; ``changed`` marks those to persist."""
    return (
        impact_scores(edges, assets)
        .withColumn("score", F.greatest("calculated_score", "stored_score"))
        .withColumn("changed", F.col("score") > F.col("stored_score"))
    )


def recompute_impact_scores(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """The asset relation with every stored score replaced by the calculated one."""
    return (
        assets.join(_degrees(edges), "asset_id", "left")
        .withColumn("impact_score", degree_score(F.col("degree")))
        .drop("degree")
    )


def risk_report(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Score and risk class of every registered asset."""
    return resolve_impact_scores(edges, assets).withColumn("risk_level", risk_level(F.col("score")))


# ---- usage and change impact --------------------------------------------------


def usage_counts(edges: DataFrame, assets: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Per id with any edge: neighbour counts by side and type of the downstream neighbour.

    One pass over the edges; each edge counts at its source (with the type of its
    target) and at its target, and the counts are combined before the shuffle. With ``wanted`` only the ends at its ids
    take part, before any type is looked up. It may list an id more than once: then it has a second column, so that the join
    reads two plain shuffles, which adaptive execution can split.
    """
    if wanted is not None:
        ends = edge_ends(edges).join(wanted, "asset_id", "left_semi")
        kinds = assets.select(F.col("asset_id").alias("neighbour_id"), F.col("asset_type").alias("kind"))
        down = ends.where(F.col("side") == DOWNSTREAM).join(kinds, "neighbour_id", "left").select("asset_id", "side", "kind")
        up = ends.where(F.col("side") == UPSTREAM).select("asset_id", "side", F.lit(None).cast("string").alias("kind"))
        return _usage_sums(down.unionByName(up))
    types = assets.select(F.col("asset_id").alias("target_asset_id"), "asset_type")
    typed = edges.select("source_asset_id", "target_asset_id").join(types, "target_asset_id", "left")
    marks = F.array(
        F.struct(
            F.col("source_asset_id").alias("asset_id"),
            F.lit(DOWNSTREAM).alias("side"),
            F.col("asset_type").alias("kind"),
        ),
        F.struct(
            F.col("target_asset_id").alias("asset_id"),
            F.lit(UPSTREAM).alias("side"),
            F.lit(None).cast("string").alias("kind"),
        ),
    )
    return _usage_sums(typed.select(F.inline(marks)))


def _usage_sums(marks: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return (
        marks.groupBy("asset_id")
        .agg(
            _sum_when(F.col("side") == UPSTREAM).alias("upstream_count"),
            _sum_when(F.col("side") == DOWNSTREAM).alias("downstream_count"),
            _sum_when(kind == "sql").alias("query_count"),
            _sum_when(kind.isin("report", "etl")).alias("report_count"),
            _sum_when(kind == "etl").alias("etl_count"),
            _sum_when(kind == "table").alias("table_count"),
        )
    )


USAGE_COUNTS = (
    "upstream_count", "downstream_count", "query_count", "report_count", "etl_count", "table_count",
)


def data_usage(ids: DataFrame, edges: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per id: counts of each usage list and the resolved impact score."""
    stored = assets.select(
        "asset_id",
        "asset_type",
        F.coalesce("impact_score", F.lit(0.0)).alias("stored_score"),
        F.lit(True).alias("_known"),
    )
    out = ids.select("asset_id").join(usage_counts(edges, assets), "asset_id", "left")
    out = out.join(stored, "asset_id", "left")
    degree = F.coalesce(F.col("upstream_count") + F.col("downstream_count"), F.lit(0))
    score = F.greatest(degree_score(degree), F.coalesce("stored_score", F.lit(0.0)))
    return out.select(
        "asset_id",
        F.col("_known").isNotNull().alias("asset_known"),
        "asset_type",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in USAGE_COUNTS],
        score.alias("impact_score"),
    )


def usage_items(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """The usage lists themselves, one row per list entry.

    Lists: upstream, downstream, queries, reports (report and etl), etl_jobs,
    downstream_tables. A neighbour appears in every list it belongs to.
    """
    rows = describe_neighbours(edge_ends(edges), assets)
    down, kind = F.col("side") == DOWNSTREAM, F.col("asset_type")
    lists = F.array_compact(
        F.array(
            F.col("side"),
            F.when(down & (kind == "sql"), F.lit("queries")),
            F.when(down & kind.isin("report", "etl"), F.lit("reports")),
            F.when(down & (kind == "etl"), F.lit("etl_jobs")),
            F.when(down & (kind == "table"), F.lit("downstream_tables")),
        )
    )
    return rows.withColumn("list_name", F.explode(lists)).drop("side")


def grouped_usage(edges: DataFrame, assets: DataFrame, changes_only: bool = False) -> DataFrame:
    """Downstream neighbours of each asset, each once, in display buckets.

    With ``changes_only`` only the lists of a change report feed the view
    (queries, jobs and reports); otherwise every downstream neighbour does.
    """
    kind = F.col("asset_type")
    rows = downstream_assets(edges, assets).where(strip(F.col("neighbour_id")) != "")
    if changes_only:
        rows = rows.where(kind.isin("sql", "etl", "report"))
    bucket = F.when(kind.isin(*BUCKETS), kind).otherwise(F.lit("other"))
    return (
        rows.select("asset_id", strip(F.col("neighbour_id")).alias("neighbour_id"), bucket.alias("bucket"))
        .dropDuplicates(["asset_id", "neighbour_id"])
        .withColumn(
            "bucket_order",
            F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), F.col("bucket")).cast("int"),
        )
    )


def change_impact(requests: DataFrame, edges: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per change request: target, affected counts, score, risk, warning or error.

    The affected assets themselves are ``affected_assets``, keyed by target, so a
    hub that many requests name is listed once and not once per request.
    """
    asked = resolve_change_targets(requests).select(
        "request_id",
        F.coalesce("field_asset", F.lit("")).alias("asset_id_field"),
        "change_text",
        "asset_id",
        F.col("source").alias("asset_resolved_from"),
        F.col("warning").alias("resolution_warning"),
    )
    # Everything known per target first (one row per id), so the requests, of which
    # many may name one target, are joined once. Only edges that touch a target are counted.
    targets = asked.where("asset_id <> ''").select("asset_id", "asset_resolved_from").distinct()
    stored = assets.join(targets, "asset_id", "left_semi").select(
        "asset_id", F.coalesce("impact_score", F.lit(0.0)).alias("stored_score")
    )
    known = usage_counts(edges, assets, targets).join(stored, "asset_id", "full_outer")
    none = F.col("asset_id") == ""
    degree = F.coalesce(F.col("upstream_count") + F.col("downstream_count"), F.lit(0))
    scored = (
        asked.join(known, "asset_id", "left")
        .withColumn(
            "impact_score", F.greatest(degree_score(degree), F.coalesce("stored_score", F.lit(0.0)))
        )
    )

    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    return scored.select(
        "request_id",
        "asset_id",
        F.when(~none, F.col("asset_id_field")).alias("asset_id_field"),
        F.when(~none, F.col("asset_resolved_from")).alias("asset_resolved_from"),
        "resolution_warning",
        F.col("change_text").alias("change"),
        count("report_count").alias("affected_reports"),
        count("query_count").alias("affected_queries"),
        count("etl_count").alias("affected_etl"),
        count("downstream_count").alias("downstream_count"),
        "impact_score",
        risk_level(F.col("impact_score")).alias("risk_level"),
        F.when(none, F.lit(NO_TARGET)).alias("error"),
    )


def affected_assets(requests: DataFrame, edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Downstream neighbours of every distinct change target."""
    # Distinct with a second column: the join below then reads two plain shuffles, the
    # form in which adaptive execution splits a hub.
    resolved = resolve_change_targets(requests).where(F.col("asset_id") != "")
    targets = resolved.select("asset_id", "source").distinct()
    ends = one_side(edges, DOWNSTREAM).join(targets, "asset_id", "left_semi")
    return describe_neighbours(ends, assets)


# ---- comparison ---------------------------------------------------------------


#: Partners of an asset, about, that one row lists.
PARTNERS = 64


def pair_partners(pairs: DataFrame) -> DataFrame:
    """(asset_id, partners): per asset of distinct pairs its (who, other) in lists of about ``PARTNERS``; who is its place."""
    members = F.array(
        F.struct(F.lit(1).alias("who"), F.col("asset1").alias("asset_id"), F.col("asset2").alias("other")),
        F.struct(F.lit(2).alias("who"), F.col("asset2").alias("asset_id"), F.col("asset1").alias("other")),
    )
    wanted = pairs.select("asset1", "asset2").distinct().select(F.inline(members))
    lists = wanted.groupBy("asset_id").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("lists"))
    number = F.pmod(F.xxhash64("other", "who"), F.col("lists")).alias("number")
    dealt = wanted.join(lists, "asset_id").select("asset_id", number, F.struct("who", "other").alias("partner"))
    return dealt.groupBy("asset_id", "number").agg(F.collect_list("partner").alias("partners")).drop("number")


def compare_assets(pairs: DataFrame, edges: DataFrame, assets: DataFrame, tasks: int | None = None) -> DataFrame:
    """Shared and one-sided neighbours of each pair (asset1, asset2).

    A registered neighbour is the same item whatever the edge type; an unregistered
    one is the same only with the same relationship type. Shared items keep the
    copies of the first asset, one-sided items the copies of their own side.

    Each end meets the lists of its asset's partners once and travels with a list to its neighbour, where the neighbour is looked
    up and the pairs are counted: equal items have one neighbour, so pairs are listed behind the last shuffle. ``tasks`` deals the
    ends over as many tasks, for many pairs over many edges.
    """
    ends = edge_ends(edges).join(pair_partners(pairs), "asset_id")
    if tasks:
        ends = ends.repartition(tasks, "neighbour_id")
    first = F.col("partner.who") == 1
    asset1, asset2 = (F.when(c, F.col("asset_id")).otherwise(F.col("partner.other")) for c in (first, ~first))
    items = (
        describe_neighbours(ends, assets)
        .select("asset_id", "side", "neighbour_id", "relationship_type", "missing", F.explode("partners").alias("partner"))
        .select(asset1.alias("asset1"), asset2.alias("asset2"), "side", "neighbour_id", "relationship_type", "missing", first.alias("first"))
    )
    tally = items.groupBy("asset1", "asset2", "side", "neighbour_id", "relationship_type", "missing").agg(
        F.sum(F.when(F.col("first"), 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("first"), 0).otherwise(1)).alias("n2")
    )
    n1, n2 = F.col("n1"), F.col("n2")
    list_name = (
        F.when((n1 > 0) & (n2 > 0), F.lit("similarities"))
        .when(n1 > 0, F.concat(F.lit("asset1_only_"), F.col("side")))
        .otherwise(F.concat(F.lit("asset2_only_"), F.col("side")))
    )
    copies = F.when(n1 > 0, n1).otherwise(n2)
    return (
        tally.withColumn("list_name", list_name)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        .drop("n1", "n2", "_copy")
    )
