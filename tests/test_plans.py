"""Physical plans: pruning, pushdown, partial aggregation, no nested loops, split hubs."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from stemma.operators import graph
from stemma.plans import star
from stemma.schemas import ASSETS

DATA = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def scans(df, marker):
    return [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", formatted(df)) if marker in s]


@pytest.mark.parametrize("name", ["risk_level", "data_usage", "compare_data_assets", "vector_search", "change_impact",
                                  "asset_lineage", "display_limits", "build_documents", "register_assets", "upsert_documents"])
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_reach_the_scan(spark):
    for name in ("q_customers_recent_orders", "q_customers_with_orders"):
        assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate", formatted(QUERIES[name](spark, DATA)))


def test_only_needed_columns_are_read(spark):
    for schema in scans(QUERIES["risk_level"](spark, DATA), "l_"):
        assert set(c.split(":")[0] for c in schema.split(",")) <= {"l_orderkey", "l_partkey", "l_suppkey"}
    (schema,) = scans(QUERIES["q_product_sales"](spark, DATA), "l_")
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["l_partkey", "l_quantity"]


def test_ranks_are_cut_before_the_shuffle(spark):
    for name in ("display_limits", "vector_search"):
        text = plan(QUERIES[name](spark, DATA))
        assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_facts_are_summed_before_the_join(spark):
    text = plan(QUERIES["q_product_revenue_by_category"](spark, DATA))
    assert text.index("partial_sum") < len(text) and text.rindex("partial_sum") > text.index("Join")


@pytest.fixture
def hub_settings(spark):
    wanted = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_hub_with_a_third_of_all_edges_is_split(spark, hub_settings):
    n = 60_000
    edges = spark.range(0, n, 1, 16).select(
        F.concat(F.lit("a"), F.col("id")).alias("source_asset_id"),
        F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("target_asset_id"),
        F.lit("fk").alias("relationship_type"),
    )
    assets = spark.range(0, n, 1, 16).select(
        F.when(F.col("id") == 0, "hub").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("asset_id"),
        *[F.lit("table").alias(c) for c in ("asset_type", "name", "description", "owner", "metadata")],
        F.lit(0.0).alias("impact_score"),
    ).select(*ASSETS.fieldNames())
    down = graph.downstream_assets(edges, assets)
    down.collect()
    assert "skew=true" in plan(down)
    assert down.where("not missing and neighbour_id = 'hub'").count() == n // 3
    usage = graph.usage_counts(edges, assets)
    assert usage.where("asset_id = 'hub'").first()["upstream_count"] == n // 3


@pytest.mark.parametrize("question", ["lineage", "affected", "change"])
def test_a_hub_that_many_requests_name_is_split(spark, hub_settings, question):
    n = 60_000
    hub = F.when(F.col("id") % 3 == 0, "s.hub").otherwise(F.concat(F.lit("s.t"), F.col("id")))
    ids = spark.range(0, n, 1, 16)
    edges = ids.select(
        hub.alias("source_asset_id"), F.concat(F.lit("a"), F.col("id")).alias("target_asset_id"),
        F.lit("fk").alias("relationship_type"),
    )
    assets = ids.select(
        F.when(F.col("id") == 0, "s.hub").otherwise(F.concat(F.lit("s.t"), F.col("id"))).alias("asset_id"),
        *[F.lit("table").alias(c) for c in ("asset_type", "name", "description", "owner", "metadata")],
        F.lit(0.0).alias("impact_score"),
    ).select(*ASSETS.fieldNames())
    requests = ids.select(
        F.col("id").alias("request_id"), F.lit("f").alias("field_asset"),
        F.concat(F.lit("drop x on "), hub).alias("change_text"),
    )
    asked = ids.select(hub.alias("asset_id"), F.when(F.col("id") % 2 == 0, "both").otherwise("upstream").alias("direction"))
    df = {
        "lineage": lambda: graph.asset_lineage(asked, edges, assets),
        "affected": lambda: graph.affected_assets(requests, edges, assets),
        "change": lambda: graph.change_impact(requests, edges, assets),
    }[question]()
    found = df.collect()
    assert "skew=true" in plan(df)
    of_hub = [r for r in found if r.asset_id == "s.hub"]
    # lineage: one row per neighbour for 'both', one empty row for 'upstream'
    assert len(of_hub) == {"lineage": n // 3 + 1, "affected": n // 3, "change": n // 3}[question]


def test_a_single_question_filters_the_edge_scan(spark, tmp_path):
    from stemma.catalog import Catalog
    from stemma.sources import snapshots

    edges = spark.range(1000).selectExpr("'a' || id as source_asset_id", "'b' || id as target_asset_id", "'fk' as relationship_type")
    assets = spark.range(1000).selectExpr("'b' || id as asset_id", "'table' as asset_type", "'n' as name", "'' as description",
                                          "'o' as owner", "'{}' as metadata", "0.0D as impact_score")
    snapshots.save_snapshot(edges, str(tmp_path), "edges")
    snapshots.save_snapshot(assets, str(tmp_path), "assets")
    lineage = Catalog(spark, str(tmp_path)).get_lineage("b7")
    assert "PushedFilters: [Or(EqualTo(source_asset_id,b7),EqualTo(target_asset_id,b7))]" in formatted(lineage)
    assert [(r.neighbour_id, r.missing, r.asset_known) for r in lineage.collect()] == [("a7", True, True)]
    usage = Catalog(spark, str(tmp_path)).analyze_data_usage("a7").first()
    assert (usage.downstream_count, usage.table_count, usage.asset_known) == (1, 1, False)


def test_edges_are_dealt_by_their_number(spark, monkeypatch, rows):
    """The pairs of line items go to more tasks as they get more, and are the rows of the SQL."""
    monkeypatch.setattr(star, "PAIR_ROWS", 200)
    parts = {n: star.relation(spark, DATA, n) for n in ("lineitem", "orders", "customer")}
    n = -(-parts["lineitem"].count() // 200)
    edges = star.relation(spark, DATA, "edges")
    assert n > 8 and edges._jdf.queryExecution().optimizedPlan().toString().count(f", {n}") == 2
    assert rows(edges) == rows(spark.sql(star.RELATIONS["edges"], **parts))
    assert edges.dtypes == spark.sql(star.RELATIONS["edges"], **parts).dtypes


def test_added_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(star, "PAIR_ROWS", 200)
    added = QUERIES["add_edges"](spark, DATA)
    n = -(-star.relation(spark, DATA, "lineitem").count() // 200)
    names = r"source_asset_id#\d+, target_asset_id#\d+, relationship_type#\d+"
    assert n > 8 and len(re.findall(rf"hashpartitioning\({names}, {n}\)", plan(added))) == 1
    assert len(re.findall(rf"hashpartitioning\({names}", plan(added))) == 1
