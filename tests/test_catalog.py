"""The stored catalog from refresh to every tool."""

import pytest

from stemma.catalog import Catalog
from stemma.operators import documents
from stemma.operators import store as ST
from stemma.operators.refresh import document_vectors
from stemma.schemas import ASSETS, DOCUMENTS
from stemma.session import materialize
from stemma.sources import snapshots as SN


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    files = spark.createDataFrame(
        [
            ("r/orders.sql", "select c.name, count(o.id) from customers c left join orders o on o.c = c.id group by c.name"),
            ("r/stock.sql", "select sku from wh.items"),
        ],
        "source string, sql string",
    )
    jobs = spark.createDataFrame(
        [("j/load.json", "j/load.json", "load", "", "team", "", ["public.customers"], ["public.orders"], [], [], [])],
        "source string, path string, name string, description string, owner string, schedule string, sources array<string>,"
        "targets array<string>, transformations array<string>, dependencies array<string>, dependency_ids array<string>",
    )
    c = Catalog(spark, str(tmp_path_factory.mktemp("store") / "s"))
    c.refresh(documents.build_documents(documents.sql_documents(files), documents.etl_documents(jobs))).collect()
    return c


ORDERS, LOAD = "sql:r/orders.sql", "etl:j/load.json#load"


def test_lineage_and_usage(catalog, rows):
    assert rows(catalog.get_lineage(ORDERS, "upstream"), "neighbour_id", "missing") == [
        ("public.customers", True), ("public.orders", True),
    ]
    assert rows(catalog.analyze_data_usage("public.customers"), "downstream_count", "query_count", "report_count", "impact_score") == [
        (2, 1, 1, 0.2)
    ]
    assert rows(catalog.usage_items("public.customers"), "list_name", "neighbour_id") == [
        ("downstream", LOAD), ("downstream", ORDERS), ("etl_jobs", LOAD), ("queries", ORDERS), ("reports", LOAD),
    ]
    assert rows(catalog.get_asset_details(LOAD), "side", "neighbour_id") == [
        ("downstream", "public.orders"), ("upstream", "public.customers"),
    ]
    assert rows(catalog.search_by_table("public.orders"), "side", "neighbour_id") == [
        ("downstream", ORDERS), ("upstream", LOAD),
    ]


def test_change_and_comparison(catalog, rows):
    impact = catalog.assess_change_impact("", "drop column x on customers")
    assert rows(impact, "asset_id", "affected_queries", "affected_etl", "risk_level") == [("public.customers", 1, 1, "low")]
    affected = catalog.affected_assets("", "drop column x on customers")
    assert sorted(r.neighbour_id for r in affected.collect()) == [LOAD, ORDERS]
    assert catalog.analyze_data_usage(" public.customers ").first()["downstream_count"] == 2
    compared = catalog.compare_data_assets(ORDERS, LOAD)
    # Unregistered neighbours are the same item only with the same relationship type.
    assert rows(compared, "list_name", "neighbour_id") == [
        ("asset1_only_upstream", "public.customers"), ("asset1_only_upstream", "public.orders"),
        ("asset2_only_downstream", "public.orders"), ("asset2_only_upstream", "public.customers"),
    ]


def test_search_and_prompts(catalog):
    hit = catalog.search_data_assets("stock wh.items sku", 1).first()
    assert hit["data_asset"] == "sql:r/stock.sql" and hit["asset_type"] == "sql"
    assert catalog.search_similar_queries("orders").count() == 3
    messages = catalog.generate_query("orders per customer").first()["messages"]
    assert "--- Catalog asset 1: " in messages[1].content and messages[1].content.endswith("User request: orders per customer")


def test_sql_tools(spark, catalog):
    bad = catalog.validate_query("drop table x").first()
    assert (bad["valid"], bad["errors"], bad["warnings"]) == (False, ["Contains dangerous keyword: drop"], [])
    assert catalog.validate_query("select 1").first()["valid"]
    assert catalog.explain_query("insert into a values (1)").first()["explanation"].startswith("Inserts")
    assert len(catalog.suggest_optimizations("select * from a").first()["suggestions"]) == 1
    replies = spark.createDataFrame([("```sql\nselect 1\n```",)], "reply string")
    assert catalog.query_results(replies).first()["query"] == "select 1"
    assert not catalog.validate_query("select * from a.x", allowed=["y"]).first()["valid"]
    assert catalog.validate_query("select * from a.x", allowed=["x"]).first()["valid"]


def test_browsing(catalog, rows):
    assert catalog.get_catalog_summary().first()["total_assets"] == 3
    assert rows(catalog.list_etl_processes(), "asset_id") == [(LOAD,)]
    assert catalog.list_tables().count() == 0 and catalog.list_reports("x").count() == 0
    assert rows(catalog.search_by_owner("TEAM"), "asset_id") == [(LOAD,)]


def test_scores_persist_only_when_asked(catalog, rows):
    before = rows(catalog.assets, "asset_id", "impact_score")
    catalog.analyze_data_usage(LOAD).collect()
    assert rows(catalog.assets, "asset_id", "impact_score") == before
    catalog.persist_scores()
    assert rows(catalog.assets, "asset_id", "impact_score") == before


def test_a_first_refresh_moves_no_whole_documents(spark, tmp_path):
    """Vectors of documents whose ids come once go to a new store without a shuffle; so do assets, but for the join of scores."""
    made = [(f"t{k}", f"text {k}", "table", f"t{k}", "o", "d", "{}", []) for k in range(6)]
    docs = materialize(spark.createDataFrame(made, DOCUMENTS), "test-documents")
    plans = []
    for df in (
        ST.upsert(SN.load_vector_collection(spark, str(tmp_path / "s")), document_vectors(docs), ["id"]),
        ST.register_assets(SN.load_snapshot(spark, str(tmp_path / "s"), "assets", ASSETS), documents.document_assets(docs), stored=True),
    ):
        assert df.count() == 6
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    assert not any(word in plan for plan in plans for word in ("Join", "Aggregate"))


def test_a_second_refresh_keeps_replaces_and_adds(spark, tmp_path, rows):
    def refresh(*given):
        made = [(i, text, "table", i, "o", "d", "{}", [(i, "hub", "feeds")]) for i, text in given]
        c.refresh(spark.createDataFrame(made, DOCUMENTS)).collect()

    c = Catalog(spark, str(tmp_path / "s"))
    refresh(("a", "one"), ("b", "two"))
    refresh(("b", "three"), ("c", "four"), ("c", "five"))
    assert rows(c.vectors, "id", "text") == [("a", "one"), ("b", "three"), ("c", "four")]
    assert rows(c.assets, "asset_id", "impact_score") == [("a", 0.1), ("b", 0.1), ("c", 0.1)] and c.edges.count() == 3
