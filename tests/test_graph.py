"""Hand-made graphs: hubs, loops, unregistered ends, stored scores, empty inputs."""

import pytest
from pyspark.sql import functions as F

from stemma.operators import catalog, graph, store
from stemma.schemas import ASSETS, EDGES


def assets_of(spark, *rows):
    """(id, type, owner, score) tuples as assets."""
    return spark.createDataFrame([(i, t, i.upper(), "", o, None, s) for i, t, o, s in rows], ASSETS)


def edges_of(spark, *rows):
    return spark.createDataFrame(list(rows), EDGES)


@pytest.fixture(scope="module")
def small(spark):
    assets = assets_of(
        spark, ("a", "table", "Ann", 0.0), ("b", "sql", None, 0.95), ("c", "etl", "Bob", 0.0), ("d", "table", "50%_x", 0.0)
    )
    edges = edges_of(
        spark, ("a", "b", "fk"), ("a", "b", "feeds"), ("a", "c", "fk"), ("a", "a", "loop"), ("a", "x", "fk"), ("x", "c", "feeds"),
    )
    return assets, edges


def test_neighbours(small, rows):
    assets, edges = small
    down = graph.downstream_assets(edges, assets).where("asset_id = 'a'")
    assert rows(down, "neighbour_id", "asset_type", "relationship_type", "missing") == [
        ("a", "table", None, False), ("b", "sql", None, False), ("b", "sql", None, False),
        ("c", "etl", None, False), ("x", None, "fk", True),
    ]


def test_degree_counts_loops_twice_and_missing_ends(small, rows):
    _, edges = small
    assert rows(graph.degree_counts(edges)) == [("a", 1, 5), ("b", 2, 0), ("c", 2, 0), ("x", 1, 1)]


def test_scores(small, rows):
    assets, edges = small
    assert rows(graph.resolve_impact_scores(edges, assets), "asset_id", "calculated_score", "score", "changed") == [
        ("a", 0.6, 0.6, True), ("b", 0.2, 0.95, False), ("c", 0.2, 0.2, True), ("d", 0.0, 0.0, False),
    ]
    assert rows(graph.recompute_impact_scores(edges, assets), "asset_id", "impact_score")[1] == ("b", 0.2)


def test_usage(small, rows):
    assets, edges = small
    ids = assets.select("asset_id")
    got = rows(graph.data_usage(ids, edges, assets).where("asset_id in ('a', 'd')"))
    assert got == [("a", True, "table", 1, 5, 2, 1, 1, 1, 0.6), ("d", True, "table", 0, 0, 0, 0, 0, 0, 0.0)]


def test_usage_lists(small, rows):
    assets, edges = small
    items = graph.usage_items(edges, assets).where("asset_id = 'a'")
    counts = {r[0]: r[1] for r in items.groupBy("list_name").count().collect()}
    assert counts == {"upstream": 1, "downstream": 5, "queries": 2, "reports": 1, "etl_jobs": 1, "downstream_tables": 1}


def test_groups_hold_each_neighbour_once(small, rows):
    assets, edges = small
    grouped = graph.grouped_usage(edges, assets).where("asset_id = 'a'")
    assert rows(grouped, "bucket_order", "bucket", "neighbour_id") == [
        (1, "table", "a"), (2, "sql", "b"), (3, "etl", "c"), (5, "other", "x"),
    ]
    changed = graph.grouped_usage(edges, assets, changes_only=True).where("asset_id = 'a'")
    assert rows(changed, "neighbour_id") == [("b",), ("c",)]


def test_lineage_requests(spark, small, rows):
    assets, edges = small
    asked = spark.createDataFrame(
        [(" b ", "UPSTREAM"), ("b", "downstream"), ("d", None), ("x", "nonsense"), ("", "both"), ("nobody", "both")],
        "asset_id string, direction string",
    )
    got = rows(graph.asset_lineage(asked, edges, assets), "asset_id", "direction", "side", "neighbour_id", "asset_known")
    assert got == [
        ("", "both", None, None, False),
        ("b", "downstream", None, None, True),
        ("b", "upstream", "upstream", "a", True),
        ("b", "upstream", "upstream", "a", True),
        ("d", "both", None, None, True),
        ("nobody", "both", None, None, False),
        ("x", "both", "downstream", "c", False),
        ("x", "both", "upstream", "a", False),
    ]


def test_details_skip_unregistered_assets(spark, small, rows):
    assets, edges = small
    ids = spark.createDataFrame([("x",), ("d",)], "asset_id string")
    assert rows(graph.asset_details(ids, edges, assets), "asset_id", "side") == [("d", None)]
    by_table = graph.search_by_table(ids, edges, assets)
    assert rows(by_table, "asset_id", "side", "neighbour_id") == [
        ("d", None, None), ("x", "downstream", "c"), ("x", "upstream", "a"),
    ]


def test_compare(spark, rows):
    assets = assets_of(spark, ("s", "table", None, 0.0), ("t", "table", None, 0.0))
    edges = edges_of(
        spark,
        ("s", "p", "fk"), ("s", "p", "feeds"), ("s", "q", "fk"),  # known and shared, twice on p
        ("m", "p", "fk"), ("m", "q", "feeds"),  # unregistered, other type: not the same item
        ("n", "p", "fk"), ("n", "q", "fk"),  # unregistered, same type: shared
        ("p", "t", "fk"),
    )
    pairs = spark.createDataFrame([("p", "q")], "asset1 string, asset2 string")
    got = rows(graph.compare_assets(pairs, edges, assets), "list_name", "side", "neighbour_id", "relationship_type")
    assert got == [
        ("asset1_only_downstream", "downstream", "t", None),
        ("asset1_only_upstream", "upstream", "m", "fk"),
        ("asset2_only_upstream", "upstream", "m", "feeds"),
        ("similarities", "upstream", "n", "fk"),
        ("similarities", "upstream", "s", None),
        ("similarities", "upstream", "s", None),
    ]


@pytest.mark.parametrize("tasks", [None, 50])
def test_compare_lists_pairs_behind_the_last_shuffle(spark, rows, monkeypatch, tasks):
    """An asset in many pairs, pairs of one asset, ids that come in both places; the ends cross two shuffles, the pairs none."""
    monkeypatch.setattr(graph, "PARTNERS", 4)
    found = [(f"a{a}", f"n{n}", "fk" if n % 3 else "feeds") for a in range(30) for n in range(a % 5, 12, 1 + a % 3)] + [("n1", "a2", "fk")]
    assets, edges = assets_of(spark, *[(f"n{n}", "table", None, 0.0) for n in range(6)]), edges_of(spark, *found, *found[:9])
    asked = [("a0", f"a{k}") for k in range(30)] + [(f"a{k}", f"a{k + 1}") for k in range(29)] + [("a4", "a0"), ("a4", "a0"), (None, "a1")]
    pairs = spark.createDataFrame(asked, "asset1 string, asset2 string")
    ends = [(t, "upstream", s, r) for s, t, r in found + found[:9]] + [(s, "downstream", t, r) for s, t, r in found + found[:9]]
    items = {}
    for a, side, n, r in ends:
        known = n in {f"n{k}" for k in range(6)}
        items.setdefault(a, []).append((side, n, None if known else r, not known))
    wanted = []
    for one, two in set(asked):
        mine, other = items.get(one, []), items.get(two, [])
        wanted += [(one, two, *i, "similarities" if i in other else "asset1_only_" + i[0]) for i in mine]
        wanted += [(one, two, *i, "asset2_only_" + i[0]) for i in other if i not in mine]
    got = graph.compare_assets(pairs, edges, assets, tasks)
    columns = ["asset1", "asset2", "side", "neighbour_id", "relationship_type", "missing", "list_name"]
    assert rows(got, *columns) == sorted(wanted, key=repr)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = graph.compare_assets(pairs, edges, assets, tasks)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    top = text[: text.index("Exchange")]
    assert "Join [neighbour_id" in top and top.count("HashAggregate") == 2
    assert not tasks or f", {tasks})" in text


def test_change_impact(spark, small, rows):
    assets, edges = small
    known = edges.replace("a", "public.aa")
    assets = assets.replace("a", "public.aa")
    requests = spark.createDataFrame(
        [(1, "c", "drop x on aa"), (2, "b", "no table"), (3, " ", ""), (4, "zz", "")],
        "request_id int, field_asset string, change_text string",
    )
    got = rows(
        graph.change_impact(requests, known, assets),
        "request_id", "asset_id", "affected_queries", "affected_reports", "downstream_count", "risk_level",
        F.col("error").isNotNull(), F.col("resolution_warning").isNotNull(),
    )
    assert got == [
        (1, "public.aa", 2, 1, 5, "medium", False, True),
        (2, "b", 0, 0, 0, "high", False, False),
        (3, "", 0, 0, 0, "low", True, False),
        (4, "zz", 0, 0, 0, "low", False, False),
    ]


def test_empty_inputs(spark, rows):
    assets, edges = assets_of(spark), edges_of(spark)
    assert rows(graph.risk_report(edges, assets)) == []
    assert rows(graph.usage_counts(edges, assets)) == []
    assert rows(catalog.catalog_summary(assets)) == [(0, 0, 0, 0, 0, 0, None)]
    assert rows(store.add_edges(edges, edges)) == []


def test_browse_filters(small, rows):
    assets, _ = small
    assert rows(catalog.search_by_owner(assets, "none"), "asset_id") == [("b",)]
    assert rows(catalog.search_by_owner(assets, "%_"), "asset_id") == [("d",)]
    assert rows(catalog.search_by_owner(assets, ""), "asset_id") == [("a",), ("b",), ("c",), ("d",)]
    assert rows(catalog.list_tables(assets, "_"), "asset_id") == []
    assert rows(catalog.list_tables(assets, "A"), "asset_id") == [("a",)]
    assert rows(catalog.list_reports(assets), "asset_id") == []


def test_bullets(spark, rows):
    assets = assets_of(spark, ("hub", "table", None, 0.0), ("lone", "table", None, 0.0))
    edges = edges_of(spark, *[("hub", f"n{i:02d}", "fk") for i in range(15)])
    lines = rows(catalog.bullet_lines(assets, graph.downstream_assets(edges, assets)))
    assert len(lines) == 14
    assert ("hub", 13, "- … and 3 more") in lines and ("lone", 1, "- (none)") in lines
    assert ("hub", 1, "- `n00`") in lines


def test_stores(spark, rows):
    old = assets_of(spark, ("a", "table", "Ann", 0.4), ("b", "sql", None, 0.1))
    new = assets_of(spark, ("a", "view", "Al", 0.9), ("c", "etl", None, 0.9), ("", "etl", None, 0.0))
    got = rows(store.register_assets(old, new), "asset_id", "asset_type", "owner", "impact_score")
    assert got == [("a", "view", "Al", 0.4), ("b", "sql", None, 0.1), ("c", "etl", None, 0.0)]
    edges = edges_of(spark, ("a", "b", "fk"))
    more = edges_of(spark, ("a", "b", "fk"), ("a", "b", "x"), ("a", "b", "x"), ("", "b", "x"), ("a", None, "x"))
    assert rows(store.add_edges(edges, more)) == [("a", "b", "fk"), ("a", "b", "x")]
    docs = spark.createDataFrame(
        [("1", None, "one", None, "u"), (None, "2", None, "two", None), ("", None, None, None, "w")],
        "id string, doc_id string, text string, content string, kind string",
    )
    stored = spark.createDataFrame([("1", "old", {"k": "v"}), ("9", "nine", {})], "id string, text string, metadata map<string,string>")
    got = store.upsert_documents(stored, docs)
    assert rows(got.where("id not like 'doc-%'"), "id", "text", F.to_json("metadata")) == [
        ("1", "one", '{"kind":"u"}'), ("2", "two", "{}"), ("9", "nine", "{}"),
    ]
    assert got.where("id like 'doc-%'").count() == 1
