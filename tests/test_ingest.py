"""Files to documents to stores: a small hand-derived catalog."""

import json

import pytest
from pyspark.sql import functions as F

from stemma.operators import documents, graph, refresh, store
from stemma.schemas import ASSETS, EDGES
from stemma.sources import files, snapshots, warehouse
from stemma.streaming import refresh as streaming

SQL = {
    "reports/daily.sql": "-- shops per day\nselect s.name, count(v.id) from shops s left join visits v on v.shop = s.id group by s.name",
    "reports/deep/stock.SQL": "select i.sku, sum(m.qty) from wh.items i, wh.moves m where i.id = m.item group by i.sku;",
    "reports/blank.sql": "  \n ",
    "reports/notes.txt": "select 1 from ignored",
}
JOBS = {
    "jobs/load_visits.yaml": "name: load_visits\nowner: data\nsources:\n  - Shops\n  - raw.clicks\ntargets: [visits]\n"
    "transformations: [clean, join]\nschedule: \"0 1 * * *\"\ndependencies:\n  - etl:jobs/all.json#first\n  - name: other\n",
    "jobs/all.json": json.dumps({"etl_jobs": [{"name": "first", "targets": ["raw.clicks"]}, {"name": "first", "targets": ["x"]}, 3, {"sources": "one"}]}),
    "jobs/list.yml": "- name: l1\n- text\n- name: l2\n  sources: null\n",
    "jobs/bad.yaml": "a: [unclosed",
    "jobs/bad.json": "{not json",
    "jobs/empty.json": "",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("catalog")
    for name, content in {**SQL, **JOBS}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content, encoding="utf-8")
    return root


def sql_files(spark, tree):
    return files.scan_sql_files(spark, [str(tree / "reports"), str(tree / "reports" / "daily.sql")], str(tree))


def jobs(spark, tree):
    return files.scan_etl_configs(spark, [str(tree / "jobs")], str(tree))


def test_sql_files(spark, tree, rows):
    got = rows(sql_files(spark, tree), "source", F.substring("sql", 1, 6))
    assert got == [("reports/daily.sql", "-- sho"), ("reports/deep/stock.SQL", "select")]
    outside = files.scan_sql_files(spark, [str(tree / "reports" / "daily.sql")], "/elsewhere")
    assert outside.first()["source"].startswith("/")


def test_jobs(spark, tree, rows):
    got = {(r.source, r.name): r for r in jobs(spark, tree).collect()}
    assert sorted(got) == [
        ("jobs/all.json", "all"), ("jobs/all.json", "first"), ("jobs/list.yml", "l1"), ("jobs/list.yml", "l2"),
        ("jobs/load_visits.yaml", "load_visits"),
    ]
    load = got["jobs/load_visits.yaml", "load_visits"]
    assert load.sources == ["public.shops", "raw.clicks"] and load.targets == ["public.visits"]
    assert load.dependency_ids == ["etl:jobs/all.json#first", "etl:other"]
    assert got["jobs/all.json", "first"].targets == ["raw.clicks"]
    assert got["jobs/all.json", "all"].sources == ["public.one"]


LOAD = "etl:jobs/load_visits.yaml#load_visits"
EDGE_LIST = [
    (LOAD, "public.visits", "etl_target"),
    ("etl:jobs/all.json#first", LOAD, "etl_depends_on"),
    ("etl:jobs/all.json#first", "raw.clicks", "etl_target"),
    ("etl:other", LOAD, "etl_depends_on"),
    ("public.one", "etl:jobs/all.json#all", "etl_source"),
    ("public.shops", LOAD, "etl_source"),
    ("public.shops", "sql:reports/daily.sql", "sql_reference"),
    ("public.visits", "sql:reports/daily.sql", "sql_reference"),
    ("raw.clicks", LOAD, "etl_source"),
    ("wh.items", "sql:reports/deep/stock.SQL", "sql_reference"),
    ("wh.moves", "sql:reports/deep/stock.SQL", "sql_reference"),
]


def all_documents(spark, tree):
    return documents.build_documents(
        documents.sql_documents(sql_files(spark, tree)), documents.etl_documents(jobs(spark, tree))
    )


def test_lineage_graph(spark, tree, rows):
    assert rows(documents.document_edges(all_documents(spark, tree))) == sorted(EDGE_LIST, key=repr)


def test_document_texts(spark, tree):
    texts = {r.id: r.text for r in all_documents(spark, tree).collect()}
    assert texts["sql:reports/daily.sql"].startswith(
        "SQL asset reports/daily.sql: SELECT using tables: public.shops, public.visits. Statement type: SELECT. "
        "Tables: public.shops, public.visits. Joins: LEFT JOIN public.visits. SQL: -- shops per day"
    )
    assert texts[LOAD] == (
        "ETL asset load_visits (jobs/load_visits.yaml): ETL process load_visits. Reads from: public.shops, raw.clicks. "
        "Writes to: public.visits. Transformations: clean; join. Schedule: 0 1 * * *. "
        'Dependencies: etl:jobs/all.json#first, {"name":"other"}.'
    )


def test_refresh_twice_gives_the_same_state(spark, tree, tmp_path, rows):
    where = str(tmp_path / "store")
    docs = all_documents(spark, tree)
    first = refresh.refresh_catalog(docs, where).first().asDict()
    assert first["relationships_added"] == 11 and first["assets_registered"] == 7 and first["scores_updated"] == 7

    def state():
        return (
            rows(snapshots.load_snapshot(spark, where, "assets", ASSETS)),
            rows(snapshots.load_snapshot(spark, where, "edges", EDGES)),
            rows(snapshots.load_vector_collection(spark, where), "id", "text", "embedding"),
        )

    before = state()
    refresh.refresh_catalog(docs.where("asset_type = 'sql'"), where)
    assert state() == before
    scores = {r[0]: r[-1] for r in before[0]}
    assert scores[LOAD] == 0.5 and scores["etl:jobs/list.yml#l1"] == 0.0
    assert snapshots.current_version(spark, where, "assets")[1] == 2


def test_vectors_hold_all_metadata(spark, tree):
    found = {r.id: r.metadata for r in refresh.document_vectors(all_documents(spark, tree)).collect()}
    daily, load = found["sql:reports/daily.sql"], found[LOAD]
    assert daily["tables"] == '["public.shops","public.visits"]' and "shops per day" in daily["sql"]
    assert daily["joins"] == '[{"join_type":"LEFT JOIN","table":"public.visits"}]' and daily["asset_type"] == "sql"
    assert load["schedule"] == "0 1 * * *" and load["name"] == "load_visits" and "public.visits" in load["targets"]
    assert all(v is not None for m in found.values() for v in m.values())


def test_stream_refresh_equals_batch(spark, tree, tmp_path, rows):
    where, inbox = str(tmp_path / "store"), tmp_path / "inbox"
    inbox.mkdir()
    stream = lambda: streaming.stream_refresh(
        streaming.stream_sql_files(spark, str(inbox), str(inbox)), where, str(tmp_path / "progress")
    )
    (inbox / "one.sql").write_text("select 1 from a.b")
    stream().awaitTermination()
    (inbox / "two.sql").write_text("select 1 from a.b join c on true")
    stream().awaitTermination()
    assert rows(snapshots.load_snapshot(spark, where, "assets", ASSETS), "asset_id", "impact_score") == [
        ("sql:one.sql", 0.1), ("sql:two.sql", 0.2),
    ]
    assert snapshots.load_snapshot(spark, where, "edges", EDGES).count() == 3


def test_empty_store_loads(spark, tmp_path):
    assert snapshots.load_vector_collection(spark, str(tmp_path / "none")).count() == 0


def test_composite_foreign_key(spark, rows):
    kept = spark.createDataFrame([("s", "t", "s.t")], "table_schema string, table_name string, qualified_name string")
    usage = spark.createDataFrame(
        [("fk", "s", "t", "a", 1), ("fk", "s", "t", "b", 2)],
        "constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int",
    )
    constraints = spark.createDataFrame(
        [("fk", "s", "t", "FOREIGN KEY")], "constraint_name string, table_schema string, table_name string, constraint_type string"
    )
    used = spark.createDataFrame(
        [("fk", "s", "r", "x"), ("fk", "s", "r", "y")],
        "constraint_name string, table_schema string, table_name string, column_name string",
    )
    fks = warehouse.scan_foreign_keys(constraints, usage, used, kept)
    assert fks.count() == 4
    assert rows(warehouse.foreign_key_edges(fks)) == [("s.r", "s.t", "foreign_key")]


def test_table_scan_filters(spark, rows):
    tables = spark.createDataFrame(
        [("a", "t", "BASE TABLE"), ("a", "v", "VIEW"), ("pg_catalog", "p", "BASE TABLE"), ("b", "t", "BASE TABLE"), ("a", "T", "BASE TABLE")],
        "table_schema string, table_name string, table_type string",
    )
    skip = spark.createDataFrame([("a.t",)], "qualified_name string")
    assert rows(warehouse.scan_base_tables(tables, exclude=skip), "qualified_name") == [("a.T",), ("b.t",)]
    assert rows(warehouse.scan_base_tables(tables, schemas=["b"]), "qualified_name") == [("b.t",)]


def test_legacy_pair_and_defaults(spark, rows):
    docs = spark.createDataFrame(
        [("d1", "long text", None, [("a", "b", None), ("", "c", "x")], "p", "q", None), ("d2", "t", "note", [], None, "q", "r"), ("", "t", None, [], "a", "b", "c")],
        "id string, text string, asset_type string, lineage_edges array<struct<source string, target string, relationship_type string>>,"
        "source_asset_id string, target_asset_id string, relationship_type string",
    ).select("*", *[F.lit(None).cast("string").alias(c) for c in ("name", "owner", "description", "metadata")])
    assert rows(documents.document_edges(docs)) == [("a", "b", "foreign_key"), ("p", "q", "depends_on")]
    assert rows(documents.document_assets(docs), "asset_id", "asset_type", "name", "description", "owner") == [
        ("d1", "document", "d1", "long text", "unknown"), ("d2", "note", "d2", "t", "unknown"),
    ]


def test_metadata_flattening(spark):
    df = spark.createDataFrame([("a", None, ["x", "y"], 3)], "n string, m string, l array<string>, k int")
    (got,) = df.select(store.flatten_metadata(df.dtypes)).first()
    assert got == {"n": "a", "l": '["x","y"]', "k": "3"}


def test_score_of_graph_by_hand(spark, tree, rows):
    docs = all_documents(spark, tree)
    assets = documents.document_assets(docs).withColumn("impact_score", F.lit(0.0))
    got = dict(rows(graph.impact_scores(documents.document_edges(docs), assets), "asset_id", "degree"))
    assert got == {
        LOAD: 5, "etl:jobs/all.json#first": 2, "etl:jobs/all.json#all": 1, "etl:jobs/list.yml#l1": 0,
        "etl:jobs/list.yml#l2": 0, "sql:reports/daily.sql": 2, "sql:reports/deep/stock.SQL": 2,
    }
