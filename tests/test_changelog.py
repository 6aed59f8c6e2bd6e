"""The appended store: small writes, one state for all relations, compaction; scores by changes."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.operators import deltas
from stemma.operators import store as ST
from stemma.schemas import DOCUMENTS
from stemma.session import new_folder
from stemma.sources import changelog as CL

NUMBERS = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


@pytest.fixture
def log(spark):
    both = {name: CL.Relation(NUMBERS, ("k",)) for name in ("one", "two")}
    return CL.ChangeLog(spark, new_folder(spark, "test-log"), both)


def numbers(spark, *rows):
    return spark.createDataFrame([(*r, False)[:3] for r in rows], "k string, v long, _deleted boolean")


def test_last_row_of_a_key_counts_and_keys_go(spark, log, rows):
    assert log.read("one").count() == 0
    log.commit({"one": numbers(spark, *[(f"k{k}", k) for k in range(20)], (None, 7))})
    log.commit({"one": numbers(spark, ("k1", 100), ("new", 5)), "two": numbers(spark, ("a", 1))})
    log.commit({"one": numbers(spark, ("k2", None, True), (None, 8), ("k1", 101))})
    wanted = [(f"k{k}", k) for k in range(20) if k not in (1, 2)] + [("k1", 101), ("new", 5), (None, 8)]
    assert rows(log.read("one")) == sorted(wanted, key=repr) and rows(log.read("two")) == [("a", 1)]
    assert [len(p) for p in log.state()[1].values()] == [3, 1] and log.state()[0] == 3


def test_a_small_commit_writes_its_rows_only_and_many_are_compacted(spark, log, rows):
    log.commit({"one": numbers(spark, *[(f"k{k}", k) for k in range(10)])})
    before = log.state()[1]["one"]
    log.commit({"one": numbers(spark, ("k1", 1), ("k2", 2))})
    parts = log.state()[1]["one"]
    assert parts[0] == before[0] and parts[1]["rows"] == 2
    log.commit({"one": numbers(spark, *[(f"n{k}", k) for k in range(4)])})
    (whole,) = log.state()[1]["one"]
    assert whole["rows"] == 14 and log.read("one").count() == 14


def test_a_failed_write_leaves_all_relations_at_the_old_state(spark, log, rows):
    log.commit({"one": numbers(spark, ("a", 1)), "two": numbers(spark, ("b", 1))})
    bad = numbers(spark, ("b", 2)).selectExpr("k", "cast(raise_error('broken') as bigint) as v")
    with pytest.raises(Exception, match="broken"):
        log.commit({"one": numbers(spark, ("a", 2)), "two": bad})
    assert rows(log.read("one")) == [("a", 1)] and rows(log.read("two")) == [("b", 1)] and log.state()[0] == 1


def test_two_writers_do_not_take_one_number(spark, log, monkeypatch, rows):
    log.commit({"one": numbers(spark, ("a", 1))})
    other = CL.ChangeLog(spark, log.folder, log.relations)
    seen = other.state()
    log.commit({"one": numbers(spark, ("a", 2))})
    with monkeypatch.context() as m:
        m.setattr(other, "state", lambda: seen)
        with pytest.raises(CL.ConcurrentCommit):
            other.commit({"one": numbers(spark, ("a", 3))})
    assert rows(other.read("one")) == [("a", 2)]
    other.commit({"one": numbers(spark, ("a", 3))})
    assert rows(log.read("one")) == [("a", 3)] and log.state()[0] == 3


def documents(spark, *given):
    made = [(i, f"text {i}", kind, i, "o", "d", "{}", [(a, b, "feeds") for a, b in links]) for i, kind, links in given]
    return spark.createDataFrame(made, DOCUMENTS)


def test_scores_of_changes_equal_the_full_recompute(spark, rows):
    log = deltas.open_store(spark, new_folder(spark, "test-log"))
    first = documents(spark, *[(f"t{k}", "table", [(f"t{k}", "hub"), ("hub", f"t{k}")]) for k in range(16)], ("hub", "table", [("hub", "hub")]))
    deltas.refresh_by_changes(first, log)
    written = log.state()[1]
    again = documents(spark, ("t1", "table", [("t1", "hub"), ("t1", "t2"), ("t1", "gone")]), ("late", "sql", [("t3", "late")]))
    deltas.refresh_by_changes(again, log)
    assert rows(log.read("assets"), "asset_id", "impact_score") == rows(deltas.full_scores(log), "asset_id", "impact_score")
    parts = log.state()[1]
    # Two documents with three new edges: t1, t2, t3, late are touched; gone is no asset.
    assert {name: p[-1]["rows"] for name, p in parts.items()} == {"vectors": 2, "edges": 3, "degrees": 5, "assets": 4}
    assert all(parts[name][0] == written[name][0] for name in parts)
    late = documents(spark, ("gone", "report", []))
    deltas.refresh_by_changes(late, log)
    assert rows(log.read("assets").where("asset_id = 'gone'"), "impact_score") == [(0.1,)]


def test_degree_changes_need_no_edges_of_others(spark, rows):
    edges = "source_asset_id string, target_asset_id string, relationship_type string"
    added = spark.createDataFrame([("a", "b", "x"), ("a", "a", "x"), ("b", "c", "y")], edges)
    removed = spark.createDataFrame([("c", "d", "x")], edges)
    changes = deltas.degree_changes(added, removed)
    assert rows(changes) == [("a", 3), ("b", 2), ("c", 0), ("d", -1)]
    known = spark.createDataFrame([("a", 1), ("d", 4), ("z", 9)], "asset_id string, degree long")
    assert rows(deltas.changed_degrees(changes.where("change <> 0"), known)) == [("a", 4), ("b", 2), ("d", 3)]


def test_parts_with_new_keys_are_neither_joined_nor_rewritten(spark, log, rows):
    log.commit({"one": numbers(spark, ("a", 1), (None, 2))})
    log.commit({"one": numbers(spark, *[(f"b{k}", k) for k in range(5)])})
    log.commit({"one": numbers(spark, *[(f"c{k}", k) for k in range(9)])})
    parts = log.state()[1]["one"]
    assert [p["rows"] for p in parts] == [2, 5, 9] and [p.get("apart", False) for p in parts] == [False, True, True]
    assert "Join" not in log.read("one")._jdf.queryExecution().optimizedPlan().toString()
    kept = [("a", 1), (None, 2), *[(f"b{k}", k) for k in range(5)], *[(f"c{k}", k) for k in range(9)]]
    assert rows(log.read("one")) == sorted(kept, key=repr)


def test_a_deleted_key_that_comes_back_is_not_apart(spark, log, rows):
    log.commit({"one": numbers(spark, *[(f"k{k}", k) for k in range(20)])})
    log.commit({"one": numbers(spark, ("k1", None, True))})
    log.commit({"one": numbers(spark, ("z", 5))})
    log.commit({"one": numbers(spark, ("k1", 7), ("z", 6))})
    assert [p.get("apart", False) for p in log.state()[1]["one"]] == [False, False, True, False]
    assert rows(log.read("one")) == sorted([(f"k{k}", k) for k in range(20) if k != 1] + [("k1", 7), ("z", 6)], key=repr)


def test_many_parts_become_one(spark, log, rows, monkeypatch):
    monkeypatch.setattr(CL, "MOST_PARTS", 3)
    for k in range(4):
        log.commit({"one": numbers(spark, (f"k{k}", k))})
    (whole,) = log.state()[1]["one"]
    assert whole["rows"] == 4 and rows(log.read("one")) == [(f"k{k}", k) for k in range(4)]


def test_documents_with_repeated_ids_are_kept_once(spark, rows):
    """The copy with the highest values is kept, as among all rows; rows whose id comes once are not shuffled."""
    docs = documents(spark, ("a", "table", []), ("b", "sql", []), ("a", "sql", [])).withColumn("text", F.concat("text", "asset_type"))
    kept = ST.stored_last_per_key(docs, ["id"], F.struct("text"))
    assert rows(kept, "id", "text") == [("a", "text atable"), ("b", "text bsql")]
    alone = ST.stored_last_per_key(docs.where("text <> 'text asql'"), ["id"], F.struct("text"))
    plan = alone._jdf.queryExecution().optimizedPlan().toString()
    assert rows(alone, "id") == [("a",), ("b",)] and "Aggregate" not in plan and "Join" not in plan
