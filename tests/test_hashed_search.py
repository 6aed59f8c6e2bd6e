"""Search by hashed hyperplanes against brute force: recall, exact distances, copies, empty inputs."""

import math

import numpy as np
import pytest

import __spark_entry__ as entry_points
from stemma.operators import hashed_search as H
from stemma.operators.search import vector_search
from tests.test_search import brute, vectors

DATA = "/root/testdata/sf0.01"


def found(hits):
    return {(h.query_id, h.rank, h.id, round(h.distance, 6)) for h in hits}


def clustered(rng, rows, dim=16, groups=60):
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, rows)] + rng.normal(size=(rows, dim)) * 0.1


def test_recall_on_clusters_with_a_third_equal_vectors(spark):
    rng = np.random.default_rng(3)
    data = np.concatenate([np.ones((700, 16)), clustered(rng, 1400)])
    queries = np.concatenate([data[:1], data[700::40] + 0.01])
    q, v = vectors(spark, queries, "query_id"), vectors(spark, data, "id")
    got, exact = H.approximate_search(q, v, 5), vector_search(q, v, 5)
    assert H.recall(exact, got).first()["recall"] >= 0.9
    true = {(r[0], r[2]): r[3] for r in brute(queries, data, len(data))}
    rows = got.collect()
    assert all(abs(true[h.query_id, h.id] - h.distance) <= 1e-6 for h in rows)
    assert len({(h.query_id, h.rank) for h in rows}) == len({(h.query_id, h.id) for h in rows}) == len(rows)
    # Equal vectors are ties: the smallest ids are the hits.
    assert [h.id for h in sorted(rows, key=lambda h: h.rank) if h.query_id == "query_id0000"] == [f"id{i:04d}" for i in range(5)]


def test_far_apart_clusters_are_pruned():
    angles = np.full(100, 0.1)
    planes, tables = H.plan_tables(angles, 0.95)
    assert tables * (planes + 1) / 2**planes < 0.01
    assert H.bucket_recall(angles, planes, tables) >= 0.95


def test_neighbours_as_far_as_any_vector_fall_back_to_all_pairs(spark):
    assert H.plan_tables(np.full(10, math.pi / 2 * 1.2), 0.999) == (1, 1)
    rng = np.random.default_rng(5)
    data, queries = rng.normal(size=(60, 8)), rng.normal(size=(4, 8))
    q, v = vectors(spark, queries, "query_id"), vectors(spark, data, "id")
    assert found(H.approximate_search(q, v, 60, target=1.0).collect()) == brute(queries, data, 60)


@pytest.mark.parametrize("planes", [1, 3, 8])
def test_expected_recall_equals_a_count(planes):
    rng = np.random.default_rng(11)
    a = rng.normal(size=32)
    b = a + rng.normal(size=32) * 0.6
    angle = math.acos(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    normals = rng.normal(size=(20_000, planes, 32))
    differ = ((normals @ a > 0) != (normals @ b > 0)).sum(1)
    assert abs((differ <= 1).mean() - H.bucket_recall(np.array([angle]), planes, 1)) < 0.02


def test_codes_are_sides_of_planes(spark):
    rng = np.random.default_rng(2)
    data, normals = rng.normal(size=(30, 6)), rng.normal(size=(3, 5, 6))
    rows = vectors(spark, data, "id").select("id", H._codes_udf(data.mean(0), normals)("embedding").alias("codes")).collect()
    for r in rows:
        x = data[int(r.id[2:])] - data.mean(0)
        assert list(r.codes) == [sum(1 << i for i in range(5) if n[i] @ x > 0) for n in normals]


def test_empty_null_and_unequal_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<double>")
    v = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", None), ("c", [None, 1.0]), ("d", [1.0])], "id string, embedding array<double>"
    )
    assert [(r.query_id, r.rank, r.id) for r in H.approximate_search(q, v, 3).collect()] == [(1, 1, "a")]
    assert H.approximate_search(q, v.where("false"), 3).count() == 0
    assert H.approximate_search(q.where("false"), v, 3).count() == 0


def test_registered_query_reaches_its_recall(spark):
    got = entry_points.queries()["vector_search_hashed"](spark, DATA)
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    exact = vector_search(
        table.where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding"),
        table.selectExpr("vec_id as id", "embedding"), 5,
    )
    assert H.recall(exact, got).first()["recall"] >= 0.9


def test_pairs_are_not_listed_where_most_would_be(spark):
    """Random directions: the hits are those of the exact search, and no row per pair is made."""
    array = np.random.default_rng(6).normal(size=(600, 32))
    data = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(array)], "id int, embedding array<double>")
    queries = data.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    got = H.approximate_search(queries, data, 5)
    assert "codes(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in vector_search(queries, data, 5).collect()}


def test_recall_of_listed_pairs(spark, monkeypatch):
    monkeypatch.setattr(H, "EXACT_SHARE", 2.0)
    data = clustered(np.random.default_rng(9), 1200)
    q, v = vectors(spark, data[::40] + 0.01, "query_id"), vectors(spark, data, "id")
    got = H.approximate_search(q, v, 5)
    assert "codes(" in got._jdf.queryExecution().optimizedPlan().toString()
    assert H.recall(vector_search(q, v, 5), got).first()["recall"] >= 0.9
