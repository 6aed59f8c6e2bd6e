"""Vector search against brute force, context assembly, pooling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.operators import search


def vectors(spark, array, name):
    return spark.createDataFrame(
        [(f"{name}{i:04d}", [float(x) for x in row]) for i, row in enumerate(array)], f"{name} string, embedding array<double>"
    )


def brute(queries, data, k):
    out = set()
    for i, q in enumerate(queries):
        d = np.round(((data - q) ** 2).sum(1), 6)
        for rank, j in enumerate(np.lexsort((np.arange(len(d)), d))[:k], 1):
            out.add((f"query_id{i:04d}", rank, f"id{j:04d}", round(float(d[j]), 6)))
    return out


@pytest.mark.parametrize("k", [1, 7, 500])
def test_exact_with_a_third_of_all_vectors_equal(spark, monkeypatch, k):
    monkeypatch.setattr(search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(search, "QUERY_ROWS", 16)
    rng = np.random.default_rng(7)
    clustered = rng.normal(size=(8, 12))[rng.integers(0, 8, 200)] + rng.normal(size=(200, 12)) * 0.05
    data = np.concatenate([np.ones((100, 12)), clustered])
    queries = np.concatenate([data[::9], rng.normal(size=(5, 12)) * 3])
    hits = search.vector_search(
        vectors(spark, queries, "query_id"), vectors(spark, data, "id"), k
    ).collect()
    assert {(h.query_id, h.rank, h.id, round(h.distance, 6)) for h in hits} == brute(queries, data, k)


def test_far_cells_are_skipped(spark, monkeypatch):
    """Well separated groups: a query visits its own group only."""
    rng = np.random.default_rng(1)
    centres = np.eye(8) * 100
    data = np.concatenate([c + rng.normal(size=(50, 8)) * 0.01 for c in centres])
    pivots = centres
    size, radius = np.full(8, 50), np.full(8, 0.2)
    cells = search._cells_udf(pivots, data[:0], radius, size, 5)
    visited = [len(r[0]) for r in vectors(spark, data[::50], "query_id").select(cells("embedding")).collect()]
    assert visited == [1] * 8


def test_no_vectors_no_hits(spark):
    some = vectors(spark, np.ones((2, 3)), "query_id")
    none = vectors(spark, np.ones((1, 3)), "id").where("false")
    assert search.vector_search(some, none, 3).count() == 0
    assert search.vector_search(some.where("false"), vectors(spark, np.ones((2, 3)), "id"), 3).count() == 0


def test_word_vectors_use_the_whole_text(spark):
    texts = [("a", "one two"), ("b", "TWO, one!"), ("c", ""), ("d", "filler " * 5000 + "one two")]
    got = {r.id: r.embedding for r in search.embed_texts(spark.createDataFrame(texts, "id string, text string")).collect()}
    assert got["a"] == got["b"] and sum(x * x for x in got["a"]) == pytest.approx(1.0)
    assert got["c"] == [0.0] * 64
    assert sum(1 for x in got["d"] if x) == 3


def test_model_plug_in_gets_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            sizes.add(1)
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    docs = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id int, text string").coalesce(1)
    got = {r.id: r.embedding for r in search.embed_with(docs, load, batch=4).collect()}
    assert got == {i: [float(i), 1.0] for i in range(10)}
    assert sizes.value == 3


def test_mean_pool(spark):
    rows = [("a", 1, [1.0, 2.0]), ("a", 0, [9.0, 9.0]), ("a", 1, [3.0, 4.0]), ("b", 0, [5.0, 5.0])]
    pooled = search.mean_pool(spark.createDataFrame(rows, "id string, mask int, embedding array<double>"))
    assert {r.id: r.embedding for r in pooled.collect()} == {"a": [2.0, 3.0], "b": [0.0, 0.0]}


def test_context_stops_at_the_first_overflow(spark):
    heading = len("--- Catalog asset 1: t1 (table) ---\n")
    sizes = [2000, 1400, 500, 50]
    hits = spark.createDataFrame(
        [("q", i, f"t{i}", "x" * (n - heading), "table") for i, n in enumerate(sizes, 1)]
        + [("r", 1, "s", "short", None), ("r", 2, "t9", "also", "table"), ("r", 3, "t9", "again", "table")],
        "query_id string, rank int, id string, snippet string, asset_type string",
    )
    got = {r.query_id: r for r in search.catalog_context(hits).collect()}
    assert len(got["q"].context) == 2000 + 2 + 1400
    assert got["q"].tables_used == ["t1", "t2", "t3"]
    assert got["r"].context.startswith("--- Catalog asset 1: s (asset) ---\nshort\n\n--- Catalog asset 2: t9")
    assert got["r"].tables_used == ["t9"]


def test_snippets(spark):
    df = spark.createDataFrame([("x" * 900,), ("x" * 901,), (" y ",), (None,)], "t string")
    got = [r[0] for r in df.select(search.snippet_of(F.col("t"))).collect()]
    assert got == ["x" * 900, "x" * 900 + "...", "y", ""]


def test_questions_without_documents_get_empty_context(spark):
    q = spark.createDataFrame([(1, "orders")], "query_id int, text string")
    docs = spark.createDataFrame([], "id string, text string, asset_type string")
    (row,) = search.question_contexts(q, docs).collect()
    assert (row.context, row.tables_used) == ("", [])
    (prompt,) = search.question_prompts(search.question_contexts(q, docs)).collect()
    assert [m.role for m in prompt.messages] == ["system", "user"] and prompt.messages[1].content == "orders"


def test_question_finds_the_matching_document(spark):
    q = spark.createDataFrame([(1, "customer orders table")], "query_id int, text string")
    docs = spark.createDataFrame(
        [("a", "customer orders table", "table"), ("b", "weather in spring", "sql")], "id string, text string, asset_type string"
    )
    first = search.search_hits(q, docs, 1).collect()[0]
    assert (first.data_asset, first.relevance_score, first.total) == ("a", 1.0, 1)


def test_rows_without_a_vector_take_no_part(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [None, 1.0])], "id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, embedding array<double>")
    assert [(r.query_id, r.id) for r in search.vector_search(queries, vectors, 3).collect()] == [(1, "a")]


def test_words_are_counted_without_a_shuffle(spark):
    texts = [("a", "Tea tea, milk"), ("b", ""), ("c", None), ("d", "tea")]
    found = search.embed_texts(spark.createDataFrame(texts, "id string, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {r.id: r.embedding for r in found.collect()}
    assert sorted(x for x in got["a"] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert got["b"] == got["c"] == [0.0] * 64 and sum(got["d"]) == 1.0 and got["a"][got["d"].index(1.0)] > 0.8


@pytest.mark.parametrize("scale", [1e-4, 1.0, 1e4, 1e20])
def test_a_block_gives_the_exact_hits_at_any_scale(scale):
    """Near ties, copies and many near pairs at once: single precision alone would order some of them wrongly."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(6, 10))
    v = base[rng.integers(0, 6, 1500)] + rng.normal(size=(1500, 10)) * 1e-7
    v[200:900] = v[3]
    v, q = v * scale, (base[[0, 1, 2, 2, 5]] + 1e-6) * scale
    for k in (1, 5, 40):
        kept = search._first_copies(v, k)
        assert (kept >= 200).sum() < 1500 - 200 and len(kept) <= 800 + k
        at, place, distance = search._nearest(q, v[kept], k)
        for i in range(len(q)):
            d = np.round(((v - q[i]) ** 2).sum(1), 6)
            want = np.lexsort((np.arange(len(v)), d))[:k]
            assert list(kept[place[at == i]]) == list(want) and list(distance[at == i]) == list(d[want])


def test_held_pairs_are_measured_before_they_are_many(monkeypatch):
    monkeypatch.setattr(search, "HELD_PAIRS", 50)
    monkeypatch.setattr(search, "TILE_VECTORS", 16)
    rng = np.random.default_rng(5)
    v, q = 1 + rng.normal(size=(400, 6)) * 1e-6, np.ones((9, 6))
    at, place, _ = search._nearest(q, v, 7)
    d = np.round(((v - 1) ** 2).sum(1), 6)
    assert [list(place[at == i]) for i in range(9)] == [list(np.lexsort((np.arange(400), d))[:7])] * 9


def test_vectors_that_are_not_finite_do_not_hide_hits(spark):
    data = np.array([[1.0, 0.0], [np.nan, 1.0], [np.inf, 0.0], [0.0, 1.0]])
    hits = search.vector_search(vectors(spark, np.array([[1.0, 0.0]]), "query_id"), vectors(spark, data, "id"), 3).collect()
    assert sorted((h.rank, h.id) for h in hits) == [(1, "id0000"), (2, "id0003")]


def test_cells_that_nothing_skips_are_one_block(spark):
    """Vectors without clusters: a query is sent once, not once per cell."""
    rng = np.random.default_rng(2)
    data, queries = rng.normal(size=(300, 16)), rng.normal(size=(20, 16))
    hits = search.vector_search(vectors(spark, queries, "query_id"), vectors(spark, data, "id"), 4)
    assert {(h.query_id, h.rank, h.id, round(h.distance, 6)) for h in hits.collect()} == brute(queries, data, 4)
    assert "cells(" not in hits._jdf.queryExecution().optimizedPlan().toString()
