"""Registered queries against their SQL, held-out accuracy, and the pipeline."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from stemma.llm import registered
from stemma.llm.common import stored

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_matches_its_sql(spark, duck, name):
    found = registered.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    result = duck.execute(registered.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(expected, key=repr)


def test_one_query_per_operator():
    numbers = [int(m[1]) for n in registered.QUERIES if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in registered.QUERIES


def test_held_out_accuracy(spark, duck):
    quality = dict(duck.execute("select doc_id, quality from labels").fetchall())
    found = registered.QUERIES["op1_quality_classifier"](spark, DATA).collect()
    held = [r for r in found if r.held_out and r.doc_id in quality]
    assert held and sum(r.predicted == quality[r.doc_id] for r in held) >= 0.9 * len(held)


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    results, columns = [docs], docs.columns
    for _, stage in corpus_pipeline.STAGES:
        results.append(stored(stage(spark, results[-1], DATA), "test-stage"))
    start, good, single, apart, mixed, packed = results
    assert all(r.columns == columns for r in results[:-1])
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    largest = {}
    for r in good.collect():
        largest[lower(r.text)] = max(largest.get(lower(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(largest.values())
    assert set(r.doc_id for r in apart.collect()) <= set(largest.values())
    assert set(Counter(r.doc_id for r in mixed.collect()).values()) <= {1, 2}
    assert sum(r.piece == 0 for r in packed.collect()) == mixed.count()


def test_near_copies_keep_one_of_each_group(spark):
    """Groups whose ids are all null, and groups with the same smallest id, against brute force."""
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema

    def text(group, changed=None):
        return " ".join(f"g{group}x{changed}" if k == changed else f"g{group}w{k}" for k in range(120))

    groups = [(None, None, None), (None, None), (1, 1, 2), (1, 3), (1, None), (None, 5, 4), (6, 6), (7,), (None,), (8, 9, None)]
    rows = [(i, text(g, 10 + 40 * k if k else None), "en", "a", 1) for g, ids in enumerate(groups) for k, i in enumerate(ids)]
    rows += [rows[0], rows[5], (None, "", "en", "a", 1), (11, None, "en", "a", 1)]
    shingles = [frozenset(zip(*[(r[1] or "").split()[k:] for k in range(5)])) for r in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) > 0:
                label = [label[a] if x == label[b] else x for x in label]
    # Of a group's rows with the smallest id any text may stay.
    wanted = Counter()
    for c in set(label):
        ids = [rows[k][0] for k in range(len(rows)) if label[k] == c]
        wanted[min((i for i in ids if i is not None), default=None), next(iter(shingles[c]), ("", ""))[0].rstrip("0123456789")[:2]] += 1
    found = corpus_pipeline.near(spark, spark.createDataFrame(rows, schema), DATA).collect()
    kept = Counter((r.doc_id, (r.text or "")[:2]) for r in found)
    assert len(found) == len(set(label)) == len(groups) + 2 and kept == wanted


def test_stages_of_no_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "test-stage")
    assert docs.count() == 0


def test_stages_with_null_and_repeated_rows(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    long = " ".join(f"word{k}" for k in range(40))
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, long, "en", "a", 1), (1, long, "en", "a", 1),
            (2, "", None, None, 0), (3, long + " more", "en", "b", 2)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, DATA), "test-stage")
    assert docs.count() >= 1
