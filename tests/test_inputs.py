"""Rejected files, metadata as of a time, searches with repeated ids and other lengths, whole SQL in the embedding."""

import datetime as dt
import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from stemma.operators import documents as D
from stemma.operators import history as H
from stemma.operators import search as V
from stemma.operators.refresh import document_vectors
from stemma.sources import files


def test_missing_paths_and_bad_files_are_listed_and_skipped(spark, tmp_path, rows):
    (tmp_path / "good one.sql").write_text("select 1")
    (tmp_path / "bytes.sql").write_bytes(b"select '\xff\xfe'")
    (tmp_path / "blank.sql").write_text(" \n")
    inputs = files.read_inputs(spark, [str(tmp_path), str(tmp_path / "none"), "/nowhere.sql"], ("sql",), str(tmp_path))
    seen = Observation("inputs")
    assert files.counted(inputs, seen).count() == 5 and seen.get == {"accepted": 1, "rejected": 4}
    assert rows(files.rejected(inputs), "source", "reason") == sorted(
        [("bytes.sql", files.NOT_UTF8), ("blank.sql", files.EMPTY), (str(tmp_path / "none"), files.MISSING), ("/nowhere.sql", files.MISSING)]
    )
    assert rows(files.scan_sql_files(spark, [str(tmp_path), "/nowhere"], str(tmp_path)), "source", "sql") == [("good one.sql", "select 1")]
    assert files.scan_sql_files(spark, ["/nowhere"], "/").count() == 0


def test_job_files_that_are_no_json_or_yaml_are_rejected(spark, tmp_path, rows):
    (tmp_path / "a.json").write_text('{"name": "a"}')
    (tmp_path / "b.json").write_text('{"name": ')
    (tmp_path / "c.yaml").write_text("name: c\nsources: [x]")
    (tmp_path / "d.yml").write_text("a: [1\nb: }")
    (tmp_path / "e.yaml").write_bytes(b"name: \xff")
    inputs = files.read_etl_inputs(spark, [str(tmp_path), "/gone"], str(tmp_path))
    assert rows(files.rejected(inputs), "source", "reason") == sorted(
        [("b.json", files.NOT_READABLE), ("d.yml", files.NOT_READABLE), ("e.yaml", files.NOT_UTF8), ("/gone", files.MISSING)]
    )
    assert rows(files.scan_etl_configs(spark, [str(tmp_path), "/gone"], str(tmp_path)), "name") == [("a",), ("c",)]


def test_as_of_with_ties_gaps_and_a_hot_id(spark, rows):
    rng, day = random.Random(2), dt.timedelta(days=1)
    start = dt.datetime(2020, 1, 1)
    versions = [("hot" if rng.random() < 0.5 else rng.choice("abc"), start + rng.randrange(40) * day, rng.random() < 0.2, f"o{k}") for k in range(120)]
    versions += [("a", None, False, "never"), (None, start, False, "none")]
    requests = [(k, rng.choice(["hot", "a", "b", "c", "nobody"]), start + rng.randrange(-3, 60) * day) for k in range(200)] + [(500, "a", None), (501, None, start)]

    def wanted(i, at):
        known = [v for v in versions if v[0] == i and at is not None and v[1] is not None and v[1] <= at and i is not None]
        best = max(known, key=lambda v: v[1:], default=None)
        return None if best is None or best[2] else best[3]

    given = spark.createDataFrame(versions, "asset_id string, valid_from timestamp, ended boolean, owner string")
    asked = spark.createDataFrame(requests, "r int, asset_id string, at timestamp")
    for seconds in (86_400, 5 * 86_400, 400 * 86_400):
        found = H.as_of(asked, given, slice_seconds=seconds)
        assert rows(found, "r", "version.owner") == sorted([(r, wanted(i, at)) for r, i, at in requests], key=repr)
    assert H.as_of(asked.limit(0), given).count() == 0 and H.as_of(asked, given.limit(0)).where("version is null").count() == len(requests)


def test_repeated_ids_are_one_document(spark, rows):
    docs = spark.createDataFrame([("a", "alpha beta", "t"), ("a", "gamma delta", "t"), ("b", "alpha", "t")], "id string, text string, asset_type string")
    asked = spark.createDataFrame([(1, "gamma delta"), (1, "gamma delta")], "query_id int, text string")
    found = V.search_hits(asked, docs, top_k=2)
    assert rows(found, "rank", "data_asset", "description") == [(1, "a", "gamma delta"), (2, "b", "alpha")]


def test_vectors_of_other_lengths_take_no_part(spark, rows):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0]), ("d", [1.0, 2.0, 3.0]), ("e", None)], "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "query_id int, embedding array<double>")
    assert rows(V.vector_search(asked, vectors, 3), "query_id", "rank", "id") == [(1, 1, "a"), (1, 2, "b")]
    assert rows(V.other_lengths(vectors, 2)) == [("c", 1), ("d", 3)]


def test_words_behind_the_shown_part_of_a_statement_are_found(spark):
    sql = "select " + ", ".join(f"c{k}" for k in range(900)) + " from base where needle_word = 1"
    docs = D.sql_documents(spark.createDataFrame([("x.sql", sql), ("y.sql", "select a from b")], "source string, sql string"))
    shown = {r.id: r for r in docs.collect()}
    assert "needle_word" not in shown["sql:x.sql"].text and len(shown["sql:x.sql"].text) < 2200
    vectors = document_vectors(docs)
    texts = docs.select("id", D.searched_text(F.col("text"), F.col("asset_type"), F.col("metadata")).alias("text"))
    whole = {r.id: r.text for r in texts.collect()}
    assert "needle_word" in whole["sql:x.sql"] and whole["sql:y.sql"] == shown["sql:y.sql"].text
    (query,) = V.embed_texts(spark.createDataFrame([("q", "needle_word")], "id string, text string")).collect()
    (found,) = [r.embedding for r in vectors.collect() if r.id == "sql:x.sql"]
    assert sum(a * b for a, b in zip(query.embedding, found)) > 0
