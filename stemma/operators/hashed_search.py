"""Nearest neighbours by hashed hyperplanes: only vectors that share a bucket with a query are compared.

Equal vectors are collapsed first. Each table cuts the space by random hyperplanes through the centre; the sides a
vector lies on are its bucket. A query visits its own bucket and all that differ in one side. How many planes and
tables are needed follows from the angles between a bounded sample of the queries and their true neighbours, so
that the expected recall reaches a target with the fewest compared pairs. Where neighbours are hardly nearer than
other vectors, so that a large share of all pairs would be listed, the exact search compares all pairs in blocks instead.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions.scores import distance_to_score
from stemma.operators.search import DECIMALS, _filled, _matrix, vector_search
from stemma.session import materialize

#: Queries that are searched exactly to learn the angles, and vectors whose mean is the centre.
SAMPLE_QUERIES, SAMPLE_VECTORS = 64, 1024
MAX_PLANES, MAX_TABLES = 24, 32
SEED = 20
#: Planned share of all pairs from which all pairs are compared: a pair listed as a row costs more than a hundred in a block product.
EXACT_SHARE = 0.01


def bucket_recall(angles: np.ndarray, planes: int, tables: int) -> float:
    """Expected share of neighbours at these angles that lie in a visited bucket of some table."""
    same = 1.0 - angles / math.pi
    one = same**planes + planes * same ** (planes - 1) * (1.0 - same)
    return float((1.0 - (1.0 - one) ** tables).mean())


def plan_tables(angles: np.ndarray, target: float) -> tuple[int, int]:
    """(planes, tables) that reach the target with the least share of all pairs; one plane visits all."""
    best, cost = (1, 1), 1.0
    for planes in range(2, MAX_PLANES + 1):
        share = (planes + 1) / 2.0**planes
        for tables in range(1, MAX_TABLES + 1):
            if tables * share >= cost:
                break
            if bucket_recall(angles, planes, tables) >= target:
                best, cost = (planes, tables), tables * share
                break
    return best


def _codes_udf(centre: np.ndarray, normals: np.ndarray):
    """Bucket of a vector in each table, from normals of shape (tables, planes, dimensions)."""
    tables, planes, dim = normals.shape
    flat, weights = normals.reshape(-1, dim).T, 1 << np.arange(planes, dtype=np.int64)

    @F.pandas_udf("array<long>")
    def codes(embedding: pd.Series) -> pd.Series:
        if not len(embedding):
            return pd.Series([], dtype=object)
        side = (_matrix(embedding) - centre) @ flat > 0
        return pd.Series(list(side.reshape(-1, tables, planes) @ weights))

    return codes


def _squared_distance(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.round(F.aggregate(square, F.lit(0.0), lambda s, x: s + x), DECIMALS)


def _collapsed(vectors: DataFrame, top_k: int) -> DataFrame:
    """(id, class, first, embedding) of the ``top_k`` smallest ids of each group of equal vectors.

    More ids of a group can never be among the hits. Spark cuts the groups inside each task first.
    """
    order = W.partitionBy("embedding").orderBy("id")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = vectors.withColumn("n", F.row_number().over(order)).withColumn("class", F.first("id").over(so_far))
    return ranked.where(F.col("n") <= top_k).select("id", "class", (F.col("n") == 1).alias("first"), "embedding")


def _angles(queries: DataFrame, classes: DataFrame, centre: np.ndarray, top_k: int) -> np.ndarray:
    """Angles, seen from the centre, between sampled queries and their nearest vectors."""
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE_QUERIES)
    vectors = classes.select(F.col("class").alias("id"), "embedding")
    middle = F.array(*[F.lit(float(c)) for c in centre])

    def centred(x: Column) -> Column:
        return F.zip_with(x, middle, lambda a, m: a - m)

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    pairs = (
        vector_search(sample, vectors, top_k).select("query_id", "id")
        .join(sample.withColumnRenamed("embedding", "a"), "query_id")
        .join(vectors.withColumnRenamed("embedding", "b"), "id")
        .select(centred(F.col("a")).alias("a"), centred(F.col("b")).alias("b"))
    )
    cosine = F.try_divide(dot(F.col("a"), F.col("b")), F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b"))))
    found = pairs.select(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))).alias("angle")).toPandas()
    return found["angle"].fillna(0.0).to_numpy(dtype=np.float64)


def approximate_search(queries: DataFrame, vectors: DataFrame, top_k: int = 5, target: float = 0.95) -> DataFrame:
    """Nearly the ``top_k`` nearest vectors of each query; input and output as ``search.vector_search``.

    ``target`` is the expected share of true hits that are found. Distances are exact and ties go by id; a query
    whose buckets hold fewer than ``top_k`` vectors has fewer hits. Each query id stands for one vector. Rows without a vector, with nulls in it, or with
    another length than the longest query, take no part. The driver gets at most ``SAMPLE_VECTORS`` vectors and
    ``SAMPLE_QUERIES`` times ``top_k`` angles. Only ids and codes meet by bucket, where a hot bucket splits as a skewed
    side; each pair is compared once, and its vectors are looked up then.
    """
    wide = F.col("embedding").cast("array<double>").alias("embedding")
    queries = _filled(queries.select("query_id", wide))
    vectors = _filled(vectors.select("id", wide))
    length = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    queries, vectors = (v.where(F.size("embedding") == length) for v in (queries, vectors))
    kept = materialize(_collapsed(vectors, top_k), "search-classes")
    classes = kept.where("first").select("class", "embedding")
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE_VECTORS).select("embedding").toPandas()
    if sample.empty or not length:
        return vector_search(queries, vectors, top_k)
    centre = _matrix(sample["embedding"]).mean(0)
    planes, tables = plan_tables(_angles(queries, classes, centre, top_k), target)
    if tables * (planes + 1) / 2.0**planes >= EXACT_SHARE:
        return vector_search(queries, vectors, top_k)
    codes = _codes_udf(centre, np.random.default_rng(SEED).normal(size=(tables, planes, length)))

    coded = classes.select("class", F.posexplode(codes("embedding")).alias("table", "code"))
    near = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(planes)]])
    visited = queries.select("query_id", F.posexplode(codes("embedding")).alias("table", "own")).select(
        "query_id", "table", F.explode(F.transform(near, lambda bit: F.col("own").bitwiseXOR(bit))).alias("code")
    )
    pairs = coded.join(visited, ["table", "code"]).select("query_id", "class").distinct()
    both = pairs.join(classes, "class").join(queries.withColumnRenamed("embedding", "wanted"), "query_id")
    found = both.select("query_id", "class", _squared_distance(F.col("embedding"), F.col("wanted")).alias("distance"))
    best = W.partitionBy("query_id").orderBy("distance", "class")
    hits = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top_k).drop("n")
    members = kept.select("class", "id")
    last = W.partitionBy("query_id").orderBy("distance", "id")
    return (
        members.join(hits, "class")
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= top_k)
        .select("query_id", "rank", "id", "distance", distance_to_score(F.col("distance")).alias("score"))
    )


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(n_hits, n_found, recall): how many hits of an exact search another search has; equal distances count as found."""
    wanted = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max("distance").alias("limit"))
    near = found.join(wanted.select("query_id", "limit"), "query_id").where(F.col("distance") <= F.col("limit"))
    got = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found"))
    both = wanted.join(got, "query_id", "left")
    return both.agg(
        F.sum("n_hits").alias("n_hits"), F.sum(F.coalesce("n_found", F.lit(0))).alias("n_found")
    ).withColumn("recall", F.try_divide("n_found", "n_hits"))
