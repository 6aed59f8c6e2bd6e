"""A training corpus from raw documents: quality, exact and near copies, mixing, packing.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the docs of
the next one. All but the last return the columns of ``docs``. An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import exact_dedup, mixing, ngram_join, packing, quality_knn
from stemma.llm.common import row_key, stored
from stemma.session import table


def _kept(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and text ``wanted`` (doc_id, key) names; of repeated rows, one."""
    named = wanted.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("id"), row_key(F.col("doc_id"), F.col("text")).alias("key"))
    same = (F.col("key") == F.col("of_key")) & F.col("id").eqNullSafe(F.col("of"))
    return keyed.join(named, same, "left_semi").dropDuplicates(["key", "id"]).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not predict as label 0; repeated rows stay."""
    voters = quality_knn.train(docs, table(spark, sf_dir, "labels"))
    return quality_knn.predicted_rows(docs, voters)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    found = exact_dedup.exact_duplicates(docs, keep="largest").where("kept").select(
        F.col("doc_id").alias("of"), F.col("text_sha256").alias("of_sha")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(
        row, F.col("doc_id").alias("id"), F.sha2(exact_dedup.normalised(F.col("text")), 256).alias("sha")
    )
    same = (F.col("sha") == F.col("of_sha")) & F.col("id").eqNullSafe(F.col("of"))
    return keyed.join(found, same, "left_semi").dropDuplicates(["sha", "id"]).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar n-gram sets connect, the one with the smallest id; texts without words stay.

    A null id counts as larger than any other; rows of one id are told apart by their text.
    """
    found = stored(ngram_join.similar_documents(docs), "near-found")
    alone = found.where("n_links = 0").select("doc_id", "key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    grouped = found.where("n_links > 0").groupBy("component").agg(first)
    return _kept(docs, alone.unionByName(grouped.select("first.doc_id", "first.key")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document lies in the packed sequences."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: The stages train models and count links, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
