"""The whole refresh: documents in, vectors, edges, assets and scores stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.operators import documents as D
from stemma.operators import graph as G
from stemma.operators import store as ST
from stemma.operators.search import hashed_words
from stemma.schemas import ASSETS, EDGES
from stemma.session import materialize
from stemma.sources import snapshots as SN


def document_vectors(docs: DataFrame) -> DataFrame:
    """Vector records of stored documents, one per id, with all metadata as a flat text map.

    Lists and structs are JSON text and nulls are dropped; the document's own columns win over fields of that name.
    """
    described = ["asset_type", "name", "owner", "description"]
    flat = ST.flatten_metadata([(c, "string") for c in described])
    docs = docs.where(F.coalesce("id", F.lit("")) != "").select("id", "text", *described, "metadata")
    docs = ST.stored_last_per_key(docs, ["id"], F.struct("text", *described, "metadata"))
    fields = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    own = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in described]))
    other = F.map_filter(fields, lambda k, v: v.isNotNull() & ~F.array_contains(own, k))
    searched = D.searched_text(F.col("text"), F.col("asset_type"), F.col("metadata")).alias("searched")
    return (
        docs.select("id", "text", F.map_concat(flat, other).alias("metadata"), searched)
        .select("id", "text", "metadata", hashed_words(F.col("searched")).cast("array<float>").alias("embedding"))
    )


def refresh_catalog(docs: DataFrame, store: str) -> DataFrame:
    """Upsert everything a set of documents implies into ``store``; returns the step counters.

    The documents are written once and read from there by every step. Nothing that
    is missing from the documents is deleted. A failing step fails the job.
    """
    spark = docs.sparkSession
    docs = materialize(docs, "documents", "zstd")

    vectors = SN.load_vector_collection(spark, store)
    SN.save_snapshot(ST.upsert(vectors, document_vectors(docs), ["id"]), store, "vectors")

    edges = SN.load_snapshot(spark, store, "edges", EDGES)
    SN.save_snapshot(ST.add_edges(edges, D.document_edges(docs)), store, "edges")
    edges = SN.load_snapshot(spark, store, "edges", EDGES)

    assets = SN.load_snapshot(spark, store, "assets", ASSETS)
    assets = ST.register_assets(assets, D.document_assets(docs), stored=True)
    SN.save_snapshot(G.recompute_impact_scores(edges, assets), store, "assets")

    scored = SN.load_snapshot(spark, store, "assets", ASSETS).agg(F.count("asset_id"))
    return D.refresh_summary(docs).withColumn("scores_updated", scored.scalar())
