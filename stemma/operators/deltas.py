"""Refresh by changes: only what a batch touches is written, and scores follow from added edges alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.functions.scores import degree_score
from stemma.operators import documents as D
from stemma.operators import graph as G
from stemma.operators import store as ST
from stemma.operators.refresh import document_vectors
from stemma.schemas import ASSETS, EDGES, VECTORS
from stemma.session import empty, materialize
from stemma.sources.changelog import ChangeLog, Relation, Written, joined

#: Edges per id, kept so that scores need no edges; ids of edges that no asset has are kept too.
DEGREES = T.StructType([T.StructField("asset_id", T.StringType()), T.StructField("degree", T.LongType())])
RELATIONS = {
    "vectors": Relation(VECTORS, ("id",)),
    "edges": Relation(EDGES, tuple(EDGES.fieldNames())),
    "assets": Relation(ASSETS, ("asset_id",)),
    "degrees": Relation(DEGREES, ("asset_id",)),
}


def open_store(spark: SparkSession, folder: str) -> ChangeLog:
    return ChangeLog(spark, folder, RELATIONS)


def degree_changes(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(asset_id, change): signed number of edge ends per id; a self-loop counts at both of its ends."""
    signed = added.withColumn("sign", F.lit(1))
    if removed is not None:
        signed = signed.unionByName(removed.withColumn("sign", F.lit(-1)))
    ends = F.explode(F.array("source_asset_id", "target_asset_id")).alias("asset_id")
    return signed.select(ends, "sign").groupBy("asset_id").agg(F.sum("sign").cast("long").alias("change"))


def changed_degrees(changes: DataFrame, degrees: DataFrame) -> DataFrame:
    """The degrees of touched ids after the changes; other ids are not listed."""
    return changes.join(degrees, "asset_id", "left").select(
        "asset_id", (F.coalesce("degree", F.lit(0)) + F.col("change")).alias("degree")
    )


def refresh_by_changes(docs: DataFrame, store: ChangeLog) -> int:
    """Upsert what a set of documents implies; the new state's number.

    The same relations result as from ``refresh.refresh_catalog``, with the scores of all assets computed anew. Written
    are the rows of the batch, the edges that are really new, and the degrees and assets that they touch.
    """
    docs = materialize(docs, "documents", "zstd")
    assets, degrees = store.read("assets"), store.read("degrees")
    new_edges = _new_edges(ST.valid_edges(D.document_edges(docs)).select(*EDGES.fieldNames()).distinct(), store)
    touched = store.written("degrees", changed_degrees(degree_changes(new_edges.rows), degrees))
    incoming = D.document_assets(docs)
    ids = incoming.select("asset_id").unionByName(touched.rows.select("asset_id")).distinct()
    known_ids = materialize(assets.select("asset_id").join(ids, "asset_id", "left_semi"), "known-ids")
    stored = assets.join(known_ids, "asset_id", "left_semi") if known_ids.count() else empty(store.spark, ASSETS)
    near = ST.register_assets(stored, incoming, stored=True)
    of_id = touched.rows
    if store.met("degrees", incoming):
        untouched = incoming.select("asset_id").distinct().join(of_id, "asset_id", "left_anti")
        of_id = of_id.unionByName(degrees.join(untouched, "asset_id", "left_semi"))
    scored = (
        near.join(of_id, "asset_id", "left")
        .withColumn("impact_score", degree_score(F.col("degree")))
        .select(*ASSETS.fieldNames())
    )
    vectors = document_vectors(docs).select(*VECTORS.fieldNames())
    return store.commit({"vectors": vectors, "edges": new_edges, "degrees": touched, "assets": scored})


def _new_edges(offered: DataFrame, store: ChangeLog) -> Written:
    """The distinct edges that the store does not have, written as a part of it."""
    batch = store.written("edges", offered)
    if batch.apart_at is not None:
        return batch
    return store.written("edges", joined(batch.rows, store.read("edges"), EDGES.fieldNames(), "left_anti"))


def full_scores(store: ChangeLog) -> DataFrame:
    """Scores computed from all edges, to hold those of the changes against."""
    return G.recompute_impact_scores(store.read("edges"), store.read("assets"))
