"""Explicit schemas of every stored relation."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, _S) for n in names]


ASSETS = T.StructType(
    _strings("asset_id", "asset_type", "name", "description", "owner", "metadata")
    + [T.StructField("impact_score", T.DoubleType())]
)

EDGES = T.StructType(_strings("source_asset_id", "target_asset_id", "relationship_type"))

EDGE_STRUCT = T.StructType(_strings("source", "target", "relationship_type"))

DOCUMENTS = T.StructType(
    _strings("id", "text", "asset_type", "name", "owner", "description", "metadata")
    + [T.StructField("lineage_edges", T.ArrayType(EDGE_STRUCT))]
)

VECTORS = T.StructType(
    _strings("id", "text")
    + [
        T.StructField("metadata", T.MapType(_S, _S)),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

COLUMN_STRUCT = T.StructType(
    _strings("name", "type") + [T.StructField("nullable", T.BooleanType())] + _strings("default")
)

FOREIGN_KEY_STRUCT = T.StructType(
    _strings("column", "references", "foreign_column", "source", "target", "relationship_type")
)

ETL_JOB = T.StructType(
    _strings("source", "path", "name", "description", "owner", "schedule")
    + [
        T.StructField(n, T.ArrayType(_S))
        for n in ("sources", "targets", "transformations", "dependencies", "dependency_ids")
    ]
)
