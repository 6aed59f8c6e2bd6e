"""Which asset a free-text change description is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import blank_to_null, change_table_ref, strip

# How a change text names its table.
ON_TABLE = r"(?iU)\bon\s+((?:[a-z][a-z0-9_]+\.)?[a-z][a-z0-9_]+)\b"
TO_TABLE = r"(?iU)\bto\s+([a-z][a-z0-9_]+\.[a-z][a-z0-9_]+)\b"
QUALIFIED_TABLE = r"(?iU)\b([a-z][a-z0-9_]*\.[a-z][a-z0-9_]+)\b"


def extract_change_target(text: Column, default_schema: str = "public") -> Column:
    """Table after 'on', else ``schema.table`` after 'to', else the last qualified name."""
    named = F.coalesce(
        blank_to_null(F.regexp_extract(text, ON_TABLE, 1)),
        blank_to_null(F.regexp_extract(text, TO_TABLE, 1)),
        F.try_element_at(F.regexp_extract_all(text, F.lit(QUALIFIED_TABLE), F.lit(1)), F.lit(-1)),
    )
    return change_table_ref(named, default_schema)


def differs_warning(typed: Column, inferred: Column) -> Column:
    """Warning text when the field names another asset than the change text."""
    differs = inferred.isNotNull() & (typed != "") & (F.lower(typed) != F.lower(inferred))
    return F.when(
        differs,
        F.concat(
            F.lit("Asset id field was `"), typed,
            F.lit("` but the proposed change targets `"), inferred,
            F.lit("` — analysis uses **"), inferred, F.lit("**."),
        ),
    )


def resolve_change_targets(
    df: DataFrame,
    field: str = "field_asset",
    text: str = "change_text",
    default_schema: str = "public",
) -> DataFrame:
    """Adds asset_id ('' when unknown), inferred_asset, source and warning.

    The change text beats the field. The patterns run once per row: their result
    is a column before anything refers to it.
    """
    typed, inferred = F.col("_typed"), F.col("inferred_asset")
    return (
        df.withColumn("_typed", strip(F.coalesce(field, F.lit(""))))
        .withColumn("inferred_asset", extract_change_target(F.col(text), default_schema))
        .withColumn("asset_id", F.coalesce(inferred, typed))
        .withColumn("source", F.when(inferred.isNotNull(), F.lit("change_text")).otherwise(F.lit("field")))
        .withColumn("warning", differs_warning(typed, inferred))
        .drop("_typed")
    )
