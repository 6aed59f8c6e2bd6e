"""Warehouse catalog: tables, columns, comments, keys, and the nested row per table.

The functions take the catalog relations as DataFrames: over JDBC from the
warehouse's information schema, or from an exported copy. Relations:
tables, columns, classes, namespaces, constraints, key_usage, constraint_usage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.schemas import COLUMN_STRUCT, FOREIGN_KEY_STRUCT

# Schemas that are never ingested.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")

# Where the catalog relations live in a PostgreSQL warehouse.
JDBC_RELATIONS = {
    "tables": "information_schema.tables",
    "columns": "information_schema.columns",
    "constraints": "information_schema.table_constraints",
    "key_usage": "information_schema.key_column_usage",
    "constraint_usage": "information_schema.constraint_column_usage",
    "namespaces": "(select oid::bigint as oid, nspname from pg_catalog.pg_namespace) n",
    "classes": (
        "(select oid::bigint as oid, relname, relnamespace::bigint as relnamespace, "
        "relkind::text as relkind, obj_description(oid, 'pg_class') as description "
        "from pg_catalog.pg_class) c"
    ),
}


def read_catalog(spark: SparkSession, url: str, properties: dict[str, str]) -> dict[str, DataFrame]:
    """The catalog relations over JDBC; filters of the scans below are pushed to the warehouse.

    Rows come in portions of ``fetchsize``, so that no reader holds a whole relation.
    """
    return {
        name: spark.read.jdbc(url, relation, properties={"fetchsize": "10000", **properties})
        for name, relation in JDBC_RELATIONS.items()
    }


def run_sql(spark: SparkSession, text: str, relations: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a SQL text; ``{name}`` in it stands for a relation. A command gives an empty relation."""
    return spark.sql(text, **(relations or {}))


def scan_base_tables(
    tables: DataFrame,
    schemas: Sequence[str] | None = None,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Base tables outside the system schemas, without the excluded qualified names."""
    kept = tables.where(
        (F.col("table_type") == "BASE TABLE") & ~F.col("table_schema").isin(*SYSTEM_SCHEMAS)
    )
    if schemas:
        kept = kept.where(F.col("table_schema").isin(*schemas))
    kept = kept.select(
        "table_schema", "table_name", F.concat("table_schema", F.lit("."), "table_name").alias("qualified_name")
    )
    if exclude is not None:
        kept = kept.join(exclude.select("qualified_name"), "qualified_name", "left_anti")
    return kept


def ordered_tables(kept: DataFrame) -> DataFrame:
    """Listing order of the catalog."""
    return kept.orderBy("table_schema", "table_name")


_KEY = ["table_schema", "table_name"]


def _of_kept(rows: DataFrame, kept: DataFrame | None) -> DataFrame:
    return rows if kept is None else rows.join(kept.select(*_KEY), _KEY, "left_semi")


def scan_columns(columns: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """One row per column of the kept tables.

    Without ``kept`` all tables count; here and in the other scans that is the
    form to feed ``assemble_table_metadata``, which keeps the kept tables itself.
    """
    return _of_kept(columns, kept).select(
        *_KEY,
        "ordinal_position",
        F.col("column_name").alias("name"),
        F.col("data_type").alias("type"),
        (F.col("is_nullable") == "YES").alias("nullable"),
        F.col("column_default").alias("default"),
    )


def _comments(classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    return classes.join(
        namespaces.select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("table_schema")),
        "relnamespace",
        "inner",
    ).select("table_schema", F.col("relname").alias("table_name"), "relkind", "description")


def scan_table_comments(
    classes: DataFrame, namespaces: DataFrame, kept: DataFrame | None = None
) -> DataFrame:
    """Filled comments of ordinary tables."""
    filled = classes.where((F.col("relkind") == "r") & (F.col("description") != ""))
    return _of_kept(_comments(filled, namespaces), kept).select(*_KEY, "description")


_CONSTRAINT = ["constraint_name", "table_schema", "table_name"]


def scan_primary_keys(
    constraints: DataFrame, key_usage: DataFrame, kept: DataFrame | None = None
) -> DataFrame:
    """One row per primary key column."""
    keys = (
        constraints.where(F.col("constraint_type") == "PRIMARY KEY")
        .select(*_CONSTRAINT)
        .join(key_usage.select(*_CONSTRAINT, "column_name", "ordinal_position"), _CONSTRAINT, "inner")
    )
    return _of_kept(keys, kept).select(*_KEY, "ordinal_position", "column_name")


def scan_foreign_keys(
    constraints: DataFrame,
    key_usage: DataFrame,
    constraint_usage: DataFrame,
    kept: DataFrame | None = None,
) -> DataFrame:
    """One row per pair of key column and referenced column of a constraint.

    The referenced side is matched by constraint name and schema only, so a key of
    k columns gives k*k rows; the edges drop the copies. Each pair comes once.
    """
    used = constraint_usage.select(
        "constraint_name",
        "table_schema",
        F.concat("table_schema", F.lit("."), "table_name").alias("references"),
        F.col("column_name").alias("foreign_column"),
    ).distinct()
    pairs = (
        constraints.where(F.col("constraint_type") == "FOREIGN KEY")
        .select(*_CONSTRAINT)
        .distinct()
        .join(key_usage.select(*_CONSTRAINT, "column_name").distinct(), _CONSTRAINT, "inner")
        .join(used, ["constraint_name", "table_schema"], "inner")
    )
    return _of_kept(pairs, kept).select(
        *_KEY,
        F.col("column_name").alias("column"),
        "references",
        "foreign_column",
        F.col("references").alias("source"),
        F.concat("table_schema", F.lit("."), "table_name").alias("target"),
        F.lit("foreign_key").alias("relationship_type"),
    )


def foreign_key_edges(foreign_keys: DataFrame) -> DataFrame:
    """Edges referenced table -> referencing table, each once."""
    return foreign_keys.select(
        F.col("source").alias("source_asset_id"),
        F.col("target").alias("target_asset_id"),
        "relationship_type",
    ).distinct()


def _listed(rows: DataFrame, order: str | None, item: Column, name: str) -> DataFrame:
    """Array per table, by ``order``. The length is bounded by the columns a table can have."""
    entry = F.struct(F.col(order).alias("_o"), item.alias("v")) if order else F.struct(item.alias("v"))
    listed = F.array_sort(F.collect_list(entry))
    return rows.groupBy(*_KEY).agg(F.transform(listed, lambda x: x["v"]).alias(name))


def assemble_table_metadata(
    kept: DataFrame,
    columns: DataFrame,
    comments: DataFrame,
    primary_keys: DataFrame | None = None,
    foreign_keys: DataFrame | None = None,
    default_owner: str = "unknown",
) -> DataFrame:
    """One nested row per kept table; missing parts are empty.

    Without the key relations this is the minimal scan: columns and comment only.
    """
    column = F.struct("name", "type", "nullable", "default")
    out = kept.join(_listed(columns, "ordinal_position", column, "columns"), _KEY, "left")
    out = out.join(comments, _KEY, "left")
    if primary_keys is not None:
        out = out.join(
            _listed(primary_keys, "ordinal_position", F.col("column_name"), "primary_keys"), _KEY, "left"
        )
    else:
        out = out.withColumn("primary_keys", F.lit(None).cast("array<string>"))
    fk_type = f"array<{FOREIGN_KEY_STRUCT.simpleString()}>"
    if foreign_keys is not None:
        key = F.struct(*FOREIGN_KEY_STRUCT.fieldNames())
        out = out.join(_listed(foreign_keys, None, key, "foreign_keys"), _KEY, "left")
    else:
        out = out.withColumn("foreign_keys", F.lit(None).cast(fk_type))
    return out.select(
        *_KEY,
        F.col("qualified_name").alias("name"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.lit(default_owner or "unknown").alias("owner"),
        F.lit("table").alias("asset_type"),
        F.coalesce("columns", F.array().cast(f"array<{COLUMN_STRUCT.simpleString()}>")).alias("columns"),
        F.coalesce("primary_keys", F.array().cast("array<string>")).alias("primary_keys"),
        F.coalesce("foreign_keys", F.array().cast(fk_type)).alias("foreign_keys"),
    )


def _wanted(names: DataFrame) -> DataFrame:
    """Qualified names split at the first dot; without a dot the schema is public."""
    dot = F.instr("table_ref", ".")
    return names.select("table_ref").distinct().select(
        "table_ref",
        F.when(dot > 0, F.substr("table_ref", F.lit(1), dot - 1)).otherwise("public").alias("table_schema"),
        F.when(dot > 0, F.substr("table_ref", dot + 1)).otherwise(F.col("table_ref")).alias("table_name"),
    )


def table_schema_lookup(names: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns of the asked tables, one row per column."""
    wanted = _wanted(names)
    return columns.join(wanted, _KEY, "inner").select(
        "table_ref",
        *_KEY,
        "ordinal_position",
        F.col("column_name").alias("name"),
        F.col("data_type").alias("type"),
        (F.col("is_nullable") == "YES").alias("nullable"),
        F.col("column_default").alias("default"),
    )


def table_comment_lookup(names: DataFrame, classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Comment of the asked relations of any kind; null when there is none."""
    found = _comments(classes, namespaces).select(*_KEY, "description")
    return _wanted(names).join(found, _KEY, "left").select("table_ref", *_KEY, "description")
