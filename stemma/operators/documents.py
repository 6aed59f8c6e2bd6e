"""Documents of tables, SQL texts and jobs, and what a refresh derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions import etl_rules as E
from stemma.functions.text import blank_to_null, first_filled, slashes, strip
from stemma.operators import store
from stemma.operators.sql_texts import parse_sql_texts
from stemma.schemas import DOCUMENTS, EDGE_STRUCT

#: Characters of the SQL shown in a document's text, and of a text shown as description; arguments of the functions below.
SQL_CHARS = 2000
DESCRIPTION_CHARS = 500
#: What stands before the SQL in a document's text.
SQL_MARK = "SQL: "


def _sentence(condition: Column, *parts) -> Column:
    """Text when the condition holds, else null (which concat_ws leaves out)."""
    return F.when(condition, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def _edges(items: Column, make) -> Column:
    return F.transform(items, make).cast(f"array<{EDGE_STRUCT.simpleString()}>")


def _as_document(df: DataFrame) -> DataFrame:
    return df.select(*DOCUMENTS.fieldNames())


def table_documents(tables: DataFrame, default_owner: str = "unknown") -> DataFrame:
    """One document per row of ``assemble_table_metadata``."""
    columns, keys, fks = F.col("columns"), F.col("primary_keys"), F.col("foreign_keys")
    asset_id = F.concat("table_schema", F.lit("."), "table_name")
    detail = F.transform(
        columns,
        lambda c: F.concat(
            c["name"], F.lit(" ("), c["type"], F.lit(")"),
            F.when(c["nullable"], F.lit(" nullable")).otherwise(F.lit("")),
            F.coalesce(F.concat(F.lit(" default="), blank_to_null(c["default"])), F.lit("")),
        ),
    )
    references = F.transform(
        fks,
        lambda k: F.concat(k["column"], F.lit(" -> "), k["references"], F.lit("."), k["foreign_column"]),
    )
    text = F.concat_ws(
        " ",
        F.concat(
            F.lit("Table "), asset_id, F.lit(": "),
            F.coalesce(blank_to_null(F.col("description")), F.lit("No description")), F.lit("."),
        ),
        _sentence(F.size(keys) > 0, "Primary keys: ", F.array_join(keys, ", "), "."),
        _sentence(F.size(fks) > 0, "Foreign keys: ", F.array_join(references, "; "), "."),
        _sentence(
            F.size(columns) > 0,
            "Columns: ", F.array_join(F.transform(columns, lambda c: c["name"]), ", "), ".",
        ),
        _sentence(F.size(columns) > 0, "Details: ", F.array_join(detail, "; "), "."),
    )
    return _as_document(
        tables.select(
            asset_id.alias("id"),
            strip(text).alias("text"),
            F.lit("table").alias("asset_type"),
            F.coalesce("name", asset_id).alias("name"),
            F.coalesce(blank_to_null(F.col("owner")), F.lit(default_owner)).alias("owner"),
            F.coalesce("description", F.lit("")).alias("description"),
            F.to_json(
                F.struct("table_schema", "table_name", "columns", "primary_keys", "foreign_keys")
            ).alias("metadata"),
            _edges(
                fks,
                lambda k: F.struct(
                    k["source"].alias("source"),
                    k["target"].alias("target"),
                    k["relationship_type"].alias("relationship_type"),
                ),
            ).alias("lineage_edges"),
        )
    )


def sql_documents(
    files: DataFrame, default_owner: str = "unknown", default_schema: str = "public", shown_chars: int = SQL_CHARS
) -> DataFrame:
    """One document per (source, sql) row; each referenced table feeds the SQL asset.

    The text shows ``shown_chars`` of the SQL; the metadata holds all of it, and :func:`searched_text` too.
    """
    parsed = (
        files.select(slashes(F.col("source")).alias("source"), strip(F.col("sql")).alias("sql"))
        .where(F.col("sql") != "")
        .transform(parse_sql_texts, "sql", default_schema)
        .withColumn("id", F.concat(F.lit("sql:"), "source"))
    )
    join_list = F.transform("joins", lambda j: F.concat(j["join_type"], F.lit(" "), j["table"]))
    text = F.concat_ws(
        " ",
        F.concat(F.lit("SQL asset "), "source", F.lit(": "), "transformation_description", F.lit(".")),
        F.concat(F.lit("Statement type: "), "statement_type", F.lit(".")),
        _sentence(F.size("tables") > 0, "Tables: ", F.array_join("tables", ", "), "."),
        _sentence(F.size("joins") > 0, "Joins: ", F.array_join(join_list, "; "), "."),
        F.concat(F.lit(SQL_MARK), F.substring("sql", 1, shown_chars)),
    )
    return _as_document(
        parsed.select(
            "id",
            strip(text).alias("text"),
            F.lit("sql").alias("asset_type"),
            F.col("source").alias("name"),
            F.lit(default_owner).alias("owner"),
            F.col("transformation_description").alias("description"),
            F.to_json(F.struct("source", "tables", "joins", "sql")).alias("metadata"),
            _edges(
                F.col("tables"),
                lambda t: F.struct(
                    t.alias("source"),
                    F.col("id").alias("target"),
                    F.lit("sql_reference").alias("relationship_type"),
                ),
            ).alias("lineage_edges"),
        )
    )


def etl_documents(jobs: DataFrame, default_owner: str = "unknown") -> DataFrame:
    """One document per job of ``scan_etl_configs``, with source, target and dependency edges."""
    named = (
        jobs.withColumn("source", slashes(F.col("source")))
        .withColumn("id", F.concat(F.lit("etl:"), "source", F.lit("#"), "name"))
        .withColumn("_doc", E.job_documentation())
    )
    text = F.concat_ws(
        " ",
        F.concat(F.lit("ETL asset "), "name", F.lit(" ("), "source", F.lit("): "), "_doc"),
        _sentence(
            F.size("dependencies") > 0, "Dependencies: ", F.array_join("dependencies", ", "), "."
        ),
    )
    return _as_document(
        named.select(
            "id",
            strip(text).alias("text"),
            F.lit("etl").alias("asset_type"),
            "name",
            F.coalesce(blank_to_null(F.col("owner")), F.lit(default_owner)).alias("owner"),
            F.coalesce("description", "_doc").alias("description"),
            F.to_json(
                F.struct("source", "sources", "targets", "transformations", "schedule", "dependencies")
            ).alias("metadata"),
            E.job_edges(F.col("id")).alias("lineage_edges"),
        )
    )


def build_documents(*parts: DataFrame) -> DataFrame:
    """All documents as one relation."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def counts_by_type(docs: DataFrame) -> DataFrame:
    """Document count per type; the three ingested types only."""
    return (
        docs.where(F.col("asset_type").isin("table", "sql", "etl"))
        .groupBy("asset_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# ---- what a refresh derives ---------------------------------------------------


def searched_text(text: Column, asset_type: Column, metadata: Column) -> Column:
    """What of a document is embedded: its text, for SQL with the whole statement in place of the shown part."""
    sql = F.get_json_object(metadata, "$.sql")
    whole = F.concat(F.substring_index(text, SQL_MARK, 1), F.lit(SQL_MARK), sql)
    return F.when((asset_type == "sql") & sql.isNotNull() & F.contains(text, F.lit(SQL_MARK)), whole).otherwise(text)


def document_assets(docs: DataFrame, shown_chars: int = DESCRIPTION_CHARS) -> DataFrame:
    """Asset rows of documents, with the defaults for whatever is missing.

    A document without a description is described by ``shown_chars`` of its text.
    """
    return docs.where(F.coalesce("id", F.lit("")) != "").select(
        F.col("id").alias("asset_id"),
        F.coalesce("asset_type", F.lit("document")).alias("asset_type"),
        F.coalesce("name", "id").alias("name"),
        first_filled(F.col("description"), F.substring("text", 1, shown_chars)).alias("description"),
        F.coalesce("owner", F.lit("unknown")).alias("owner"),
        "metadata",
    )


def document_edges(docs: DataFrame) -> DataFrame:
    """All accepted edges of documents, copies included.

    Lineage edges without a type count as foreign keys. A document may also carry
    one pair in the columns source_asset_id, target_asset_id, relationship_type;
    without a type it counts as a dependency.
    """
    listed = (
        docs.where(F.coalesce("id", F.lit("")) != "")
        .select(F.explode("lineage_edges").alias("e"))
        .select(
            F.col("e.source").alias("source_asset_id"),
            F.col("e.target").alias("target_asset_id"),
            F.coalesce("e.relationship_type", F.lit("foreign_key")).alias("relationship_type"),
        )
    )
    if "source_asset_id" in docs.columns:
        pair = docs.where(F.coalesce("id", F.lit("")) != "").select(
            "source_asset_id",
            "target_asset_id",
            F.coalesce("relationship_type", F.lit("depends_on")).alias("relationship_type"),
        )
        listed = listed.unionByName(pair)
    return store.valid_edges(listed)


def _accepted_edges(docs: DataFrame) -> Column:
    """Number of edges ``document_edges`` takes from one document, without unfolding them."""

    def whole(source: Column, target: Column) -> Column:
        return blank_to_null(source).isNotNull() & blank_to_null(target).isNotNull()

    n = F.coalesce(F.size(F.filter("lineage_edges", lambda e: whole(e["source"], e["target"]))), F.lit(0))
    if "source_asset_id" in docs.columns:
        n = n + F.when(whole(F.col("source_asset_id"), F.col("target_asset_id")), 1).otherwise(0)
    return F.when(F.coalesce("id", F.lit("")) != "", n).otherwise(0)


def refresh_summary(docs: DataFrame) -> DataFrame:
    """Step counters of a refresh, one row, from one pass over the documents.

    ``tables_updated`` counts all documents and ``relationships_added`` every
    accepted edge, copies included, as the step report defines them.
    """

    def of(kind: str) -> Column:
        return F.count_if(F.col("asset_type") == kind)

    return docs.agg(
        F.count(F.lit(1)).alias("tables_updated"),
        F.count(F.lit(1)).alias("records_processed"),
        of("etl").alias("etl_processes_parsed"),
        of("sql").alias("sql_queries_parsed"),
        F.count(F.lit(1)).alias("embeddings_generated"),
        F.count(F.lit(1)).alias("documents_added"),
        F.count_if(F.coalesce("id", F.lit("")) != "").alias("assets_registered"),
        F.coalesce(F.sum(_accepted_edges(docs)), F.lit(0)).alias("relationships_added"),
    )
