"""Bulk work on columns of SQL texts and of model replies.

Each function adds columns step by step, so a costly expression (masking,
lower-casing, cutting) is evaluated once per row and reused by the next step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions import sql_rules as R
from stemma.functions.text import first_filled, strip

SAFE_CONFIDENCE = 0.8
PREVIEW_CHARS = 300


def parse_sql_texts(df: DataFrame, sql: str = "sql", default_schema: str = "public") -> DataFrame:
    """Adds tables, columns, joins, filters, aggregations, subqueries, statement_type, description.

    filters, aggregations and subqueries are part of the shape and always empty.
    """
    nothing = F.array().cast("array<string>")
    kind = F.when(F.col(sql) == "", F.lit("QUERY")).otherwise(F.col("statement_type"))
    return (
        df.withColumn("_plain", R.without_literals(F.col(sql)))
        .withColumn("_masked", R.resolved_lists(F.col("_plain")))
        .withColumn("statement_type", R.statement_type(F.col("_masked")))
        .withColumn("tables", R.extract_tables(F.col("_masked"), default_schema))
        .withColumn("joins", R.extract_joins(F.col("_masked"), default_schema))
        .withColumn("columns", R.select_columns(F.col("_masked"), F.col("statement_type")))
        .withColumn("filters", nothing)
        .withColumn("aggregations", nothing)
        .withColumn("subqueries", nothing)
        .withColumn("transformation_description", R.describe_sql(kind, F.col("tables")))
        .drop("_plain", "_masked")
    )


def validate_sql_texts(df: DataFrame, sql: str = "sql", allowed: str | None = None) -> DataFrame:
    """Adds ``valid`` and ``reason`` ('' when valid). ``allowed`` names an array column."""
    permitted = F.col(allowed) if allowed else None
    return (
        df.withColumn("_lowered", F.lower(sql))
        .withColumn("_reason", R.invalid_reason(F.col(sql), F.col("_lowered"), permitted))
        .withColumn("valid", F.col("_reason").isNull())
        .withColumn("reason", F.coalesce("_reason", F.lit("")))
        .drop("_lowered", "_reason")
    )


def extract_sql_from_texts(df: DataFrame, text: str = "reply") -> DataFrame:
    """Adds ``sql`` and ``explanation`` cut out of free-text replies."""
    fence = r"(?isU)```(?:sql)?\s*\n?(.*?)```"
    at_word = r"(?iU)\b(?:WITH|SELECT|INSERT|UPDATE)\b"
    c = F.col
    return (
        df.withColumn("_body", strip(F.coalesce(c(text), F.lit(""))))
        .withColumn("_cut", F.locate("EXPLANATION:", F.upper(c("_body"))))
        .withColumn(
            "explanation",
            F.when(c("_cut") > 0, strip(F.substr("_body", c("_cut") + 12))).otherwise(F.lit("")),
        )
        .withColumn(
            "sql",
            F.when(c("_cut") > 0, F.substr("_body", F.lit(1), c("_cut") - 1)).otherwise(c("_body")),
        )
        # the first fenced block, else the whole part without back-ticks
        .withColumn(
            "sql",
            F.when(c("sql").rlike(fence), strip(F.regexp_extract("sql", fence, 1))).otherwise(
                strip(strip(strip(c("sql")), "`"))
            ),
        )
        .withColumn(
            "sql",
            F.when(
                F.startswith(F.lower("sql"), F.lit("sql\n")), strip(F.substr("sql", F.lit(5)))
            ).otherwise(c("sql")),
        )
        # prose in front of the first statement word goes
        .withColumn("_start", F.regexp_instr("sql", F.lit(at_word)))
        .withColumn(
            "sql",
            F.when(c("_start") > 0, strip(F.substr("sql", c("_start")))).otherwise(c("sql")),
        )
        # and everything after the first semicolon
        .withColumn("_semicolon", F.locate(";", c("sql")))
        .withColumn(
            "sql",
            F.when(c("_semicolon") > 0, F.substr("sql", F.lit(1), c("_semicolon"))).otherwise(c("sql")),
        )
        .drop("_body", "_cut", "_start", "_semicolon")
    )


def reply_results(df: DataFrame, text: str = "reply", allowed: str | None = None) -> DataFrame:
    """Adds query, confidence, explanation; an unsafe reply gives no SQL but a preview."""
    checked = validate_sql_texts(extract_sql_from_texts(df, text), "sql", allowed)
    shown = F.coalesce(first_filled(F.col("sql"), F.col(text)), F.lit(""))
    preview = F.replace(F.substring(shown, 1, PREVIEW_CHARS), F.lit("\n"), F.lit(" "))
    refused = F.concat(
        F.lit("Safety check failed: "), "reason", F.lit(". Model output preview: "), preview
    )
    return (
        checked.withColumn("query", F.when(F.col("valid"), F.col("sql")).otherwise(F.lit("")))
        .withColumn("confidence", F.when(F.col("valid"), SAFE_CONFIDENCE).otherwise(0.0))
        .withColumn("explanation", F.when(F.col("valid"), F.col("explanation")).otherwise(refused))
        .drop("sql", "valid", "reason")
    )
