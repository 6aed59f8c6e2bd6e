"""Prompt texts and the common result shape of generated queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions.text import first_filled

# The system prompt sent with every question.
SYSTEM_PROMPT = (
    "You are an expert SQL generator for PostgreSQL. "
    "Use only tables and columns that appear in the provided data catalog context. "
    "If context is insufficient, prefer a conservative SELECT with explicit column names. "
    "Produce a single valid SQL statement. "
    "Respond with the SQL only, optionally followed by a short explanation prefixed with "
    "'EXPLANATION:'."
)
# The two headings of the user prompt.
CONTEXT_HEADING = "Data catalog context (relevant tables, columns, and assets):\n\n"
REQUEST_HEADING = "\n\nUser request: "


def normalize_result(
    sql: Column,
    query: Column,
    confidence: Column,
    explanation: Column,
    tables_used: Column,
) -> Column:
    """One result shape with defaults for whatever the reply left out."""
    return F.struct(
        F.coalesce(first_filled(sql, query), F.lit("")).alias("sql"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence"),
        F.coalesce(explanation, F.lit("")).alias("explanation"),
        F.coalesce(tables_used, F.array().cast("array<string>")).alias("tables_used"),
    )


def prompt_messages(question: Column, context: Column) -> Column:
    """System and user message; the context block is left out when empty."""
    user = F.when(
        F.coalesce(context, F.lit("")) != "",
        F.concat(F.lit(CONTEXT_HEADING), context, F.lit(REQUEST_HEADING), question),
    ).otherwise(question)
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
