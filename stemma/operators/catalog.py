"""Catalog browsing: lookups, filters, summary, display lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions.scores import asset_label
from stemma.functions.text import blank_to_null

# How many entries the display lists show.
BULLETS, TABLES_SHOWN, JOBS_SHOWN = 12, 25, 15
HIT_CHARS, DESCRIPTION_CHARS = 1500, 400


def asset_lookup(ids: DataFrame, assets: DataFrame) -> DataFrame:
    """Exact id to asset; an unknown id keeps a row without attributes."""
    return ids.join(assets, "asset_id", "left")


def _has(column: str, pattern: str):
    """Case-insensitive substring; '%' and '_' have no special meaning."""
    return F.contains(F.lower(column), F.lit(pattern.lower()))


def _owner_has(owner: str):
    """Owner substring; a null owner reads as the text 'None'."""
    return F.contains(F.lower(F.coalesce("owner", F.lit("None"))), F.lit(owner.lower()))


def list_tables(assets: DataFrame, pattern: str | None = None) -> DataFrame:
    tables = assets.where(F.col("asset_type") == "table")
    if pattern:
        tables = tables.where(
            F.coalesce(_has("name", pattern), F.lit(False)) | _has("asset_id", pattern)
        )
    return tables


def list_reports(assets: DataFrame, owner: str | None = None) -> DataFrame:
    reports = assets.where(F.col("asset_type") == "report")
    return reports.where(_owner_has(owner)) if owner else reports


def list_etl_processes(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("asset_type") == "etl")


def search_by_owner(assets: DataFrame, owner: str) -> DataFrame:
    return assets.where(_owner_has(owner))


def catalog_summary(assets: DataFrame) -> DataFrame:
    """Total and count per known type; other types count only in the total."""

    def of(kind: str):
        return F.coalesce(F.sum(F.when(F.col("asset_type") == kind, 1).otherwise(0)), F.lit(0))

    return assets.agg(
        F.count(F.lit(1)).alias("total_assets"),
        of("table").alias("tables"),
        of("view").alias("views"),
        of("report").alias("reports"),
        of("sql").alias("sql_assets"),
        of("etl").alias("etl_processes"),
    ).withColumn("last_refresh", F.lit(None).cast("timestamp"))


def catalog_cube(assets: DataFrame) -> DataFrame:
    """Assets, those with a score and the highest score by every combination of type, owner and schema, in one pass.

    ``level`` has a bit per left-out column (4: type, 2: owner, 1: schema), so a null owner is told from all owners.
    The schema is what stands before the first dot of the id; an id without a dot has none.
    """
    has_schema = F.contains("asset_id", F.lit("."))
    named = assets.withColumn("schema", F.when(has_schema, F.substring_index("asset_id", ".", 1)))
    return named.cube("asset_type", "owner", "schema").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("assets"),
        F.count_if(F.coalesce("impact_score", F.lit(0.0)) > 0).alias("scored"),
        F.max(F.coalesce("impact_score", F.lit(0.0))).alias("max_score"),
    )


def hit_projection(hits: DataFrame) -> DataFrame:
    """Search hits in their public shape; a hit without id shows its text as the asset."""
    return hits.select(
        *[c for c in hits.columns if c not in ("id", "text", "score", "metadata")],
        F.coalesce(blank_to_null(F.col("id")), F.coalesce("text", F.lit(""))).alias("data_asset"),
        F.col("text").alias("description"),
        F.col("score").alias("relevance_score"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        F.lit(None).cast("string").alias("sql_context"),
        F.lit(None).cast("string").alias("impact_info"),
    )


def bullet_lines(ids: DataFrame, neighbours: DataFrame, limit: int = BULLETS) -> DataFrame:
    """First ``limit`` neighbours per asset as list lines, then how many more there are.

    Rows: (asset_id, position, line). The per-asset rank is cut inside each task
    before the shuffle, so a hub sends ``limit`` rows per task and not its whole list.
    """
    ranked = W.partitionBy("asset_id").orderBy("neighbour_id", "relationship_type")
    shown = (
        neighbours.withColumn("position", F.row_number().over(ranked))
        .where(F.col("position") <= limit)
        .select(
            "asset_id",
            "position",
            F.concat(
                F.lit("- `"), "neighbour_id", F.lit("`"),
                F.when(F.coalesce("asset_type", F.lit("")) != "",
                       F.concat(F.lit(" ("), "asset_type", F.lit(")"))).otherwise(F.lit("")),
            ).alias("line"),
        )
    )
    counts = neighbours.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    rest = (
        ids.select("asset_id").distinct().join(counts, "asset_id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .where((F.col("n") == 0) | (F.col("n") > limit))
        .select(
            "asset_id",
            F.when(F.col("n") == 0, 1).otherwise(limit + 1).alias("position"),
            F.when(F.col("n") == 0, F.lit("- (none)"))
            .otherwise(F.concat(F.lit("- … and "), (F.col("n") - limit).cast("string"), F.lit(" more")))
            .alias("line"),
        )
    )
    return shown.join(ids.select("asset_id").distinct(), "asset_id", "left_semi").unionByName(rest)


def _first_ids(rows: DataFrame, limit: int, section: str) -> DataFrame:
    first = rows.select(F.coalesce("asset_id", "name", F.lit("?")).alias("shown")).orderBy("shown").limit(limit)
    return first.select(F.lit(section).alias("section"), F.concat(F.lit("- `"), "shown", F.lit("`")).alias("line"))


def catalog_listing(assets: DataFrame, pattern: str | None = None) -> DataFrame:
    """Lines of the catalog page: figures, the first tables and the first jobs by id."""
    figures = catalog_summary(assets).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit("summary").alias("section"),
                             F.concat(F.lit(f"- **{title}:** "), F.col(c).cast("string")).alias("line"))
                    for title, c in (
                        ("Total assets", "total_assets"), ("Tables", "tables"),
                        ("SQL assets", "sql_assets"), ("ETL jobs", "etl_processes"),
                    )
                ]
            )
        )
    )
    tables, jobs = list_tables(assets, pattern), list_etl_processes(assets)
    headings = (
        tables.agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.inline(
                F.array(
                    F.struct(F.lit("tables").alias("section"),
                             F.concat(F.lit("## Tables ("), F.col("n").cast("string"), F.lit(")")).alias("line")),
                    F.struct(F.lit("tables_more").alias("section"),
                             F.when(F.col("n") > TABLES_SHOWN,
                                    F.concat(F.lit("- … and "), (F.col("n") - TABLES_SHOWN).cast("string"),
                                             F.lit(" more"))).alias("line")),
                )
            )
        )
        .where(F.col("line").isNotNull())
    )
    job_heading = jobs.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("jobs").alias("section"),
        F.concat(F.lit("## ETL processes ("), F.col("n").cast("string"), F.lit(")")).alias("line"),
    )
    return (
        figures.unionByName(headings)
        .unionByName(_first_ids(tables, TABLES_SHOWN, "table"))
        .unionByName(job_heading)
        .unionByName(_first_ids(jobs, JOBS_SHOWN, "job"))
    )


def short_texts(assets: DataFrame) -> DataFrame:
    """Labels and the shortened description an expandable asset block shows."""
    return assets.select(
        "asset_id",
        asset_label(F.col("asset_id"), F.col("name"), F.col("asset_type")).alias("label"),
        F.substring(F.coalesce("description", F.lit("")), 1, DESCRIPTION_CHARS).alias("shown_description"),
    )


def hit_blocks(hits: DataFrame) -> DataFrame:
    """Heading and shortened text per search hit: (query_id, rank, block)."""
    # format_number rounds the exact binary value, as the scores are shown elsewhere.
    heading = F.concat(
        F.lit("### "), F.col("rank").cast("string"), F.lit(". "), "data_asset", F.lit(" ("),
        F.coalesce("asset_type", F.lit("asset")), F.lit(", score="),
        F.format_number("relevance_score", 3), F.lit(")\n"),
    )
    shown = F.substring(F.coalesce("description", F.lit("")), 1, HIT_CHARS)
    return hits.select("query_id", "rank", F.concat(heading, shown).alias("block"))
