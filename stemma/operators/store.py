"""Maintenance of the stored relations: upsert, delete, register, scores.

Every function returns the whole new state; ``sources.snapshots`` writes it to a
fresh folder, so a relation is never overwritten while it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import blank_to_null, first_filled
from stemma.schemas import EDGES, VECTORS
from stemma.session import materialize


def normalize_documents(docs: DataFrame) -> DataFrame:
    """id = id, doc_id or a generated one; text = text, content or ''; metadata as text map.

    Accepts any subset of the columns id, doc_id, text, content, metadata; without
    metadata all other columns become it. A document without an id gets one from
    its content, so a repeated run replaces it instead of adding a copy.
    """
    has = set(docs.columns)

    def col(name: str) -> Column:
        return F.col(name).cast("string") if name in has else F.lit(None).cast("string")

    text = F.coalesce(first_filled(col("text"), col("content")), F.lit(""))
    other = [c for c in docs.columns if c not in ("id", "doc_id", "text", "content", "metadata")]
    pairs = [x for c in other for x in (F.lit(c), F.col(c).cast("string"))]
    rest = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    if "metadata" in has:
        given = F.when(F.size("metadata") > 0, F.col("metadata"))
        rest = F.coalesce(given, rest)
    out = docs.select(
        F.coalesce(
            first_filled(col("id"), col("doc_id")), F.concat(F.lit("doc-"), F.md5(text))
        ).alias("id"),
        text.alias("text"),
        F.map_filter(rest, lambda k, v: v.isNotNull()).alias("metadata"),
        *([F.col("embedding")] if "embedding" in has else []),
    )
    return out


def flatten_metadata(columns: Sequence[tuple[str, str]]) -> Column:
    """Flat text map of named columns: nulls dropped, lists and structs as JSON text.

    ``columns`` holds (name, Spark type name) pairs as in ``DataFrame.dtypes``.
    """
    pairs: list[Column] = []
    for name, kind in columns:
        nested = kind.startswith(("array", "struct", "map", "variant"))
        value = F.to_json(F.col(name)) if nested else F.col(name).cast("string")
        pairs += [F.lit(name), value]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; the rest stays.

    ``new`` must hold each key once. One full outer join moves each side once.
    """
    names = [c for c in old.columns if c not in keys]
    n = new.select(*keys, F.struct(*[F.col(c) for c in names]).alias("_new"))
    o = old.select(*keys, F.struct(*[F.col(c) for c in names]).alias("_old"))
    both = o.join(n, list(keys), "full_outer")
    return both.select(*keys, F.coalesce("_new", "_old").alias("_row")).select(*keys, "_row.*")


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the one with the highest order value.

    An aggregate, not a window: copies of one key are reduced before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), order)
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def stored_last_per_key(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """As ``last_per_key`` for stored rows, of which only those whose key may come again are moved.

    Hashes of the keys tell which may; two keys with one hash are only looked at without need. So wide rows with
    keys that come once are neither shuffled nor sorted. The rows are read twice.
    """
    code = F.xxhash64(*keys).alias("_code")
    again = materialize(rows.select(code).groupBy("_code").count().where("count > 1").select("_code"), "repeated-keys")
    if not again.count():
        return rows
    coded, marks = rows.withColumn("_code", code), again.withColumn("_again", F.lit(True))
    # One join tells the two kinds apart; where few keys come again, nothing else is moved either.
    marked = coded.join(marks, "_code", "left").drop("_code")
    once = marked.where(F.col("_again").isNull()).drop("_again")
    return once.unionByName(last_per_key(marked.where("_again").drop("_again"), keys, order))


def upsert_documents(old: DataFrame, docs: DataFrame) -> DataFrame:
    """Insert or replace documents by id; the same id twice in one batch keeps one copy."""
    new = normalize_documents(docs)
    rest = [F.col(c) for c in new.columns if c not in ("id", "metadata")]
    return upsert(old, last_per_key(new, ["id"], F.struct(*rest)), ["id"])


def update_document_metadata(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Set metadata entries of known ids; other entries stay, unknown ids are ignored."""
    change = last_per_key(changes.select("id", "metadata"), ["id"], F.to_json("metadata"))
    change = change.withColumnRenamed("metadata", "_new")
    merged = F.when(
        F.col("_new").isNotNull(),
        F.map_concat(
            F.map_filter("metadata", lambda k, v: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False))),
            F.col("_new"),
        ),
    ).otherwise(F.col("metadata"))
    return old.join(change, "id", "left").withColumn("metadata", merged).drop("_new").select(*old.columns)


def delete_documents(old: DataFrame, ids: DataFrame) -> DataFrame:
    return old.join(ids.select("id"), "id", "left_anti")


def clear_documents(old: DataFrame) -> DataFrame:
    """An empty relation with the same schema."""
    return old.sparkSession.createDataFrame([], old.schema if old.columns else VECTORS)


def register_assets(old: DataFrame, new: DataFrame, stored: bool = False) -> DataFrame:
    """Upsert by asset_id; new attributes win, the stored score stays (0.0 for a new asset).

    Of several new rows with one id a single one is kept, chosen by its values. ``stored`` tells that ``new`` can be read twice
    at little cost.
    """
    attributes = [c for c in old.columns if c not in ("asset_id", "impact_score")]
    incoming = new.where(F.coalesce("asset_id", F.lit("")) != "").select("asset_id", *attributes)
    incoming = (stored_last_per_key if stored else last_per_key)(incoming, ["asset_id"], F.struct(*attributes))
    n = incoming.select("asset_id", F.struct(*attributes).alias("_new"))
    o = old.select("asset_id", "impact_score", F.struct(*attributes).alias("_old"))
    return (
        o.join(n, "asset_id", "full_outer")
        .select(
            "asset_id",
            F.coalesce("_new", "_old").alias("_row"),
            F.coalesce("impact_score", F.lit(0.0)).alias("impact_score"),
        )
        .select("asset_id", "_row.*", "impact_score")
        .select(*old.columns)
    )


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges with both endpoints."""
    return edges.where(
        blank_to_null(F.col("source_asset_id")).isNotNull()
        & blank_to_null(F.col("target_asset_id")).isNotNull()
    )


def add_edges(old: DataFrame, new: DataFrame, tasks: int | None = None) -> DataFrame:
    """Union without copies of a (source, target, type) triple.

    ``tasks`` fixes over how many tasks the triples are dealt, for inputs of known size; else Spark decides.
    """
    names = EDGES.fieldNames()
    both = old.select(*names).unionByName(valid_edges(new).select(*names))
    return (both.repartition(tasks, *names) if tasks else both).dropDuplicates(names)


def update_impact_scores(old: DataFrame, scores: DataFrame) -> DataFrame:
    """Set the score of known ids; unknown ids are ignored, of several scores the highest counts."""
    new = scores.groupBy("asset_id").agg(F.max("impact_score").alias("_score"))
    return (
        old.join(new, "asset_id", "left")
        .withColumn("impact_score", F.coalesce("_score", "impact_score"))
        .drop("_score")
        .select(*old.columns)
    )
