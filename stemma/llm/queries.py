"""Registered queries of the operators, each over its whole table, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import (
    divergence, exact_dedup, html_text, merkle, mixing, ngram_join, packing, perplexity, quality_knn, resharding, secrets,
    substring_dedup, warc,
)
from stemma.session import new_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@_query("op1_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from the votes of labelled ones."""
    docs = table(spark, sf_dir, "documents")
    voters = quality_knn.train(docs, table(spark, sf_dir, "labels"))
    return quality_knn.scored(docs, voters).drop("key")


@_query("op2_ngram_perplexity")
def ngram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures of every document and whether its perplexity lies in its language's band."""
    return perplexity.judged(table(spark, sf_dir, "documents"))


@_query("op3_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by patterns and by the ratio of two models trained on all of them."""
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.log_ratio(secrets.count_pairs(docs)))


@_query(
    "op4_warc_round_trip",
    """
    with p as (
        select page_id, coalesce(html, '') as payload from pages
    ), d as (
        select page_id, cast(octet_length(encode(payload)) as bigint) as payload_bytes, sha1(payload) as payload_digest,
               max(page_id) over (partition by payload) as largest
        from p
    )
    select page_id, payload_bytes, payload_digest,
           case when payload_bytes >= 1000 and page_id <> largest then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= 1000 and page_id <> largest then largest end as refers_to
    from d
    """,
)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back through the chain of record boundaries."""
    path = new_folder(spark, "warc-archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_records(spark, path, payloads=False))


@_query(
    "op5_exact_dedup",
    """
    with n as (
        select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm
        from documents
    ), g as (
        select norm, max(doc_id) as keep_id, count(*) as group_size from n group by norm
    )
    select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.norm) as text_sha256
    from n join g using (norm)
    """,
)
def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents; the largest id stays."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@_query("op6_substring_dedup")
def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each document that other documents have too, and what would be removed."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("key")


@_query("op7_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_texts(table(spark, sf_dir, "pages"))


@_query("op8_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document at five words and a similarity of 0.8."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).drop("key", "component")


@_query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


@_query("op10_mix_sources", mixing.comparison_sql())
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % takes from each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


@_query("op11_merkle_manifest", merkle.comparison_sql())
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether its (for half of them changed) text folds to the root."""
    docs = table(spark, sf_dir, "documents")
    return merkle.verified(merkle.manifest(docs, shown=merkle.without_line_ends(docs)))


@_query("op12_source_divergence", divergence.comparison_sql())
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ in their words, and which words mark a source."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@_query("op13_flow_resharding")
def flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a layout of 32 shards, brought to 40 of near equal bytes and read back from its files."""
    docs = table(spark, sf_dir, "documents")
    rows = resharding.resharded(docs, new_folder(spark, "shards"), old_shards=32, new_shards=40)
    return rows.select(
        "row.doc_id", "size", F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
