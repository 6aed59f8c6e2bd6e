"""Incremental refresh: new SQL files reach the stores as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemma.functions.text import relative_to, strip
from stemma.operators.documents import sql_documents
from stemma.operators.refresh import refresh_catalog


def stream_sql_files(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """A stream of (source, sql) rows, one per new .sql file."""
    text = (
        spark.readStream.schema("value string")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.sql")
        .format("text")
        .load(folder)
    )
    return text.select(
        relative_to(F.col("_metadata.file_path"), root).alias("source"),
        strip(F.col("value")).alias("sql"),
    )


def stream_refresh(files: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Run the refresh for every batch of new files, then stop when none is left.

    All steps are upserts by id, so a batch that is replayed after a failure
    leaves the same state.
    """

    def apply(batch: DataFrame, _: int) -> None:
        refresh_catalog(sql_documents(batch), store)

    return (
        files.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
