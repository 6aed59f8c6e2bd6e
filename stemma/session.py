"""Session access: table readers and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """One partition per core for a scan that has fewer splits than the session has cores.

    Meant for work that costs far more than moving the row (parsing, hashing
    words). A scan with enough splits, as on a cluster, is left as it is. ``df``
    must be a plain scan or projection, whose splits are known without a job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A machine-local folder is used only on a local master with nothing
    configured, as in the tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="stemma-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder; earlier outputs are never reused."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows, in a form that Spark knows to be empty: joins with it fall away, so the other side is not shuffled."""
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(1).where(F.lit(False)).select(*nothing)


def materialize(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """Write once to the shared folder and read back; the result survives lost executors. Texts are smaller with "zstd"."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
