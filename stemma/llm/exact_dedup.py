"""Exact duplicates by sorting content.

Rows are range-partitioned by sampled splitters on the normalised text, sorted by it, and
neighbours with equal whole texts form a group. Splitters are samples that reach the driver, so
they are cut to a prefix and a digest of the text; the sort and the comparison use all of it.

Hot texts: a text held by more than 1/``SLICES`` of all rows (fewer than ``SLICES`` texts can be)
is spread over ``SLICES`` slices by id. Each slice forms its group as any other text does; the heads of
these slices (at most ``SLICES`` squared) then meet once more, again by whole text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import stored, whole_text

SLICES = 64
#: Characters of the text in a splitter, before its digest.
PREFIX = 16


def normalised(text: Column) -> Column:
    """Null as empty, A to Z in lower case, all else as it is."""
    return F.translate(whole_text(text), string.ascii_uppercase, string.ascii_lowercase)


def _hot(rows: DataFrame) -> list[int]:
    """Digests that more than one row in ``SLICES`` has: fewer than ``SLICES`` of them."""
    counts = rows.groupBy("digest").count()
    total = rows.count()
    return [r[0] for r in counts.where(F.col("count") * SLICES > total).where("count > 1").select("digest").collect()]


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``smallest`` or ``largest``: which id of a group of equal texts stays.
    Null text counts as empty; empty texts are equal. A null id stays only where all ids of its group are
    null. Of rows with the same id and text exactly one is kept. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn(
        "digest", F.xxhash64("norm")
    )
    hot = _hot(rows)
    slice_of = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int")
    salted = rows.withColumn("prefix", F.substring("norm", 1, PREFIX)).withColumn(
        "slice", F.when(F.col("digest").isin(hot), slice_of).otherwise(-1) if hot else F.lit(-1)
    )
    wanted = F.desc_nulls_last if keep == "largest" else F.asc_nulls_last
    by_text = Window.partitionBy("prefix", "digest", "slice", "norm").orderBy(wanted("doc_id"))
    whole_group = by_text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = (
        salted.repartitionByRange("prefix", "digest", "slice")
        .select(
            "doc_id", "slice", "digest", "norm",
            F.first("doc_id").over(whole_group).alias("head"),
            F.count(F.lit(1)).over(whole_group).alias("members"),
            F.row_number().over(by_text).alias("place"),
        )
        .select(
            "doc_id", "slice", "digest", "head", "members", "place",
            F.sha2("norm", 256).alias("text_sha256"),
            F.when((F.col("slice") >= 0) & (F.col("place") == 1), F.col("norm")).alias("head_text"),
        )
    )
    groups = stored(groups, "exact-groups")
    same_text = Window.partitionBy("digest", "head_text").orderBy(wanted("head"))
    over_slices = same_text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = groups.where(F.col("head_text").isNotNull()).select(
        F.col("text_sha256").alias("m_sha"), F.col("slice").alias("m_slice"),
        F.first("head").over(over_slices).alias("m_head"),
        F.sum("members").over(over_slices).alias("m_members"),
    )
    one = F.col("m_members").isNotNull()
    return (
        # At most SLICES * SLICES rows: fewer than SLICES hot texts with SLICES slices each.
        groups.join(
            F.broadcast(merged),
            (F.col("text_sha256") == F.col("m_sha")) & (F.col("slice") == F.col("m_slice")),
            "left",
        )
        .withColumn("keep_id", F.when(one, F.col("m_head")).otherwise(F.col("head")))
        .select(
            "doc_id", "keep_id",
            F.when(one, F.col("m_members")).otherwise(F.col("members")).alias("group_size"),
            ((F.col("place") == 1) & F.col("head").eqNullSafe(F.col("keep_id"))).alias("kept"),
            "text_sha256",
        )
    )
