"""Ranks within groups for tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import stored

#: ``monotonically_increasing_id`` holds the partition above this bit and the place in it below.
PART_BIT = 33


def part_of(at: Column) -> Column:
    """The partition of a row that :func:`in_order` numbered."""
    return F.shiftrightunsigned(at, PART_BIT)


def in_order(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``rows`` sorted by range partitions, with a number ``at`` that rises in that order.

    The rows' own number is the last key, so rows that are equal in all keys can lie in many partitions. Numbers
    hold only for one run of the plan: store the result before its numbers are used twice.
    """
    keys = [*order, F.col("seq_of_row")]
    numbered = rows.withColumn("seq_of_row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(parts, *keys) if parts else numbered.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop("seq_of_row")


def starts(numbered: DataFrame, group: str, *sums: Column) -> DataFrame:
    """Per (group, partition) of stored rows: ``first`` number, rows ``before`` it in the group, the group's rows ``n``.

    ``sums`` are further aggregates per group and partition. Only partitions are
    counted here, so the largest group has as many rows as there are partitions.
    """
    upto = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = numbered.groupBy(group, part_of(F.col("at")).alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("at").alias("first"), *sums
    )
    return parts.withColumn("before", F.coalesce(F.sum("n_rows").over(upto), F.lit(0))).withColumn(
        "n", F.sum("n_rows").over(Window.partitionBy(group))
    )


def ranked(rows: DataFrame, group: str, order: list[Column], purpose: str) -> DataFrame:
    """``rows`` with their ``rank`` from 0 in ``group`` (no nulls) and the group's size ``n``."""
    placed = stored(in_order(rows, [F.asc(group), *order]), purpose)
    known = starts(placed, group).select(F.col(group).alias("of_group"), "part", "first", "before", "n")
    same = (F.col(group) == F.col("of_group")) & (part_of(F.col("at")) == F.col("part"))
    rank = F.col("before") + F.col("at") - F.col("first")
    return placed.join(known, same).withColumn("rank", rank).drop("of_group", "part", "first", "before", "at")
