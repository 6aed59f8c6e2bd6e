"""Metadata as it was at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of one slice: versions and requests of an id within a slice meet in one task.
SLICE_SECONDS = 90 * 86_400


def as_of(requests: DataFrame, versions: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """``requests`` (asset_id, at, ...) with ``version``, the struct of what was valid then and ``valid_from``; null if nothing was.

    ``versions`` has asset_id, valid_from, optionally ``ended`` (true: from then on there is none) and the attributes. A version
    is valid from its time on, that time included, until the next. Of several versions of one id and time the one with
    the highest values counts. Requests with a null id or time get null.

    Both are united and sorted by time within (id, slice of time); a request without a version in its slice takes the last one of the
    slices before. So an id with a third of all rows is as many groups as it has slices, and between slices one row each is carried.
    """
    extra = [c for c in requests.columns if c not in ("asset_id", "at")]
    attributes = [c for c in versions.columns if c not in ("asset_id", "valid_from", "ended")]
    ended = F.coalesce("ended", F.lit(False)) if "ended" in versions.columns else F.lit(False)
    slice_of = lambda t: F.floor(F.unix_timestamp(t) / slice_seconds)
    known = versions.where("asset_id is not null and valid_from is not null").select(
        "asset_id", F.col("valid_from").alias("at"), slice_of("valid_from").alias("slice"), F.lit(0).alias("asks"),
        F.struct("valid_from", ended.alias("ended"), *attributes).alias("version"),
    )
    asked = requests.select(
        "asset_id", "at", slice_of("at").alias("slice"), F.lit(1).alias("asks"), F.struct(*extra).alias("request")
    )
    both = known.unionByName(asked, allowMissingColumns=True)
    by_time = Window.partitionBy("asset_id", "slice").orderBy("at", "asks", "version")
    met = both.withColumn("inside", F.last("version", ignorenulls=True).over(by_time)).where("asks = 1")

    lasts = known.groupBy("asset_id", "slice").agg(F.max("version").alias("last"))
    following = Window.partitionBy("asset_id").orderBy("slice")
    # Ranges of slices in which a last version is the one before: from the next slice on to that of the next version.
    ranges = lasts.withColumn("until", F.lead("slice").over(following)).select(
        F.col("asset_id").alias("of"), F.col("slice").alias("after"), "until", "last"
    )
    before = (F.col("asset_id") == F.col("of")) & (F.col("slice") > F.col("after")) & (
        F.col("until").isNull() | (F.col("slice") <= F.col("until"))
    )
    version = F.coalesce("inside", "last")
    return met.join(ranges, before, "left").select(
        "asset_id", "at", *[F.col("request")[c].alias(c) for c in extra],
        F.when(F.col("at").isNotNull() & ~version["ended"], F.struct(*[version[c].alias(c) for c in ("valid_from", *attributes)])).alias("version"),
    )
