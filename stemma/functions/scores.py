"""Impact score, risk class and small display expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions.text import blank_to_null, strip

DEGREE_FOR_FULL_SCORE = 10.0
HIGH_ABOVE = 0.6
MEDIUM_ABOVE = 0.3


def degree_score(degree: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(degree, F.lit(0)) / F.lit(DEGREE_FOR_FULL_SCORE))


def clamp01(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))


def risk_level(score: Column) -> Column:
    return (
        F.when(score > HIGH_ABOVE, F.lit("high"))
        .when(score > MEDIUM_ABOVE, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def score_bar(score: Column, width: int = 16) -> Column:
    """Filled and empty blocks; the filled share is rounded half to even."""
    filled = F.bround(clamp01(score) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def asset_label(asset_id: Column, name: Column, asset_type: Column) -> Column:
    shown = strip(F.coalesce(blank_to_null(asset_id), blank_to_null(name), F.lit("?")))
    kind = strip(F.coalesce(asset_type, F.lit("")))
    return F.when(kind == "", shown).otherwise(F.concat(shown, F.lit(" ("), kind, F.lit(")")))


def distance_to_score(distance: Column) -> Column:
    """Similarity shown to users. Not monotone in the distance: rank by distance."""
    return F.when(distance.between(0.0, 1.0), 1.0 - distance).otherwise(1.0 / (1.0 + distance))
