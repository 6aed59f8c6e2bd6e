"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.session import materialize

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(column: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(column.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text that is not null."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """64 bits that tell rows of one id apart by their text; only used beside the id itself."""
    return F.xxhash64(doc_id, whole_text(text))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table below ``spark.checkpoint.dir``: computed once, kept when an executor is lost."""
    return materialize(df, purpose)
