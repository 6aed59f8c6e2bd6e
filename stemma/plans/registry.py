"""Named queries over the given tables and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from stemma.plans.star import comparison, relation
from stemma.session import spread


@dataclass(frozen=True)
class Inputs:
    """The given tables and derived relations of one run."""

    spark: SparkSession
    sf_dir: str
    known: dict[str, DataFrame] = field(default_factory=dict)

    def __call__(self, name: str) -> DataFrame:
        return relation(self.spark, self.sf_dir, name, self.known)

    def spread(self, name: str, key: str) -> DataFrame:
        """A relation for work that costs much CPU per row; see ``session.spread``."""
        return spread(self(name), key)


Query = Callable[[Inputs], DataFrame]
QUERIES: dict[str, Query] = {}
COMPARISON_TEXTS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its comparison text with ``{relation}`` marks."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            COMPARISON_TEXTS[name] = sql
        return fn

    return add


def comparisons() -> dict[str, str]:
    """Complete comparison SQL per query that has one."""
    return {name: comparison(text) for name, text in COMPARISON_TEXTS.items()}
