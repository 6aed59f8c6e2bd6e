"""Connected components as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every end of ``edges`` (a, b); a component is named by its smallest vertex.

    Each round a vertex takes the smallest name among itself and its neighbours, and then the name which that
    vertex took. The edges are then contracted to these names, so every round has at most half
    of the vertices and the work shrinks with it. A round's result is a stored table, and
    smallest names are combined before the shuffle, so a hub is no hot key.
    """
    left = stored(_ordered(edges, "a", "b"), "component-edges")
    rounds = []
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = stored(
            both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("low")).select(
                "vertex", F.least("vertex", "low").alias("near")
            ),
            "component-names",
        )
        if hooked.limit(1).count() == 0:
            break
        beyond = hooked.select(F.col("vertex").alias("near"), F.col("near").alias("component"))
        names = stored(hooked.join(beyond, "near").select("vertex", "component"), "component-names")
        rounds.append(names)
        start = names.select(F.col("vertex").alias("a"), F.col("component").alias("from"))
        end = names.select(F.col("vertex").alias("b"), F.col("component").alias("to"))
        left = stored(_ordered(left.join(start, "a").join(end, "b"), "from", "to"), "component-edges")
    if not rounds:
        return hooked.select("vertex", F.col("near").alias("component"))
    found = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = found.select(F.col("vertex").alias("component"), F.col("component").alias("final"))
        found = stored(
            earlier.join(later, "component", "left").select("vertex", F.coalesce("final", "component").alias("component")),
            "component-names",
        )
    return found


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges between different ends, the smaller end first."""
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ends.where(F.col("a") != F.col("b")).distinct()
