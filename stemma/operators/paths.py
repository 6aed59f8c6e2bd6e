"""Lineage of any depth: what an asset reaches, in which order assets can be refreshed, how many are affected.

All three are loops of joins over ``edges`` (source_asset_id, target_asset_id, ...). A round is a stored table, so a lost
executor costs one round, and it joins only what the last round found anew. Loops end when a round finds
nothing, with cycles too, as nothing is found twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemma.operators.graph import DOWNSTREAM, UPSTREAM, lineage_requests
from stemma.session import empty, materialize

#: log2 of the registers of a count sketch: a relative error of about 1.6 % (one standard deviation).
LG_REGISTERS = 12


def _links(edges: DataFrame) -> DataFrame:
    """Distinct (a, b), stored: b depends on a."""
    pairs = edges.select(F.col("source_asset_id").alias("a"), F.col("target_asset_id").alias("b"))
    return materialize(pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "path-links")


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n) and links with numbers in place of ids, both stored: rounds move 8 bytes per end, not texts."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = materialize(nodes.withColumn("n", F.monotonically_increasing_id()), "path-nodes")
    n_a, n_b = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")) for c in ("a", "b"))
    coded = links.join(n_a, "a").join(n_b, "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b"))
    return nodes, materialize(coded, "path-links")


def unknown(reached: DataFrame, rounds: list[DataFrame], keys: list[str]) -> DataFrame:
    """Distinct reached rows that no round holds, stored.

    Behind a small frontier what was reached is stored first, so Spark knows its size and can send it to the known rows,
    which are then neither shuffled nor sorted. So the many late rounds that find little cost a scan each.
    """
    known = _all([r.select(*keys) for r in rounds])
    if 8 * rounds[-1].count() >= known.count():
        return materialize(reached.distinct().join(known, keys, "left_anti"), "path-round")
    reached = materialize(reached.distinct(), "path-reached")
    seen = known.join(reached, keys, "left_semi")
    return materialize(reached.join(seen, keys, "left_anti"), "path-round")


_FOUND = ["asset_id", "side", "node"]


def hop(frontier: DataFrame, steps: DataFrame) -> DataFrame:
    """(asset_id, side, node) one hop beyond the frontier, copies included; without side where nodes tell it."""
    sides = ["side"] if "side" in steps.columns else []
    return frontier.join(steps, [*sides, "node"]).select("asset_id", *sides, F.col("next").alias("node"))


def next_round(frontier: DataFrame, steps: DataFrame, known: DataFrame) -> DataFrame:
    """New (asset_id, side, node) one hop beyond the frontier, as one plan."""
    return hop(frontier, steps).distinct().join(known, _FOUND, "left_anti")


def transitive_lineage(requests: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(asset_id, side, node, depth): everything the asked assets reach, with the fewest hops.

    ``requests`` has asset_id and direction as in ``graph.asset_lineage``. The asset itself is not listed, also
    where a cycle leads back to it. Ids of edges need not be registered. ``max_depth`` ends the search earlier.
    """
    nodes, links = named_ends(edges)
    links = materialize(links.distinct(), "path-links")
    # Numbers of nodes are even; the odd number after it stands for a node on the way upstream. So a step joins by one number.
    steps = links.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(
        links.select((F.col("b") + 1).alias("node"), (F.col("a") + 1).alias("next"))
    )
    sides = F.when(F.col("direction") == "both", F.array(F.lit(UPSTREAM), F.lit(DOWNSTREAM))).otherwise(F.array("direction"))
    asked = lineage_requests(requests).where("asset_id <> ''").select(F.col("asset_id").alias("node"), F.explode(sides).alias("side"))
    # An id without any edge reaches nothing.
    first = asked.distinct().join(nodes.withColumnRenamed("name", "node"), "node")
    first = first.select(F.col("n").alias("asset_id"), (F.col("n") + (F.col("side") == UPSTREAM).cast("long")).alias("node"))
    rounds = [materialize(first, "path-round")]
    while max_depth is None or len(rounds) <= max_depth:
        found = unknown(hop(rounds[-1], steps), rounds, ["asset_id", "node"])
        if not _some(found):
            break
        rounds.append(found)
    reach = _all([r.withColumn("depth", F.lit(k)) for k, r in enumerate(rounds)]).where("depth > 0")
    asked_id = nodes.select(F.col("n").alias("source"), F.col("name").alias("asset_id"))
    up = F.col("node").bitwiseAND(F.lit(1)) == 1
    side, n = F.when(up, F.lit(UPSTREAM)).otherwise(F.lit(DOWNSTREAM)), F.when(up, F.col("node") - 1).otherwise(F.col("node"))
    reach = reach.select(F.col("asset_id").alias("source"), side.alias("side"), n.alias("n"), "depth")
    found = nodes.select("n", F.col("name").alias("node"))
    return reach.join(found, "n").join(asked_id, "source").select("asset_id", "side", "node", "depth")


# ---- cycles and layers ----------------------------------------------------------


def _trimmed(links: DataFrame) -> DataFrame:
    """Links whose ends both have a link in and a link out: cycles, and paths from one cycle to another."""
    links = materialize(links.where("a <> b"), "path-core")
    while True:
        starts, ends = links.select(F.col("b").alias("a")).distinct(), links.select(F.col("a").alias("b")).distinct()
        inner = materialize(links.join(starts, "a", "left_semi").join(ends, "b", "left_semi").select("a", "b"), "path-core")
        if inner.count() == links.count():
            return inner
        links = inner


def _spread_smallest(nodes: DataFrame, links: DataFrame, start: Column) -> DataFrame:
    """(node, mark): the smallest start value among all nodes that reach a node; only risen nodes speak again."""
    marks = materialize(nodes.select("node", start.alias("mark")), "path-marks")
    changed = marks
    while True:
        heard = links.join(changed, links["a"] == changed["node"]).groupBy("b").agg(F.min("mark").alias("heard"))
        # One row per node on both sides.
        better = marks.join(heard, marks["node"] == heard["b"]).where("heard < mark").select("node", F.col("heard").alias("mark"))
        changed = materialize(better, "path-changed")
        if not _some(changed):
            return marks
        lower = changed.select(F.col("node").alias("of"), F.col("mark").alias("lower"))
        marks = materialize(
            marks.join(lower, F.col("node") == F.col("of"), "left").select("node", F.coalesce("lower", "mark").alias("mark")),
            "path-marks",
        )


def _cycles_of(links: DataFrame) -> DataFrame:
    """(node, cycle) for every node on a cycle of more than one node; a cycle is named by its smallest node.

    Nodes that reach each other form a cycle. Each round every node takes the smallest node that
    reaches it. Of the nodes with one such name those that reach its node are its cycle: they are found by walking back
    within the name, and leave the graph.
    """
    found = []
    links = _trimmed(links)
    while _some(links):
        nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        marks = _spread_smallest(nodes, links, F.col("node"))
        mark_a = marks.select(F.col("node").alias("a"), F.col("mark").alias("mark_a"))
        mark_b = marks.select(F.col("node").alias("b"), F.col("mark").alias("mark_b"))
        inside = materialize(
            links.join(mark_a, "a").join(mark_b, "b").where("mark_a = mark_b").select("a", "b", F.col("mark_a").alias("cycle")),
            "path-inside",
        )
        walk = [materialize(marks.where("node = mark").select("node", F.col("mark").alias("cycle")), "path-walk")]
        while True:
            back = inside.join(walk[-1].withColumnRenamed("node", "b"), ["b", "cycle"]).select(F.col("a").alias("node"), "cycle")
            new = materialize(back.distinct().join(_all(walk), ["node", "cycle"], "left_anti"), "path-walk")
            if not _some(new):
                break
            walk.append(new)
        members = materialize(_all(walk), "path-members")
        found.append(members)
        gone = members.select("node")
        links = _trimmed(
            links.join(gone.withColumnRenamed("node", "a"), "a", "left_anti")
            .join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")
        )
    if not found:
        return links.select(F.col("a").alias("node"), F.col("b").alias("cycle"))
    # A node whose name is its own and that no one reaches back to is no cycle.
    whole = _all(found)
    real = whole.groupBy("cycle").count().where("count > 1").select("cycle")
    return materialize(whole.join(real, "cycle", "left_semi").select("node", "cycle"), "path-cycles")


def _codes(names: DataFrame, seed: int) -> bool:
    """Whether the numbers that ``seed`` gives to distinct names differ; a repeated number gives False."""
    coded = names.select(_code(F.col("name"), seed).alias("n"))
    return coded.distinct().count() == names.count()


def _code(name: Column, seed: int) -> Column:
    """An even number."""
    return F.xxhash64(F.lit(seed), name).bitwiseAND(F.lit(-2))


def named_ends(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, n, fed, own) per node and (a, b) in numbers for links between different nodes, copies included.

    A node's number follows from its name alone, so no link is joined to get numbers; that they differ is checked, and another
    seed is taken if not. ``fed`` tells whether another node feeds it, ``own`` whether it feeds itself.
    """
    a, b = F.col("source_asset_id"), F.col("target_asset_id")
    raw = materialize(edges.where(a.isNotNull() & b.isNotNull()).select(a.alias("a"), b.alias("b")), "path-links")
    loop = F.col("a") == F.col("b")
    ends = F.array(
        F.struct(F.col("a").alias("name"), F.lit(False).alias("fed"), loop.alias("own")),
        F.struct(F.col("b").alias("name"), (~loop).alias("fed"), loop.alias("own")),
    )
    nodes = raw.select(F.inline(ends)).groupBy("name").agg(F.max("fed").alias("fed"), F.max("own").alias("own"))
    nodes = materialize(nodes, "path-nodes")
    seed = 1
    while not _codes(nodes, seed):
        seed += 1
    links = raw.where(~loop).select(_code(F.col("a"), seed).alias("a"), _code(F.col("b"), seed).alias("b"))
    return nodes.withColumn("n", _code(F.col("name"), seed)), links


def _unfed(links: DataFrame) -> DataFrame:
    """(n): the nodes that feed others and that no one feeds."""
    ends = F.array(
        F.struct(F.col("a").alias("n"), F.lit(False).alias("fed")), F.struct(F.col("b").alias("n"), F.lit(True).alias("fed"))
    )
    return links.select(F.inline(ends)).groupBy("n").agg(F.max("fed").alias("fed")).where("not fed").select("n")


def _split(links: DataFrame, ready: DataFrame) -> DataFrame:
    """The links, stored, with ``gone`` where the node they come from is ready."""
    met = ready.select(F.col("n").alias("a"), F.lit(True).alias("met"))
    return materialize(links.join(met, "a", "left").select("a", "b", F.col("met").isNotNull().alias("gone")), "path-left")


def _layers_of_units(links: DataFrame, layers: DataFrame) -> DataFrame:
    """(n, layer): ``layers`` raised to one more than the highest layer a unit depends on; the links have no cycle."""
    links = materialize(links.distinct(), "path-left")
    while _some(links):
        marked = _split(links, _unfed(links))
        links = marked.where("not gone").select("a", "b")
        # One row per unit on both sides.
        heard = marked.where("gone").join(layers.withColumnRenamed("n", "a"), "a").groupBy(F.col("b").alias("n")).agg(
            (F.max("layer") + 1).alias("heard")
        )
        layers = materialize(layers.join(heard, "n", "left").select("n", F.greatest("layer", "heard").alias("layer")), "path-layers")
    return layers


def lineage_layers(edges: DataFrame) -> DataFrame:
    """(asset_id, layer, cycle): the order in which assets can be refreshed.

    Layer 0 depends on nothing; an asset's layer is one more than the highest layer it depends on. Assets that depend on
    each other share a layer, and ``cycle`` names their smallest (null elsewhere; an asset that only depends on itself
    is its own cycle). Peeling: each round takes the nodes that no open link feeds and closes the links behind them, so
    rounds get smaller. Only what cannot be peeled, cycles and what is behind them, is searched for cycles, and goes on with a unit
    per cycle.
    """
    nodes, links = named_ends(edges)
    ready, closed = nodes.where("not fed").select("n"), []
    while _some(ready):
        marked = _split(links, ready)
        # Who is fed from round k is at layer k + 1 at least; who gets free in the next round is at that layer.
        closed.append(marked.where("gone").select(F.col("b").alias("n"), F.lit(len(closed) + 1).alias("layer")))
        links = marked.where("not gone").select("a", "b")
        ready = materialize(_unfed(links), "path-ready")
    none = nodes.limit(0).select("n", F.lit(0).alias("layer"))
    fed = _all([none, *closed]).groupBy("n").agg(F.max("layer").alias("layer"))
    if not _some(links):
        return nodes.join(fed, "n", "left").select(
            F.col("name").alias("asset_id"), F.coalesce("layer", F.lit(0)).alias("layer"), F.when(F.col("own"), F.col("name")).alias("cycle")
        )
    fed, links = materialize(fed, "path-fed"), materialize(links.distinct(), "path-left")
    cycles = _cycles_of(links)
    rest = links.select(F.explode(F.array("a", "b")).alias("n")).distinct().join(cycles.withColumnRenamed("node", "n"), "n", "left")
    units = materialize(rest.select("n", F.coalesce("cycle", "n").alias("unit"), "cycle"), "path-units")
    start = units.join(fed, "n", "left").groupBy("unit").agg(F.coalesce(F.max("layer"), F.lit(0)).alias("layer"))
    unit_a = units.select(F.col("n").alias("a"), F.col("unit").alias("from"))
    unit_b = units.select(F.col("n").alias("b"), F.col("unit").alias("to"))
    between = links.join(unit_a, "a").join(unit_b, "b").where("from <> to").select(F.col("from").alias("a"), F.col("to").alias("b"))
    layers = _layers_of_units(between, materialize(start.withColumnRenamed("unit", "n"), "path-layers"))
    named = units.where("cycle is not null").join(nodes.select("n", "name"), "n").groupBy("cycle").agg(F.min("name").alias("cycle_name"))
    late = units.join(layers.select(F.col("n").alias("unit"), F.col("layer").alias("late")), "unit").join(named, "cycle", "left")
    return nodes.join(fed, "n", "left").join(late.select("n", "late", "cycle_name"), "n", "left").select(
        F.col("name").alias("asset_id"), F.coalesce("late", "layer", F.lit(0)).alias("layer"),
        F.coalesce("cycle_name", F.when(F.col("own"), F.col("name"))).alias("cycle"),
    )


# ---- how many are affected --------------------------------------------------------


@dataclass(frozen=True)
class Units:
    """The graph with a unit per cycle, in layers; all relations are stored.

    ``nodes`` (name, n, own, unit, size): own tells a link to itself, size is the number of nodes of the unit. ``layers`` holds per layer the
    (a, b, big) of all links that leave its units, big where b is a cycle: b is in a later layer, and only units of layer 0 are not fed.
    """

    nodes: DataFrame
    layers: list[DataFrame]


def _peeled(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The links that leave what nothing feeds, round by round, and the links that cannot be peeled; all stored."""
    layers = []
    while _some(links):
        met = _unfed(links).select(F.col("n").alias("a"), F.lit(True).alias("met"))
        marked = links.join(met, "a", "left").select("a", "b", "big", F.col("met").isNotNull().alias("gone"))
        marked = materialize(marked, "path-left")
        if not _some(marked.where("gone")):
            break
        layers.append(marked.where("gone").drop("gone"))
        links = marked.where("not gone").drop("gone")
    return layers, links


def unit_layers(edges: DataFrame) -> Units:
    """Layers are peeled from what nothing feeds, so most links are closed in the first rounds and only what cannot be peeled is searched
    for cycles. These become units, and peeling goes on."""
    nodes, links = named_ends(edges)
    links = materialize(links.distinct(), "path-links").withColumn("big", F.lit(False))
    layers, links = _peeled(links)
    cycles = _cycles_of(links.select("a", "b"))
    sizes = cycles.groupBy("cycle").agg(F.count(F.lit(1)).alias("size"))
    units = materialize(cycles.join(sizes, "cycle").select(F.col("node").alias("n"), F.col("cycle").alias("unit"), "size"), "path-units")
    nodes = nodes.select("name", "n", "own").join(units, "n", "left")
    nodes = nodes.select("name", "n", "own", F.coalesce("unit", "n").alias("unit"), F.coalesce("size", F.lit(1)).alias("size"))
    nodes = materialize(nodes, "path-nodes")
    if _some(units):
        unit_a = units.select(F.col("n").alias("a"), F.col("unit").alias("from"))
        unit_b = units.select(F.col("n").alias("b"), F.col("unit").alias("to"))
        a, b = F.coalesce("from", "a"), F.coalesce("to", "b")
        between = links.join(unit_a, "a", "left").join(unit_b, "b", "left")
        between = between.select(a.alias("a"), b.alias("b"), F.col("to").isNotNull().alias("big")).where("a <> b")
        late, _ = _peeled(materialize(between.distinct(), "path-links"))
        early = [x.join(unit_b, "b", "left").select("a", b.alias("b"), F.col("to").isNotNull().alias("big")) for x in layers]
        layers = [materialize(x, "path-left") for x in early] + late
    return Units(nodes, layers)


#: Ids, about, that one row lists.
LISTED = 1 << 16
_LISTS = "a bigint, part bigint, ids array<bigint>, bigs array<bigint>, n bigint"


def _merge(keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (a, part, ids, bigs) that are sorted by a and part become one row per a and part, without copies of ids."""

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)

    def distinct(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids)
        order = order[np.argsort(group[order], kind="stable")]
        ids, group = ids[order], group[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])
        return ids[new], group[new]

    def lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(counts)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int64()))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group so far, whose rows can go on in the next batch
        names = ["a", "part", "ids", "bigs", "n"]

        def rows(whole: tuple, first: int, stop: int) -> pa.RecordBatch:
            a, part, columns = whole
            made = []
            for ids, counts, ends in columns:
                kept = ids[ends[first] : ends[stop]]
                made.append((lists(kept, counts[first:stop]), counts[first:stop]))
            n = made[0][1]
            if not keep_ids:
                made[0] = (lists(np.empty(0, dtype=np.int64), np.zeros(stop - first, dtype=np.int64)), n)
            return pa.RecordBatch.from_arrays(
                [pa.array(a[first:stop]), pa.array(part[first:stop]), made[0][0], made[1][0], pa.array(n.astype(np.int64))], names=names
            )

        for batch in batches:
            if not len(batch):
                continue
            a, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            both = [flat(batch.column(c)) for c in (2, 3)]
            if held is not None:
                a, part = np.concatenate([held[0], a]), np.concatenate([held[1], part])
                both = [(np.concatenate([ids, more]), np.concatenate([[len(ids)], counts])) for ids, (more, counts) in zip(held[2], both)]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (part[1:] != part[:-1])])
            group, n_groups = (np.cumsum(new) - 1).astype(np.int32), int(new.sum())
            columns = []
            for ids, counts in both:
                ids, of = distinct(ids, np.repeat(group, counts))
                counts = np.bincount(of, minlength=n_groups)
                columns.append((ids, counts, np.concatenate([[0], np.cumsum(counts)])))
            whole = (a[new], part[new], columns)
            if n_groups > 1:
                yield rows(whole, 0, n_groups - 1)
            held = (whole[0][-1:], whole[1][-1:], [ids[ends[-2] :] for ids, _, ends in columns])
        if held is not None:
            columns = [(ids, np.array([len(ids)]), np.array([0, len(ids)])) for ids in held[2]]
            yield rows((held[0], held[1], columns), 0, 1)

    return merged


def _reached(links: DataFrame, known: DataFrame, sizes: DataFrame, keep_ids: bool) -> DataFrame:
    """Rows of ``_LISTS``: what the a of ``links`` reach, from what their b reach (``known``, with ``sizes`` per unit), stored.

    Lists of a unit that reaches much are dealt over parts by id, so no row and no task holds all that a hub reaches.
    """
    total = links.join(sizes.withColumnRenamed("n", "b"), "b", "left").groupBy("a")
    total = total.agg(F.sum(F.coalesce("listed", F.lit(0)) + 1).alias("total")).where(F.col("total") > LISTED)
    hubs = materialize(total.select("a", F.ceil(F.col("total") / LISTED).alias("parts")), "path-hubs")
    one, none = F.array("b"), F.array().cast("array<bigint>")
    own = links.select("a", F.when(F.col("big"), none).otherwise(one).alias("ids"), F.when(F.col("big"), one).otherwise(none).alias("bigs"))
    heard = links.select("a", "b").join(known.select(F.col("a").alias("b"), "ids", "bigs"), "b").select("a", "ids", "bigs")
    told = own.unionByName(heard)
    dealt = told.withColumn("part", F.lit(0).cast("long"))
    if _some(hubs):
        each = told.join(hubs, "a").select("a", "parts", F.inline(F.concat(
            F.transform("ids", lambda x: F.struct(x.alias("id"), F.lit(False).alias("big"))),
            F.transform("bigs", lambda x: F.struct(x.alias("id"), F.lit(True).alias("big"))),
        )))
        each = each.select("a", "parts", "id", "big").distinct()
        alone = F.array("id")
        each = each.select("a", F.when(F.col("big"), none).otherwise(alone).alias("ids"), F.when(F.col("big"), alone).otherwise(none).alias("bigs"),
                           F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
        dealt = dealt.join(hubs, "a", "left_anti").unionByName(each)
    dealt = dealt.select("a", "part", "ids", "bigs").repartition("a", "part").sortWithinPartitions("a", "part")
    return materialize(dealt.mapInArrow(_merge(keep_ids), _LISTS), "path-lists")


def affected_counts(edges: DataFrame, units: Units | None = None) -> DataFrame:
    """(asset_id, affected): the exact counts.

    Units are listed from the last layer up: a unit reaches what its links lead to and what those reach. A cycle is one id, however many
    nodes it has, and what the units of layer 0 reach, which nothing leads to, is counted and not kept. ``units`` can be given if known.
    """
    units = units or unit_layers(edges)
    nodes = units.nodes
    spark = nodes.sparkSession
    known, sizes = empty(spark, T.StructType.fromDDL(_LISTS)), [empty(spark, T.StructType.fromDDL("n bigint, listed bigint"))]
    for k, links in reversed(list(enumerate(units.layers))):
        found = _reached(links, known, _all(sizes), k > 0)
        known = known.unionByName(found)
        sizes.append(found.groupBy(F.col("a").alias("n")).agg(F.sum(F.col("n") + F.size("bigs")).alias("listed")))
    cycle_sizes = nodes.where("size > 1").select(F.col("unit").alias("big"), "size").distinct()
    members = known.select("a", F.explode("bigs").alias("big")).join(cycle_sizes, "big").select("a", F.col("size").alias("n"))
    counts = known.select("a", "n").unionByName(members).groupBy(F.col("a").alias("unit")).agg(F.sum("n").alias("reached"))
    itself = F.when(F.col("size") > 1, F.col("size")).otherwise(F.col("own").cast("long"))
    return nodes.join(counts, "unit", "left").select(
        F.col("name").alias("asset_id"), (F.coalesce("reached", F.lit(0)) + itself).alias("affected")
    )


def affected_estimates(edges: DataFrame, lg_registers: int = LG_REGISTERS, units: Units | None = None) -> DataFrame:
    """(asset_id, estimate): about how many assets each asset affects, over any number of hops.

    One count sketch per unit is merged against the direction of the edges, from the last layer up, so each link is used once. The work
    is a few kilobytes per edge, however large the sets are; the sets are never listed. An asset on a cycle affects itself. Assets that
    affect nothing have 0.
    """
    units = units or unit_layers(edges)
    nodes = units.nodes
    looped = nodes.where("size > 1 or own").groupBy(F.col("unit").alias("n")).agg(F.hll_sketch_agg("n", lg_registers).alias("sketch"))
    looped = materialize(looped, "path-sketches")
    held = looped  # copies per unit: what its nodes are themselves, and what it reaches
    for links in reversed(units.layers):
        single = links.where("not big").groupBy("a").agg(F.hll_sketch_agg("b", lg_registers).alias("sketch"))
        heard = links.select("a", "b").join(held.withColumnRenamed("n", "b"), "b").select("a", "sketch")
        found = single.unionByName(heard).groupBy(F.col("a").alias("n")).agg(F.hll_union_agg("sketch").alias("sketch"))
        held = held.unionByName(materialize(found, "path-sketches"))
    whole = held.groupBy(F.col("n").alias("unit")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    return nodes.join(whole, "unit", "left").select(
        F.col("name").alias("asset_id"), F.coalesce("estimate", F.lit(0)).cast("long").alias("estimate")
    )
