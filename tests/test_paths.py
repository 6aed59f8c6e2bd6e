"""Lineage of any depth against brute force on random graphs with cycles."""

import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import paths as P
from stemma.session import materialize

EDGES = "source_asset_id string, target_asset_id string, relationship_type string"


def graph(spark, links):
    return spark.createDataFrame([(a, b, "feeds") for a, b in links], EDGES)


def hops(links, start):
    """Fewest hops from a node to all it reaches."""
    ahead = {}
    for a, b in links:
        ahead.setdefault(a, set()).add(b)
    depth, now = {start: 0}, [start]
    while now:
        now = [b for a in now for b in ahead.get(a, ()) if depth.setdefault(b, depth[a] + 1) == depth[a] + 1 and b not in now]
        now = list(dict.fromkeys(now))
    return depth


def reached(links, start):
    """All nodes at one hop or more, the start too where it is on a cycle."""
    return {b for x, b in links if x in hops(links, start)}


def brute_layers(links):
    nodes = sorted({x for link in links for x in link})
    ahead = {n: reached(links, n) for n in nodes}
    unit = {n: min([m for m in ahead[n] if n in ahead[m]] + [n]) for n in nodes}
    behind = {n: {unit[a] for a, b in links if unit[b] == unit[n] and unit[a] != unit[n]} for n in nodes}
    layer = {}

    def of(u):
        if u not in layer:
            layer[u] = 1 + max(map(of, behind[u]), default=-1)
        return layer[u]

    return sorted((n, of(unit[n]), unit[n] if n in ahead[n] else None) for n in nodes)


def random_links(seed, n, m):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)]


#: Two cycles with a path between them, a way in, a way out, a self-loop, a repeated edge.
LINKED = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "m"), ("m", "n"), ("n", "x"), ("x", "y"), ("y", "x"), ("in", "a"),
          ("y", "out"), ("out", "end"), ("in", "end"), ("self", "self"), ("self", "end"), ("a", "b")]
GRAPHS = [LINKED, random_links(3, 18, 40)]


@pytest.mark.parametrize("links", GRAPHS)
def test_transitive_lineage_of_graphs_with_cycles(spark, rows, links):
    nodes = sorted({x for link in links for x in link})
    asked = [(f" {n} ", "Upstream" if k % 3 == 0 else "downstream" if k % 3 == 1 else None) for k, n in enumerate(nodes)]
    found = P.transitive_lineage(spark.createDataFrame(asked + [("", "both"), ("nowhere", "both")], "asset_id string, direction string"), graph(spark, links))
    back = [(b, a) for a, b in links]
    wanted = []
    for k, n in enumerate(nodes):
        for side, way in (("upstream", back), ("downstream", links)):
            if k % 3 == 2 or (side == "upstream") == (k % 3 == 0):
                wanted += [(n, side, m, d) for m, d in hops(way, n).items() if d]
    assert rows(found, "asset_id", "side", "node", "depth") == sorted(wanted, key=repr)


def test_depth_is_an_argument(spark, rows):
    chain = graph(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    asked = spark.createDataFrame([("a", "downstream")], "asset_id string, direction string")
    assert rows(P.transitive_lineage(asked, chain, max_depth=2), "node", "depth") == [("b", 1), ("c", 2)]
    assert P.transitive_lineage(asked, chain, max_depth=0).count() == 0


@pytest.mark.parametrize("links", GRAPHS)
def test_layers_and_cycles(spark, rows, links):
    assert rows(P.lineage_layers(graph(spark, links)), "asset_id", "layer", "cycle") == sorted(brute_layers(links), key=repr)


@pytest.mark.parametrize("links", GRAPHS)
def test_counts_of_affected_assets(spark, rows, links):
    nodes = {x for link in links for x in link}
    wanted = sorted((n, len(reached(links, n))) for n in nodes)
    assert rows(P.affected_counts(graph(spark, links)), "asset_id", "affected") == wanted
    # Sketches of a few ids are exact.
    assert rows(P.affected_estimates(graph(spark, links)), "asset_id", "estimate") == wanted


def test_estimates_of_large_sets(spark):
    """A root of 300 groups of 40 leaves that share half of them, at two sizes of sketch."""
    links = [("root", f"g{g}") for g in range(300)] + [(f"g{g}", f"leaf{(20 * g + k) % 6000}") for g in range(300) for k in range(40)]
    for size, bound in ((8, 0.2), (12, 0.05)):
        found = {r.asset_id: r.estimate for r in P.affected_estimates(graph(spark, links), size).collect()}
        assert abs(found["root"] - 6300) < bound * 6300 and abs(found["g7"] - 40) <= 2 and found["leaf9"] == 0


def test_no_edges(spark):
    none = graph(spark, [("a", "b")]).limit(0)
    asked = spark.createDataFrame([("a", "both")], "asset_id string, direction string")
    assert P.transitive_lineage(asked, none).count() == P.lineage_layers(none).count() == P.affected_estimates(none).count() == 0


def test_a_round_joins_the_frontier_only(spark):
    """The edges meet the last round; what is known before takes part in the anti-join alone."""
    ids = "asset_id string, side string, node string"
    frontier = materialize(spark.createDataFrame([("a", "downstream", "b")], ids), "test-frontier")
    known = materialize(spark.createDataFrame([("a", "downstream", "a")], ids), "test-known")
    steps = spark.createDataFrame([("downstream", "b", "c")], "side string, node string, next string")
    plan = P.next_round(frontier, steps, known)._jdf.queryExecution().optimizedPlan().toString()
    top, inner = plan.index("LeftAnti"), plan.index("Join Inner")
    assert top < inner and plan.count("Join") == 2


def test_rounds_hold_numbers_and_a_small_round_finds_only_what_is_new(spark):
    edges = spark.createDataFrame([("x", "y", "t"), ("y", "x", "t"), ("y", "z", "t")], "source_asset_id string, target_asset_id string, relationship_type string")
    nodes, links = P.numbered(P._links(edges))
    assert dict(links.dtypes) == {"a": "bigint", "b": "bigint"}
    name = {r.n: r.node for r in nodes.collect()}
    assert sorted((name[r.a], name[r.b]) for r in links.collect()) == [("x", "y"), ("y", "x"), ("y", "z")]
    pairs = "a bigint, b bigint"
    rounds = [spark.range(100).selectExpr("id as a", "id as b"), spark.createDataFrame([(1, 2)], pairs)]
    reached = spark.createDataFrame([(1, 2), (5, 5), (5, 6), (5, 6)], pairs)
    assert [tuple(r) for r in P.unknown(reached, rounds, ["a", "b"]).collect()] == [(5, 6)]


def test_layers_close_links_as_rounds_go(spark, rows, monkeypatch):
    """A chain of 12 behind 40 leaves: a round reads open links only, and the whole graph is never searched for cycles."""
    links = [("root", f"leaf{k}") for k in range(40)] + [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(12)] + [("root", "c00")]
    written = []

    def count(df, purpose):
        found = materialize(df, purpose)
        written.append((purpose, found.count()))
        return found

    monkeypatch.setattr(P, "materialize", count)
    found = P.lineage_layers(graph(spark, links))
    assert rows(found, "asset_id", "layer", "cycle") == sorted(brute_layers(links), key=repr)
    assert "path-core" not in dict(written) and sum(n for _, n in written) < 4 * len(links) + 12 * 12


def test_numbers_of_nodes_differ(spark, rows, monkeypatch):
    """Where two names get one number another seed is taken."""
    code = P._code
    monkeypatch.setattr(P, "_code", lambda name, seed: F.length(name).cast("long") if seed == 1 else code(name, seed))
    assert rows(P.lineage_layers(graph(spark, LINKED)), "asset_id", "layer", "cycle") == sorted(brute_layers(LINKED), key=repr)


def test_layers_behind_cycles_wait_for_peeled_nodes(spark, rows):
    """A cycle that a long chain feeds, a chain behind it, and a second cycle that both feed."""
    links = [(f"p{k}", f"p{k + 1}") for k in range(5)] + [("p5", "x"), ("x", "y"), ("y", "x"), ("y", "q"), ("q", "r"), ("p2", "r")]
    links += [("r", "u"), ("u", "v"), ("v", "u"), ("p1", "v"), ("s", "s"), ("s", "q"), ("v", "end"), ("x", "end")]
    assert rows(P.lineage_layers(graph(spark, links)), "asset_id", "layer", "cycle") == sorted(brute_layers(links), key=repr)


def test_counts_list_a_row_per_unit_and_deal_hubs(spark, rows, monkeypatch):
    """Cycles are one unit, pairs are not listed as rows, and what a hub reaches is dealt over rows of bounded length."""
    links = [(f"top{k}", f"mid{m}") for k in range(12) for m in range(9)] + [(f"mid{m}", f"low{k}") for m in range(9) for k in range(8)]
    links += [("low0", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "self"), ("self", "self")]
    written = {}

    def keep(df, purpose):
        found = materialize(df, purpose)
        written.setdefault(purpose, []).append(found)
        return found

    monkeypatch.setattr(P, "materialize", keep)
    nodes = {x for link in links for x in link}
    wanted = sorted((n, len(reached(links, n))) for n in nodes)
    assert rows(P.affected_counts(graph(spark, links)), "asset_id", "affected") == wanted
    lists = [r for df in written["path-lists"] for r in df.collect()]
    assert len(lists) == 12 + 9 + 1 + 1 and max(r.n for r in lists) == 9 + 8 + 1 and "path-round" not in written
    assert sum(len(r.bigs) for r in lists) == 12 + 9 + 1 and all(not r.ids for r in written["path-lists"][-1].collect())
    monkeypatch.setattr(P, "LISTED", 6)
    written.clear()
    assert rows(P.affected_counts(graph(spark, links)), "asset_id", "affected") == wanted
    assert max(r.n for df in written["path-lists"] for r in df.collect()) < 12


def test_estimates_merge_each_link_once(spark, monkeypatch):
    """A chain of 12: sketches are stored once per unit, not once more for each hop."""
    links = [(f"c{k:02d}", f"c{k + 1:02d}") for k in range(12)]
    rows = []

    def count(df, purpose):
        found = materialize(df, purpose)
        rows.append(found.count() if purpose == "path-sketches" else 0)
        return found

    monkeypatch.setattr(P, "materialize", count)
    found = {r.asset_id: r.estimate for r in P.affected_estimates(graph(spark, links)).collect()}
    assert found == {f"c{k:02d}": 12 - k for k in range(13)} and sum(rows) == 12


def test_a_step_of_lineage_joins_one_number(spark, rows, monkeypatch):
    """Names are not joined to links, rounds hold two numbers a row, and a node on both ways is told apart."""
    written = {}

    def keep(df, purpose):
        found = materialize(df, purpose)
        written.setdefault(purpose, []).append(found)
        return found

    monkeypatch.setattr(P, "materialize", keep)
    asked = spark.createDataFrame([("a", "both"), ("m", "upstream")], "asset_id string, direction string")
    found = P.transitive_lineage(asked, graph(spark, [("a", "b"), ("b", "a"), ("b", "m"), ("m", "m")]))
    assert rows(found, "asset_id", "side", "node", "depth") == [
        ("a", "downstream", "b", 1), ("a", "downstream", "m", 2), ("a", "upstream", "b", 1), ("m", "upstream", "a", 2), ("m", "upstream", "b", 1)
    ]
    assert all(dict(df.dtypes) == {"asset_id": "bigint", "node": "bigint"} for df in written["path-round"])
    assert dict(written["path-links"][-1].dtypes) == {"a": "bigint", "b": "bigint"}
