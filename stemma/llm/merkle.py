"""A Merkle manifest of a data set: a digest per row, a tree per source, a tree of sources.

Leaves are ranked within their tree and the rank is written in digits of base ``FAN``. Within a block of
``FAN ** DIGITS`` ranks the digits are grouped away one after another, the last first: what remains of
a group is the digest of its children and the children themselves as an array of structs. After ``DIGITS`` groupings, which
all run behind one shuffle by block, a block is one row that holds its part of the tree. Blocks are the leaves of the next
round, until a tree is one block. On the way down a block gets the path above it as a second row of its group, a chain of
``transform`` walks the nested runs, and ``explode`` gives each leaf with all its siblings: no join.

A block is at most 2,187 leaves, a tree has as many rounds as its size needs, and trees are ranked
by range partitions, so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import stored
from stemma.llm.ranks import ranked

#: Nodes of one run.
FAN = 3
#: Levels of the tree that one block holds.
DIGITS = 7
BLOCK = FAN**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    """A value in a leaf: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    told = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _level(k: int) -> Column:
    """Whether level ``k`` of the row's tree has several nodes, so that its runs are hashed."""
    return F.col("n") > FAN**k


def _climb(nodes: DataFrame, purpose: str) -> DataFrame:
    """Stored blocks (tree, block, n, digest, run) of nodes (tree, rank, n, digest, below).

    ``n`` counts the tree's nodes on the lowest level. ``run`` nests the block's tree down to ``below``.
    """
    digit = [F.floor(F.col("rank") / FAN**k) % FAN for k in range(DIGITS)]
    at = nodes.select(
        "tree", F.floor(F.col("rank") / BLOCK).alias("block"), "n",
        *[d.cast("int").alias(f"d{k}") for k, d in enumerate(digit)], "digest", "below",
    ).repartition("tree", "block")
    for k in range(DIGITS):
        child = F.struct(F.col(f"d{k}").alias("digit"), "digest", "below")
        at = at.groupBy("tree", "block", "n", *[f"d{j}" for j in range(k + 1, DIGITS)]).agg(
            F.sort_array(F.collect_list(child)).alias("below")
        )
        digests = F.col("below.digest")
        at = at.withColumn(
            "digest", F.when(_level(k), F.sha2(F.concat_ws("", digests), 256)).otherwise(F.get(digests, F.lit(0)))
        )
    return stored(at.withColumnRenamed("below", "run"), purpose)


def _rounds(nodes: DataFrame, purpose: str) -> list[DataFrame]:
    """Blocks, blocks of blocks and so on; each tree of the last round is one block."""
    found = [_climb(nodes, purpose)]
    while (found[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        above = found[-1].select(
            "tree", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), "digest",
            F.struct(F.col("block").alias("rank")).alias("below"),
        )
        found.append(_climb(above, purpose))
    return found


def _step(run: Column, i: Column, k: int) -> Column:
    """The siblings of place ``i`` in a run of level ``k``, as an array of one step (none where the run is not hashed)."""
    digests = F.transform(run, lambda c: c["digest"])
    step = F.struct(
        F.concat_ws("", F.slice(digests, F.lit(1), i)).alias("before"),
        F.concat_ws("", F.slice(digests, i + 2, F.lit(FAN))).alias("after"),
    )
    return F.when(_level(k), F.array(step)).otherwise(F.array().cast(STEP))


def _descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, below, digest, path, carried) of every node of ``blocks``.

    ``above`` has for each block (tree, block) the path from it to the root and what else is ``carried`` down.
    """
    both = blocks.select("tree", "block", "n", "run").unionByName(
        above.select("tree", "block", "path", "carried"), allowMissingColumns=True
    )
    one = both.groupBy("tree", "block").agg(
        F.max("n").alias("n"), *[F.first(c, ignorenulls=True).alias(c) for c in ("run", "path", "carried")]
    )

    def walked(run: Column, path: Column, k: int) -> Column:
        return F.transform(
            run,
            lambda c, i: F.struct(
                c["below"].alias("below"), c["digest"].alias("digest"), F.concat(_step(run, i, k), path).alias("path")
            ),
        )

    def below(k: int):
        return lambda p: walked(p["below"], p["path"], k)

    # A column per level: the nested lambdas of a single expression take Catalyst seconds to resolve.
    nodes = one.withColumn("nodes", walked(F.col("run"), F.array().cast(STEP), DIGITS - 1)).drop("run")
    for k in range(DIGITS - 2, -1, -1):
        nodes = nodes.withColumn("nodes", F.flatten(F.transform("nodes", below(k))))
    return nodes.select("tree", "carried", F.col("path").alias("upper"), F.explode("nodes").alias("node")).select(
        "tree", "node.below", "node.digest", F.concat("node.path", "upper").alias("path"), "carried"
    )


def _all_down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    for blocks in reversed(rounds[1:]):
        nodes = _descend(blocks, above)
        above = nodes.select("tree", F.col("below.rank").alias("block"), "path", "carried")
    return _descend(rounds[0], above)


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_col: str = "source", order_col: str = "doc_id",
    shown: Column | None = None,
) -> DataFrame:
    """Per row: doc_id (``order_col``), leaf, shown, subroot, root, and ``path``, its siblings from the leaf to the root.

    ``path`` is an array of (before, after): the siblings' digests joined, left and right of the node, one step per
    level that has several nodes. ``shown`` is a digest that a reader presents instead of the leaf (null: the leaf).

    Null fields are told from empty ones. A null tree comes first and is told from an empty name. Rows ascend by
    ``order_col``, nulls first, equal ids by leaf; rows that are equal in all fields have equal leaves and a place each.
    A tree of one row has its leaf as subroot; one tree alone has its subroot as root. An empty table
    gives no rows. Columns that are not named are not read.
    """
    source = F.col(f"`{tree_col}`").cast("string")
    rows = docs.select(
        # Sorts null first and names by their bytes.
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("tree"),
        F.col(f"`{order_col}`").alias("doc_id"),
        leaf_digest(*[F.col(f"`{c}`") for c in fields]).alias("digest"),
        (F.lit(None).cast("string") if shown is None else shown).alias("shown"),
    )
    order = [F.asc_nulls_first("doc_id"), F.asc("digest")]
    leaves = ranked(stored(rows, "merkle-leaves"), "tree", order, "merkle-order")
    trees = _rounds(
        leaves.select("tree", "rank", "n", "digest", F.struct("doc_id", "shown").alias("below")), "merkle-blocks"
    )
    tops = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    named = ranked(tops, "tree", [F.asc("name")], "merkle-trees")
    top = _rounds(named.select("tree", "rank", "n", "digest", F.struct("name").alias("below")), "merkle-top")

    no_path = F.array().cast(STEP)
    start = top[-1].select("tree", "block", no_path.alias("path"), F.struct(F.col("digest").alias("root")).alias("carried"))
    below_top = _all_down(top, start).select(
        F.col("below.name").alias("tree"), F.lit(0).cast("long").alias("block"), "path",
        F.struct(F.col("digest").alias("subroot"), F.col("carried.root").alias("root")).alias("carried"),
    )
    return _all_down(trees, below_top).select(
        "below.doc_id", F.col("digest").alias("leaf"), "below.shown", "carried.subroot", "carried.root", "path"
    )


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)


def verified(rows: DataFrame) -> DataFrame:
    """Rows of :func:`manifest` with proof_sha256, folded_root and whether it equals the root."""
    back = folded(F.col("path"), F.coalesce("shown", "leaf"))
    return (
        rows.withColumn("proof_sha256", proof_digest(F.col("path")))
        .withColumn("folded_root", back)
        .withColumn("verified", F.col("folded_root") == F.col("root"))
        .drop("path", "shown")
    )


def without_line_ends(docs: DataFrame) -> Column:
    """The tampering of the check: leaf of the row whose text lost its line ends, for half of the ids.

    Ids whose decimal form has an even CRC-32; null ids and null texts stay. Null where nothing changes.
    """
    text = F.col("text")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(text, F.lit("\n"))
    changed = [F.translate(text, "\n", "") if c == "text" else F.col(c) for c in FIELDS]
    return F.when(hit, leaf_digest(*changed))


def comparison_sql() -> str:
    """DuckDB SQL for the check on ``documents``: both trees, proofs and folding as recursive queries."""
    def told(c: str) -> str:
        return f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(told(text if c == "text" else c) for c in FIELDS) + ")"

    def tree(name: str, start: str) -> str:
        return f"""{name}(tree, lvl, idx, n, digest) as (
            {start}
            union all
            select tree, lvl + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' order by idx))
            from {name} where n > 1 group by tree, lvl, n, idx // {FAN}
        ), {name}_step as (
            select a.tree, a.lvl, a.idx, a.n,
                   coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), '') as before,
                   coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '') as after
            from {name} a join {name} b on a.tree = b.tree and a.lvl = b.lvl and a.idx // {FAN} = b.idx // {FAN}
            where a.n > 1 group by all
        )"""

    def fold(name: str, steps: str, start: str) -> str:
        return f"""{name}(id, tree, lvl, idx, node, proof) as (
            {start}
            union all
            select f.id, f.tree, f.lvl + 1, f.idx // {FAN}, sha256(s.before || f.node || s.after), f.proof || s.before || s.after
            from {name} f join {steps} s on f.tree = s.tree and f.lvl = s.lvl and f.idx = s.idx
        )"""

    crc = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(told) + 1), lambda i: ord(told[i])::bigint)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::bigint[]),
            lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))"""
    return f"""
    with recursive d as (
        select *, coalesce('=' || source, '') as tree, cast(doc_id as varchar) as told, {leaf("text")} as leaf,
               {leaf("replace(text, chr(10), '')")} as changed
        from documents
    ), l as (
        select *, row_number() over (order by tree, doc_id nulls first, leaf) as id,
               row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as rank,
               count(*) over (partition by tree) as n,
               case when told is not null and text is not null and xor({crc}, 4294967295) % 2 = 0 then changed else leaf end as shown
        from d
    ), {tree("t", "select tree, 0, rank, n, leaf from l")},
    subroots as (
        select tree, digest, row_number() over (order by tree) - 1 as rank, count(*) over () as n from t where n = 1
    ), {tree("u", "select 'top', 0, rank, n, digest from subroots")},
    {fold("f", "t_step", "select id, tree, 0, rank, shown, '' from l")},
    {fold("g", "u_step", '''select f.id, 'top', 0, s.rank, f.node, f.proof
        from f join l on f.id = l.id join subroots s on s.tree = f.tree
        where (f.id, f.lvl) in (select id, max(lvl) from f group by id)''')}
    select l.doc_id, l.leaf, s.digest as subroot, r.digest as root, sha256(g.proof) as proof_sha256,
           g.node as folded_root, g.node = r.digest as verified
    from l join subroots s on s.tree = l.tree join g on g.id = l.id, (select digest from u where n = 1) r
    where (g.id, g.lvl) in (select id, max(lvl) from g group by id)
    """
