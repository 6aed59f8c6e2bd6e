"""Resharding with the fewest moved bytes, by minimum-cost flow.

A layout is a folder of blocks ``shard=S/part=P``. Rows of a shard fall in size, are numbered in that order
(their slot) and are cut into blocks by range partitions, so no shard has to fit into a task. Resharding works on sums first:
the bytes of each old shard are supplies, the new capacities are demands, a byte that stays costs nothing and a byte that moves
costs one (or what the caller says). The flow between shards says which runs of each old shard go where: the front stays, the
rest is cut into one run per new shard. A cut goes to the row whose middle is nearest, and since rows fall in size it
meets short rows. Only blocks with moved rows are read and written anew; all others stay the files they were and are named in the new
manifest. Slots in the new shards follow from the old ones by adding.

The flow is solved on the driver over shards, never rows. The number of blocks has a fixed bound, so their list may reach every task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.common import stored, whole_text
from stemma.llm.ranks import in_order, part_of, starts

#: Size of a row beside its text.
ROW_BYTES = 16
BLOCK_BYTES = 128 << 20
#: Blocks of a shard at least (about), and of a layout at most (about; shards are added).
BLOCKS_PER_SHARD = 8
MAX_BLOCKS = 50_000


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (none if null) and ``ROW_BYTES``."""
    return F.octet_length(whole_text(text)).cast("long") + ROW_BYTES


def write_layout(docs: DataFrame, path: str, shard: Column, shards: int, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Write ``docs`` as a first layout: ``shard`` says where a row goes (0 to ``shards`` - 1).

    All columns are kept, in a struct, so any name is free to use. Rows that are equal in all columns are rows of their own.
    """
    text, doc_id = F.col(f"row.`{text_col}`"), F.col(f"row.`{id_col}`")
    rows = docs.select(
        shard.cast("int").alias("shard"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ).withColumn("size", row_size(text))
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = min(MAX_BLOCKS, max(BLOCKS_PER_SHARD * shards, -(-total // BLOCK_BYTES)))
    order = [F.asc("shard"), F.desc("size"), F.asc_nulls_first("doc_id"), F.asc("digest")]
    keyed = rows.withColumn("doc_id", doc_id).withColumn("digest", F.xxhash64(text))
    placed = in_order(keyed, order, parts).drop("doc_id", "digest").withColumn("part", part_of(F.col("at")))
    placed.limit(0).write.parquet(f"{path}/schema")  # an empty layout has no files that would tell it
    placed.write.partitionBy("shard", "part").option("compression", "zstd").parquet(f"{path}/v0")


def _first_layout(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).option("basePath", f"{path}/v0").parquet(*(folders or [f"{path}/v0"]))


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def cheapest_flow(supply: list[int], demand: list[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Bytes from each old to each new shard that meet all demands at the least cost.

    ``cost`` is per byte; without it a byte that stays in its shard costs 0 and any other 1.
    Successive shortest paths with potentials: as dense matrices, one search per saturated shard.
    """
    n, m = len(supply), len(demand)
    if sum(supply) != sum(demand):
        raise ValueError("supplies and demands differ")
    if cost is None:
        cost = 1 - np.eye(n, m, dtype=np.int64)
    flow = np.zeros((n, m), dtype=np.int64)
    left, open_ = np.array(supply, dtype=np.int64), np.array(demand, dtype=np.int64)
    price_from, price_to = np.zeros(n), cost.min(axis=0).astype(float) if n else np.zeros(m)
    while left.any():
        far_from = np.where(left > 0, 0.0, np.inf)
        far_to, via_to, via_from = np.full(m, np.inf), np.full(m, -1), np.full(n, -1)
        done_from, done_to = np.zeros(n, dtype=bool), np.zeros(m, dtype=bool)
        goal = -1
        while goal < 0:
            a = np.argmin(np.where(done_from, np.inf, far_from))
            b = np.argmin(np.where(done_to, np.inf, far_to))
            at_a = np.inf if done_from[a] else far_from[a]
            at_b = np.inf if done_to[b] else far_to[b]
            if at_b <= at_a:
                done_to[b] = True
                if open_[b]:
                    goal = b
                    break
                # Bytes that flow into b can be sent back.
                back = np.where((flow[:, b] > 0) & ~done_from, at_b - (cost[:, b] + price_from - price_to[b]), np.inf)
                closer = back < far_from
                far_from[closer], via_from[closer] = back[closer], b
            else:
                done_from[a] = True
                ahead = np.where(done_to, np.inf, at_a + cost[a] + price_from[a] - price_to)
                closer = ahead < far_to
                far_to[closer], via_to[closer] = ahead[closer], a
        length = far_to[goal]
        path, b = [], goal
        while True:
            a = via_to[b]
            path.append((a, b))
            if via_from[a] < 0:
                break
            b = via_from[a]
        start = path[-1][0]
        amount = min(left[start], open_[goal], *(flow[a, via_from[a]] for a, _ in path[:-1]))
        for a, b in path:
            flow[a, b] += amount
        for a, _ in path[:-1]:
            flow[a, via_from[a]] -= amount
        left[start] -= amount
        open_[goal] -= amount
        price_from += np.minimum(far_from, length)
        price_to += np.minimum(far_to, length)
    return flow


def _runs(flow: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(old shard, new shard, first byte, end): the bytes that stay come first."""
    out = []
    for old in range(flow.shape[0]):
        at = 0
        for new in sorted(np.flatnonzero(flow[old]).tolist(), key=lambda j: (j != old, j)):
            out.append((old, new, at, at + int(flow[old, new])))
            at += int(flow[old, new])
    return out


def _row_cuts(rows: DataFrame, blocks: DataFrame, cuts: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """For each cut (shard, byte): how many rows of the shard have their middle before it.

    Rows of the blocks that hold a cut are summed up; the others are known by their sums.
    """
    if not cuts:
        return {}
    wanted = rows.sparkSession.createDataFrame(cuts, "of int, cut long")
    inside = (F.col("shard") == F.col("of")) & (F.col("cut") >= F.col("before_bytes")) & (
        F.col("cut") < F.col("before_bytes") + F.col("bytes")
    )
    # One row per cut: at most as many as pairs of shards.
    hit = F.broadcast(
        blocks.join(F.broadcast(wanted), inside).select("of", F.col("part").alias("of_part"), "cut", "before", "before_bytes")
    )
    upto = Window.partitionBy("shard", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    same = (F.col("shard") == F.col("of")) & (F.col("part") == F.col("of_part"))
    summed = rows.join(hit.select("of", "of_part").distinct(), same, "left_semi").withColumn(
        "ahead", F.coalesce(F.sum("size").over(upto), F.lit(0))
    )
    middle = 2 * (F.col("before_bytes") + F.col("ahead")) + F.col("size")
    counted = summed.join(hit, same).groupBy("shard", "cut").agg(
        (F.first("before") + F.count_if(middle < 2 * F.col("cut"))).alias("slot")
    )
    return {(r.shard, r.cut): r.slot for r in counted.collect()}


def reshard(spark: SparkSession, path: str, old_shards: int, capacities: list[int] | None = None, shards: int | None = None,
            cost: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Bring a layout to new capacities (bytes; or ``shards`` equal ones) and give the transfers (old, new, rows).

    Writes ``v1`` with the moved rows and the rest of their blocks, and ``manifest`` with the blocks that stay. The old files are not
    changed, so a run that fails leaves the layout as it was. An empty layout has no transfers.
    """
    rows = _first_layout(spark, path).select("shard", "part", "at", "size")
    upto = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(
        starts(rows, "shard", F.sum("size").alias("bytes")).withColumn(
            "before_bytes", F.coalesce(F.sum("bytes").over(upto), F.lit(0))
        ),
        "reshard-blocks",
    )
    known = {r[0]: (r[1], r[2]) for r in blocks.groupBy("shard").agg(F.sum("bytes"), F.sum("n_rows")).collect()}
    supply = [known.get(k, (0, 0))[0] for k in range(old_shards)]
    capacities = capacities or equal_capacities(sum(supply), shards or old_shards)
    runs = _runs(cheapest_flow(supply, capacities, cost))
    slots = _row_cuts(rows, blocks, [(old, low) for old, _, low, _ in runs if low])
    placed = []
    for k, (old, new, low, _) in enumerate(runs):
        last = k + 1 == len(runs) or runs[k + 1][0] != old
        end = known[old][1] if last else slots[old, runs[k + 1][2]]
        placed.append((old, new, slots[old, low] if low else 0, end))
    size_of: dict[int, int] = {}
    moves = []
    for old, new, low, end in sorted(placed, key=lambda r: (r[1], r[0] != r[1], r[0])):
        moves.append((old, new, low, end, size_of.get(new, 0) - low))
        size_of[new] = size_of.get(new, 0) + end - low
    _rewrite(spark, path, blocks, moves)
    return [(old, new, end - low) for old, new, low, end, _ in moves if end > low]


def _rewrite(spark: SparkSession, path: str, blocks: DataFrame, moves: list[tuple[int, int, int, int, int]]) -> None:
    stay = spark.createDataFrame(
        [(old, end) for old, new, _, end, _ in moves if old == new], "of int, stays_to long"
    )
    fixed = F.col("before") + F.col("n_rows") <= F.coalesce("stays_to", F.lit(0))
    # Blocks and moves have fixed bounds: MAX_BLOCKS and the pairs of shards.
    told = blocks.join(F.broadcast(stay), F.col("shard") == F.col("of"), "left").select(
        "shard", "part", "first", "before", fixed.alias("stays")
    )
    told = stored(told.coalesce(1), "reshard-manifest")
    told.write.mode("overwrite").parquet(f"{path}/manifest")
    run = spark.createDataFrame(moves, "of_shard int, new_shard int, low long, end long, shift long")
    inside = (F.col("shard") == F.col("of_shard")) & (F.col("slot") >= F.col("low")) & (F.col("slot") < F.col("end"))
    (
        _slotted(spark, path, told.where("not stays"))
        .join(F.broadcast(run), inside)
        .select(F.col("new_shard").alias("shard"), (F.col("slot") + F.col("shift")).alias("slot"), "size", "row")
        .write.partitionBy("shard").option("compression", "zstd").mode("overwrite").parquet(f"{path}/v1")
    )


def _slotted(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    """(shard, slot, size, row) of these blocks of the first layout; no other file is read."""
    folders = [f"{path}/v0/shard={r.shard}/part={r.part}" for r in blocks.select("shard", "part").collect()]
    rows = _first_layout(spark, path, folders)
    named = F.broadcast(blocks.select(F.col("shard").alias("of"), F.col("part").alias("of_part"), "first", "before"))
    same = (F.col("shard") == F.col("of")) & (F.col("part") == F.col("of_part"))
    return rows.join(named, same).select(
        "shard", (F.col("before") + F.col("at") - F.col("first")).alias("slot"), "size", "row"
    )


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """(shard, slot, size, row) of the resharded layout: blocks that stayed and the files written anew."""
    told = spark.read.parquet(f"{path}/manifest")
    kept = _slotted(spark, path, told.where("stays"))
    return kept.unionByName(spark.read.schema(kept.schema).parquet(f"{path}/v1"))


def resharded(
    docs: DataFrame, path: str, old_shards: int, new_shards: int, text_col: str = "text", id_col: str = "doc_id",
    shard: Column | None = None,
) -> DataFrame:
    """Lay ``docs`` out over ``old_shards`` and bring them to ``new_shards`` of near equal bytes: (shard, slot, size, row).

    Rows go to their first shard by a hash of the id unless ``shard`` says otherwise. A null id is an id as any other; a null
    text has the size of an empty one. Repeated rows each have their place. Shards differ by about the size of a row at a cut; a
    row above the capacity fills its shard alone. Fewer rows than shards leave shards empty. An empty table gives no rows.
    """
    where = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(old_shards)) if shard is None else shard
    write_layout(docs, path, where, old_shards, text_col, id_col)
    reshard(docs.sparkSession, path, old_shards, shards=new_shards)
    return read_layout(docs.sparkSession, path)
