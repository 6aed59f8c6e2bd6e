"""Documents whose sets of word n-grams have a Jaccard similarity at or above a threshold.

1. Signatures: one MinHash value per hash function over all n-grams of the whole text. Texts with equal
   sets form one class, so copies are compared once.
2. Candidates: classes meet where all rows of a band agree. Bands and rows are chosen for a target recall
   (:func:`choose_bands`). Within a band bucket, whole signatures are compared; pairs that a pair at
   the threshold would fall below with a chance under ``SCREEN_LOSS`` are dismissed. What is left is not
   listed pair by pair: a bucket gives a spanning forest, and the forests of all buckets give families.
3. Verification: the full n-gram sets of a family meet in blocks of at most ``BLOCK`` classes by ``BLOCK``, and
   every pair of a block is counted exactly. A block gives the number of links per class and a spanning forest
   of the links, never the pairs.

A bucket or family that holds a third of all rows is dealt out block by block, so no task sees more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import row_key, stored
from stemma.llm.components import connected_components
from stemma.llm.text_arrays import RangeHash, random_bits, scrambled, shingles, word_hashes

WORDS = 5
SIMILARITY = 0.8
#: Chance to meet for a pair exactly at the threshold.
RECALL = 0.9999
HASHES = 128
#: Chance that a pair at the threshold is dismissed by its signature.
SCREEN_LOSS = 1e-9
#: Classes on one side of a block.
BLOCK = 512
#: Columns of a block's membership matrix that are multiplied at once.
COLUMNS = 4096


def choose_bands(similarity: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band with which a pair at ``similarity`` still meets with chance ``recall``."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


def least_agreement(similarity: float, loss: float = SCREEN_LOSS, hashes: int = HASHES) -> int:
    """Signature values that a pair at ``similarity`` has in common, but for a chance of ``loss``."""
    below = 0.0
    for k in range(hashes + 1):
        below += math.comb(hashes, k) * similarity**k * (1 - similarity) ** (hashes - k)
        if below > loss:
            return k
    return hashes


def signature_rows(
    docs: DataFrame, n: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, key, n_grams, digest of the set, band hashes, and 8 bits of each MinHash value."""
    kind = docs.schema[id_col].dataType.simpleString()
    factor = (random_bits(HASHES, 1) | np.uint64(1)).astype(np.uint32)
    shift = random_bits(HASHES, 2).astype(np.uint32)
    mixing = random_bits(rows, 3) | np.uint64(1)
    number = random_bits(bands, 4)

    def smallest(grams: np.ndarray) -> np.ndarray:
        folded = (grams >> np.uint64(32)).astype(np.uint32)
        best = None
        for a in range(0, len(folded), 2048):
            block = folded[None, a : a + 2048] * factor[:, None]
            block += shift[:, None]
            low = block.min(axis=1)
            best = low if best is None else np.minimum(best, low)
        return best

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RangeHash()
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            count, digest, band, low = [], [], [], []
            for words in word_hashes(texts, hasher):
                grams = shingles(words, n)
                count.append(len(grams))
                if not len(grams):
                    digest.append(None)
                    band.append(None)
                    low.append(None)
                    continue
                two = [scrambled(grams ^ k).sum(dtype=np.uint64) for k in random_bits(2, 5)]
                digest.append(np.array(two, dtype=np.uint64).tobytes())
                values = smallest(grams)
                low.append((values & np.uint32(255)).astype(np.uint8).tobytes())
                rowed = values[: bands * rows].reshape(bands, rows).astype(np.uint64)
                band.append(scrambled((rowed * mixing).sum(axis=1, dtype=np.uint64) ^ number).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(digest, pa.binary()),
                    pa.array(band, pa.list_(pa.int64())), pa.array(low, pa.binary()),
                ],
                ["doc_id", "key", "n_grams", "digest", "bands", "low"],
            )

    rows_in = docs.select(
        F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"),
        F.col(text_col).cast("string").alias("text"),
    )
    return rows_in.mapInArrow(
        describe, f"doc_id {kind}, key long, n_grams long, digest binary, bands array<long>, low binary"
    )


def in_blocks(rows: DataFrame, size: str, block: int, *key: str) -> DataFrame:
    """``rows`` dealt to pairs of blocks of their group: adds low_block, high_block and side, sorted by group.

    A group of ``size`` rows has ``size / block`` blocks; a row meets every block once.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = (
        rows.withColumn("blocks", blocks)
        .withColumn("side", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low_block", F.least("side", "other"))
        .withColumn("high_block", F.greatest("side", "other"))
        .drop("blocks", "other", size)
    )
    together = [*key, "low_block", "high_block"]
    return dealt.repartition(*together).sortWithinPartitions(*together)


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``key`` of a sorted partition."""
    held: list[pa.Table] = []
    name = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        columns = [table.column(k).to_pylist() for k in key]
        keys = list(zip(*columns))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if held and keys[at] != name:
                yield held[0] if len(held) == 1 else pa.concat_tables(held)
                held = []
            name = keys[at]
            held.append(table.slice(at, end - at))
            at = end
    if held:
        yield held[0] if len(held) == 1 else pa.concat_tables(held)


def _sides(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct classes of a block: names, their first rows, and which are on the low and the high side."""
    names = table.column("digest").to_pylist()
    first: dict[bytes, int] = {}
    for i, d in enumerate(names):
        first.setdefault(d, i)
    rows = np.fromiter(first.values(), dtype=np.int64)
    side = table.column("side").to_numpy()[rows]
    low, high = table.column("low_block")[0].as_py(), table.column("high_block")[0].as_py()
    return list(first), rows, np.flatnonzero(side == low), np.flatnonzero(side == high)


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, names: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Stars that connect what the links between ``left`` and ``right`` (rows and columns of ``linked``) connect.

    The centre is the smallest name, so stars of several buckets with the same classes have the same edges.
    """
    label = np.arange(len(names))
    for r, i in enumerate(left):
        for other in np.unique(label[right[linked[r]]]):
            if other != label[i]:
                label[label == other] = label[i]
    members: dict[int, list[bytes]] = {}
    for name, group in zip(names, label.tolist()):
        members.setdefault(group, []).append(name)
    return [(centre, m) for group in members.values() if (centre := min(group)) for m in group if m != centre]


EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])


def _edge_batch(rows: list[tuple[bytes, bytes | None, int]]) -> pa.RecordBatch:
    a, b, links = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], schema=EDGE
    )


def candidate_edges(reps: DataFrame, least: int) -> DataFrame:
    """Spanning forests (a, b) of the pairs that meet in a band and pass the comparison of signatures."""
    spread = reps.select("digest", F.posexplode("bands").alias("band", "hash"))
    # Stored, so that both sides of the join are shuffled anew and a bucket of many classes splits as a skewed left side.
    met = stored(spread.groupBy("band", "hash").count().where("count > 1"), "ngram-buckets")
    members = spread.join(met, ["band", "hash"]).join(reps.select("digest", "low"), "digest")
    dealt = in_blocks(members, "count", BLOCK, "band", "hash")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for table in groups(batches, ["band", "hash", "low_block", "high_block"]):
            names, rows, left, right = _sides(table)
            if len(names) < 2 or not len(left) or not len(right):
                continue
            held = table.column("low").to_pylist()
            low = np.frombuffer(b"".join([held[i] for i in rows]), dtype=np.uint8).reshape(len(rows), -1)
            if len(names) == 2:
                if int((low[0] == low[1]).sum()) >= least:
                    out.append((names[0], names[1], 0))
            else:
                linked = np.stack([(low[right] == low[i]).sum(axis=1) >= least for i in left])
                out += [(a, b, 0) for a, b in _forest(linked, left, right, names)]
            if len(out) > 20_000:
                yield _edge_batch(out)
                out = []
        yield _edge_batch(out)

    return dealt.mapInArrow(screen, "a binary, b binary, links long").select("a", "b")


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of common members for each pair of ``left`` and ``right``."""
    everything = np.concatenate(sets)
    _, ids, seen = np.unique(everything, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = seen[ids] > 1  # a member that one set has is in no intersection
    renumbered = np.cumsum(seen > 1) - 1
    ids, owner = renumbered[ids[shared]], owner[shared]
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for a in range(0, int(ids[-1]) + 1 if len(ids) else 0, COLUMNS):
        lo, hi = np.searchsorted(ids, [a, a + COLUMNS])
        matrix = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        matrix[owner[lo:hi], ids[lo:hi] - a] = 1
        out += np.rint(matrix[left] @ matrix[right].T).astype(np.int64)
    return out


def verified_links(family: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """Rows (a, b, 0) of a spanning forest of the links and (a, null, links) with parts of the link counts.

    ``family`` has digest, component, members and size; ``texts`` has digest and text.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows repeated with their id and text have one digest and meet in few tasks: each task sends one set of them.
        hasher, seen = RangeHash(), set()
        for batch in batches:
            new = []
            for i, digest in enumerate(batch.column("digest").to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            sets = [shingles(w, n).tobytes() for w in word_hashes(texts, hasher)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(sets, pa.large_binary())], ["digest", "grams"])

    sets = texts.select("digest", "text").mapInArrow(gather, "digest binary, grams binary")
    dealt = in_blocks(sets.join(family, "digest"), "members", BLOCK, "component")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for table in groups(batches, ["component", "low_block", "high_block"]):
            names, rows, left, right = _sides(table)
            if len(names) < 2 or not len(left) or not len(right):
                continue
            held = table.column("grams")
            found = [np.frombuffer(held[int(i)].as_py(), dtype=np.uint64) for i in rows]
            size = table.column("size").to_numpy()[rows]
            length = np.array([len(s) for s in found])
            both = _common(found, left, right)
            linked = both / (length[left][:, None] + length[right][None, :] - both) >= similarity
            linked &= left[:, None] != right[None, :]
            links = np.zeros(len(names), dtype=np.int64)
            links[left] += (linked * size[right][None, :]).sum(axis=1)
            if left[0] != right[0]:
                links[right] += (linked * size[left][:, None]).sum(axis=0)
            out += [(names[i], None, int(links[i])) for i in np.flatnonzero(links)]
            out += [(a, b, 0) for a, b in _forest(linked, left, right, names)]
            if len(out) > 20_000:
                yield _edge_batch(out)
                out = []
        yield _edge_batch(out)

    return dealt.mapInArrow(verify, "a binary, b binary, links long")


def similar_documents(
    docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, component, class_id, copies, n_links.

    n_links is the number of other rows whose n-gram set is similar enough, equal ones included; class_id is the
    smallest doc_id of the rows that links connect; copies is the number of rows with an equal set. A text of
    fewer than ``n`` words is one n-gram. A text without words (null or empty) is alone: it has no links. Repeated rows
    are copies. ``key`` tells rows of one doc_id apart. ``component`` names the rows that links connect, which class_id
    does not if ids are null or repeated; it is null for a text without words. Other columns are not read.
    """
    bands, rows = choose_bands(similarity, recall)
    signed = stored(signature_rows(docs, n, bands, rows, id_col, text_col), "ngram-signatures")
    classes = signed.where("n_grams > 0").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.min("key").alias("first_key"), F.count(F.lit(1)).alias("size")
    )
    classes = stored(classes, "ngram-classes")
    # Copies are the many side on the left, one row per class on the right.
    reps = stored(
        signed.where("n_grams > 0")
        .join(classes.select("digest", F.col("first_key").alias("key")), ["digest", "key"])
        .dropDuplicates(["digest"])
        .select("digest", "doc_id", "key", "bands", "low"),
        "ngram-classes",
    )
    families = connected_components(candidate_edges(reps, least_agreement(similarity)))
    families = families.withColumnsRenamed({"vertex": "digest"})
    sizes = stored(families.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "ngram-sizes")
    family = stored(
        families.join(sizes, "component").join(classes.select("digest", "size"), "digest"), "ngram-families"
    )
    wanted = reps.join(family, "digest", "left_semi").select("digest", "key", F.col("doc_id").alias("of"))
    texts = (
        docs.select(
            F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"),
            F.col(text_col).cast("string").alias("text"),
        )
        .join(wanted, "key")
        .where(F.col("doc_id").eqNullSafe(F.col("of")))
        .select("digest", "text")
    )
    links = stored(verified_links(family, texts, n, similarity), "ngram-links")
    counts = links.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
    named = connected_components(links.where("b is not null").select("a", "b")).withColumnsRenamed({"vertex": "digest"})
    described = classes.join(counts, "digest", "left").join(named, "digest", "left")
    described = described.withColumn("component", F.coalesce("component", "digest"))
    lowest = stored(described.groupBy("component").agg(F.min("first_id").alias("class_id")), "ngram-lowest")
    described = stored(
        described.join(lowest, "component").select("digest", "component", "size", F.coalesce("links", F.lit(0)).alias("links"), "class_id"),
        "ngram-described",
    )
    return signed.select("doc_id", "key", "digest").join(described, "digest", "left").select(
        "doc_id", "key", "component",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("copies"),
        F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).cast("long").alias("n_links"),
    )
