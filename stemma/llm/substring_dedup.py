"""Repeated passages by content-defined chunks.

A gear hash rolls over the bytes of each text: every byte shifts the hash by one bit and adds a random
number, so it depends on the last 32 bytes only. A chunk ends where the top bits are zero, so an insertion
moves the ends near it and no others. A chunk's digest is 64 bits of hash and its length. Chunks whose digest occurs in
more than one row are repeated; adjacent ones form a run, and runs of at least ``LEAST_WORDS`` words are
reported. Of a repeated chunk, the row with the smallest id keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import row_key, stored, whole_text
from stemma.llm.text_arrays import PART, RangeHash, random_bits, word_edges

#: Bytes that a chunk has at least and, where no end is found, at most.
LEAST_BYTES, MOST_BYTES = 16, 256
#: Top bits of the hash that are zero at an end: one byte in 2**5 on average.
ZERO_BITS = 5
#: Bytes that the 32-bit hash depends on.
REACH = 32
#: Shorter runs are not reported. A passage loses part of its first and last chunk.
LEAST_WORDS = 15


def gear_ends(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Offsets after which the gear hash says that a chunk ends, in order."""
    found = []
    for a in range(0, len(data), PART):
        begin = max(0, a - REACH)
        h = table[data[begin : a + PART]]
        for shift in (1, 2, 4, 8, 16):  # after these, each entry is the sum over its last 32 bytes
            h[shift:] += h[:-shift] << np.uint32(shift)
        ends = np.flatnonzero((h >> np.uint32(32 - ZERO_BITS)) == 0) + begin + 1
        found.append(ends[ends > a])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def chunk_edges(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Offsets of all chunk edges, 0 and the length included; no UTF-8 character is cut."""
    if not len(data):
        return np.zeros(1, dtype=np.int64)
    follows = (data & 0xC0) == 0x80
    ends = gear_ends(data, table)
    ends = ends[ends < len(data)]
    ends = ends[~follows[ends]]
    edges, last = [0], 0

    def force(until: int) -> None:
        nonlocal last
        while until - last > MOST_BYTES:
            last += MOST_BYTES
            while follows[last]:
                last -= 1
            edges.append(last)

    for end in ends.tolist():
        if end - last > MOST_BYTES:
            force(end)
        if end - last >= LEAST_BYTES:
            edges.append(end)
            last = end
    force(len(data))
    edges.append(len(data))
    return np.array(edges, dtype=np.int64)


def chunk_rows(docs: DataFrame, places: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per chunk: doc_id, key, digest, n_bytes, and with ``places`` its code points (first, end) and n_words."""
    kind = docs.schema[id_col].dataType.simpleString()
    table = random_bits(256, 11).astype(np.uint32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RangeHash()

        def digests(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
            out, at = [], 0
            while at < len(edges) - 1:
                end = max(at + 1, int(np.searchsorted(edges, edges[at] + PART, side="right")) - 1)
                base = edges[at]
                out.append(hasher(data[base : edges[end]], edges[at:end] - base, edges[at + 1 : end + 1] - base))
                at = end
            return np.concatenate(out)

        for batch in batches:
            row, digest, size, first, last, words = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                data = np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8)
                if not len(data):
                    continue
                edges = chunk_edges(data, table)
                row.append(np.full(len(edges) - 1, i))
                digest.append(digests(data, edges))
                size.append(np.diff(edges))
                if places:
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[edges]
                    first.append(points[:-1])
                    last.append(points[1:])
                    words.append(np.diff(np.searchsorted(word_edges(data)[0], edges)))
            if not row:
                continue
            rows = pa.array(np.concatenate(row), pa.int64())
            columns = [
                batch.column(0).take(rows), batch.column(1).take(rows),
                pa.array(np.concatenate(digest).view(np.int64)), pa.array(np.concatenate(size), pa.int32()),
            ]
            fields = ["doc_id", "key", "digest", "n_bytes"]
            if places:
                columns += [pa.array(np.concatenate(x), pa.int64()) for x in (first, last, words)]
                fields += ["first", "end", "n_words"]
            made = pa.RecordBatch.from_arrays(columns, fields)
            for a in range(0, made.num_rows, 100_000):
                yield made.slice(a, 100_000)

    rows_in = docs.select(
        F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"),
        F.col(text_col).cast("string").alias("text"),
    )
    schema = f"doc_id {kind}, key long, digest long, n_bytes int" + ", first long, end long, n_words long" * places
    return rows_in.mapInArrow(cut, schema)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks that more than one row has: doc_id, key, first, end, n_words and the owner that keeps them.

    Counted before the shuffle, and each digest is one row of the counts. They are stored, so both sides of the join with all
    chunks are shuffled anew: the form in which a digest that a third of all rows have splits as a skewed left side.
    """
    met = stored(
        chunk_rows(docs, False, id_col, text_col)
        .groupBy("digest", "n_bytes")
        .agg(F.min("doc_id").alias("owner"), F.min("key").alias("low"), F.max("key").alias("high"))
        .where("low <> high")
        .drop("low", "high"),
        "chunk-counts",
    )
    return chunk_rows(docs, True, id_col, text_col).join(met, ["digest", "n_bytes"]).drop("digest", "n_bytes")


def _spans(first: str, end: str, where: Column) -> Column:
    return F.sort_array(F.collect_list(F.when(where, F.struct(F.col(first).alias("start"), F.col(end).alias("end")))))


def repeated_passages(
    docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n_chars, repeated_words, removed_words, repeats, removed, owners.

    ``repeats`` are the spans (code points, end exclusive) of the row's runs, ``removed`` those parts of them that
    another row keeps, ``owners`` the ids of the rows that keep them. Repeats inside one row alone are not
    reported. Rows with the same id and text count as one row and get the same result. Rows with a null id own a
    chunk only where all its rows have none; then nothing of it is removed. Null and empty texts have no chunks.
    """
    in_row = Window.partitionBy("doc_id", "key")
    ordered = in_row.orderBy("first")
    chunks = (
        repeated_chunks(docs, id_col, text_col)
        .repartition("doc_id", "key")
        .dropDuplicates(["doc_id", "key", "first"])
        .withColumn("gone", ~F.col("doc_id").eqNullSafe(F.col("owner")) & F.col("owner").isNotNull())
        .withColumn("new_run", (F.col("first") != F.lag("end", 1, -1).over(ordered)).cast("int"))
        .withColumn("run", F.sum("new_run").over(ordered))
        .withColumn(
            "new_part",
            ((F.col("new_run") == 1) | (F.col("gone") != F.lag("gone", 1, False).over(ordered))).cast("int"),
        )
        .withColumn("part", F.sum("new_part").over(ordered))
    )
    parts = chunks.groupBy("doc_id", "key", "run", "part", "gone").agg(
        F.min("first").alias("first"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"),
        F.collect_set("owner").alias("owners"),
    )
    runs = parts.groupBy("doc_id", "key", "run").agg(
        F.min("first").alias("first"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"),
        F.sum(F.when(F.col("gone"), F.col("n_words")).otherwise(0)).alias("gone_words"),
        _spans("first", "end", F.col("gone")).alias("gone_parts"),
        F.flatten(F.collect_list("owners")).alias("owners"),
    ).where(F.col("n_words") >= least_words)
    found = runs.groupBy("doc_id", "key").agg(
        F.sum("n_words").alias("repeated_words"), F.sum("gone_words").alias("removed_words"),
        _spans("first", "end", F.lit(True)).alias("repeats"),
        F.sort_array(F.flatten(F.collect_list("gone_parts"))).alias("removed"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("owners")))).alias("owners"),
    )
    every = docs.select(
        F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"),
        F.char_length(whole_text(F.col(text_col))).cast("long").alias("n_chars"),
    )
    right = found.withColumnsRenamed({"doc_id": "of", "key": "of_key"})
    none = "array()"
    spans = "array<struct<start:bigint,end:bigint>>"
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        every.join(right, (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
        .select(
            "doc_id", "key", "n_chars",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("repeated_words", "removed_words")],
            *[F.coalesce(c, F.expr(f"cast({none} as {spans})")).alias(c) for c in ("repeats", "removed")],
            F.coalesce("owners", F.expr(f"cast({none} as array<{kind}>)")).alias("owners"),
        )
    )


def without_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the ``removed`` spans of :func:`repeated_passages` cut out of the text; a null text stays null."""
    cuts = found.where(F.size("removed") > 0).select(F.struct("doc_id", "key", "removed").alias("cut")).distinct()
    text, spans = F.col(f"row.{text_col}"), F.col("cut.removed")
    kept = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            text,
            F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0).cast("int") + 1,
            (F.coalesce(F.get(spans, i)["start"], F.char_length(text).cast("long"))
             - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)).cast("int"),
        ),
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.withColumn("key", row_key(F.col(f"row.{id_col}"), text)).join(
        cuts, (F.col("key") == F.col("cut.key")) & F.col(f"row.{id_col}").eqNullSafe(F.col("cut.doc_id")), "left"
    )
    new = F.when(F.col("cut").isNull(), text).otherwise(F.array_join(kept, ""))
    return joined.withColumn("new", new).select(
        *[F.col("new").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )
