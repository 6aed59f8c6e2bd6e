"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Only the length of a piece decides where it goes, and there are at most ``capacity`` lengths. So the
counts per length, which Spark gathers from all pieces, are the whole input of the packing: it runs
once over them, places equal lengths a run at a time, and is the same as best fit decreasing over
all pieces one by one. A segment tree over remaining capacities finds the tightest open
sequences in logarithmic time. Its state (runs of sequences per remaining capacity) is bounded by the
capacity, whatever the number of documents. Each piece then looks up its place by its rank among
the pieces of its length; ranks are counted in slices, so a length that a third of all pieces have is no hot key.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stemma.llm.common import stored

CAPACITY = 4096
#: Added after each document.
END_ID = 1
#: Pieces of one length that are ranked in one task.
SLICE_ROWS = 20_000
#: Words whose ids a worker remembers; then it starts anew.
KNOWN_WORDS = 400_000
#: Longer words are not remembered.
LONGEST_KNOWN = 48
#: Characters that are split into words at once.
PART = 1 << 20


def default_tokenizer() -> str:
    """Path of the given vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _parts(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at ASCII spaces and line ends only."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        if cut <= at:
            found = [x for x in (text.find(" ", at + size), text.find("\n", at + size)) if x >= 0]
            if not found:
                break
            cut = min(found)
        yield text[at:cut]
        at = cut
    yield text[at:]


#: Words of characters that normalisation leaves alone but for their case: printable ASCII and Latin-1 letters.
SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: Fixed value: how the given vocabulary cuts such a word in lower case.
WORD_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Characters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves, the others follow at 256.
_ITSELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _ITSELF} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_ITSELF)))}
SPECIAL = "<|"
#: Module that a worker process keeps between its tasks.
WORKER_STATE = "packing_worker_state"


def _loaded(path: str):
    """The tokenizer of a path and the ids of known words and parts, once per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    held = sys.modules.setdefault(WORKER_STATE, types.ModuleType(WORKER_STATE)).__dict__
    if path not in held:
        held[path] = Tokenizer.from_file(path), {"": b""}, {}
    return held[path]


def word_ids(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids (little-endian 32 bits) under a tokenizer that never joins across white space.

    Each word between ASCII spaces, tabs and line ends is tokenised once and then remembered, as long as the worker
    process lives. Words of ASCII and Latin-1 letters are cut into parts here and only the parts go to the model, if the
    tokenizer has the rules that this takes; all other words pass through the whole tokenizer.
    """
    tokenizer, known, known_parts = _loaded(path)
    rules = str(tokenizer.pre_tokenizer) + str(tokenizer.normalizer)
    direct = all(x in rules for x in ("NFC", "Lowercase", "'s|'t|'re|'ve|'m|'ll|'d|", "ByteLevel(add_prefix_space=False")) and (
        tokenizer.encode("It's a1 x.y", add_special_tokens=False).ids
        == [t.id for w in ("it", "'s", "a", "1", "x", ".", "y") for t in tokenizer.model.tokenize(w)]
    )
    tokenize = tokenizer.model.tokenize

    def by_parts(word: str) -> bytes:
        made = []
        for part in WORD_PARTS.findall(word.lower()):
            found = known_parts.get(part)
            if found is None:
                told = part if part.isascii() else "".join([BYTE_CHARS[b] for b in part.encode()])
                found = b"".join([t.id.to_bytes(4, "little") for t in tokenize(told)])
                if len(part) <= LONGEST_KNOWN:
                    known_parts[part] = found
            made.append(found)
        return b"".join(made)

    def encode(words: list[str]) -> dict[str, bytes]:
        simple = [w for w in words if direct and SIMPLE.fullmatch(w) and SPECIAL not in w]
        made = {w: by_parts(w) for w in simple}
        others = [w for w in words if w not in made]
        found = tokenizer.encode_batch_fast(others, add_special_tokens=False)
        made.update(zip(others, [np.array(e.ids, dtype="<u4").tobytes() for e in found]))
        return made

    def ids(texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            made = []
            for part in _parts(text, PART):
                words = part.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                new = [w for w in set(words) if w not in known]
                if new:
                    if len(known) + len(new) > KNOWN_WORDS:
                        known.clear()
                        known_parts.clear()
                        known[""] = b""
                        new = list(set(words) - {""})
                    known.update(encode(new))
                made.append(b"".join([known[w] for w in words]))
                for w in new:
                    if len(w) > LONGEST_KNOWN:
                        del known[w]
            out.append(b"".join(made) if len(made) != 1 else made[0])
        return out

    return ids


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and with ``with_ids`` the ids themselves."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        end = np.array([END_ID], dtype="<u4").tobytes()
        step = capacity * 4
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                row, number, start, length, crc, held = [], [], [], [], [], []
                size = 0
                while at < batch.num_rows and size < 8 << 20:
                    encoded = ids_of([texts[at].as_py() or ""])[0] + end
                    size += len(encoded)
                    for k, a in enumerate(range(0, len(encoded), step)):
                        one = encoded[a : a + step]
                        row.append(at)
                        number.append(k)
                        start.append(a // 4)
                        length.append(len(one) // 4)
                        crc.append(zlib.crc32(one))
                        if with_ids:
                            held.append(np.frombuffer(one, dtype="<i4"))
                    at += 1
                columns = [
                    names.take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(held, pa.list_(pa.int32())))
                fields = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, fields)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


class _OpenSequences:
    """Runs of sequences by remaining capacity, with a segment tree over the capacities that have any."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, rest: int, value: int) -> None:
        node = rest + self.width
        while node:
            self.open[node] += value
            node //= 2

    def add(self, rest: int, first: int, count: int) -> None:
        if rest:
            self.runs[rest].append((first, count))
            self._mark(rest, 1)

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that an open sequence has."""
        node = length + self.width
        if self.open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node + (not self.open[2 * node])
                return node - self.width
            node //= 2
        return None

    def take(self, rest: int) -> tuple[int, int]:
        self._mark(rest, -1)
        return self.runs[rest].pop()


def best_fit_places(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where runs of equal lengths go: rows of (length, first rank, first sequence, offset), sorted."""
    tree, made, out = _OpenSequences(capacity), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            rest = tree.tightest(length)
            if rest is None:
                rest, first, count = capacity, made, -(-left // (capacity // length))
                made += count
            else:
                first, count = tree.take(rest)
            each = rest // length  # best fit stays with a sequence until the length no longer fits
            full = min(count, left // each)
            if full:
                for layer in range(each):
                    out.append((length, rank, first, capacity - rest + layer * length))
                    rank += full
                left -= full * each
                tree.add(rest - each * length, first, full)
            if left and full < count:
                for layer in range(left):
                    out.append((length, rank, first + full, capacity - rest + layer * length))
                    rank += 1
                tree.add(rest - left * length, first + full, 1)
                full, left = full + 1, 0
            if full < count:
                tree.add(rest, first + full, count - full)
    out.sort()
    return np.array(out, dtype=np.int64).reshape(-1, 4)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The stored pieces with sequence_id and offset.

    At most ``capacity`` counts reach the driver, and the places sent to the tasks depend on the
    capacity only.
    """
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    slices = max(1, -(-max(counts.values(), default=0) // SLICE_ROWS))
    places = best_fit_places(counts, capacity)
    keys, first, offset = (places[:, 0] << 48) | places[:, 1], places[:, 2], places[:, 3]
    ranks = places[:, 1]

    columns = cut.columns
    held = F.struct(*columns).alias("held")
    rows = cut.select(held, "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).alias("slice"))
    in_slice = Window.partitionBy("length", "slice").orderBy("held.doc_id", "held.piece", "held.ids_crc32")
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "slice").count().select(
        "length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("slice_start")
    )
    ranked = (
        rows.withColumn("in_slice", F.row_number().over(in_slice) - 1)
        .join(starts, ["length", "slice"])
        .select("held.*", (F.col("in_slice") + F.col("slice_start")).alias("rank"))
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            length = table.column("length").to_numpy()
            rank = table.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            out = table.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(first[at] + rank - ranks[at], pa.int64()))
            out = out.append_column("offset", pa.array(offset[at], pa.int64()))
            yield from out.to_batches()

    added = [StructField("sequence_id", LongType()), StructField("offset", LongType())]
    return ranked.mapInArrow(look_up, StructType(cut.schema.fields + added))


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A document is its ids and then ``END_ID``; a null or empty text is that id alone. Only documents of more than
    ``capacity`` ids are cut. Repeated rows are packed as often as they come. An empty table gives no rows.
    Strings that look like special tokens are read as the tokenizer reads them by default.
    """
    cut = pieces(docs, tokenizer or default_tokenizer(), capacity, id_col, text_col, with_ids)
    return place(stored(cut, "pack-pieces"), capacity)
