"""Quality scores by nearest-neighbour voting among labelled texts.

A text is a vector of hashed terms: its words, their shapes (runs of letters, capitals, digits and each sign),
words that come again a few words later, and word lengths. A bounded sample of labelled texts gives the latent space
(truncated singular value decomposition of their weighted terms) and the voters. Voters and projection are broadcast:
their size is ``SAMPLE`` x ``RANK`` and ``TERMS`` x ``RANK`` numbers, whatever the input. Every text is projected
and multiplied with all voters, block by block, and its nearest voters vote with their cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import row_key
from stemma.llm.text_arrays import PART, SPACE, RangeHash, parts, word_edges

#: Labelled rows that fit the space and vote, half of them per label as far as there are enough.
SAMPLE = 6000
RANK = 64
NEIGHBOURS = 25
#: A neighbour votes with its cosine to this power.
SHARPNESS = 4
#: Scores below this are predicted as label 0.
THRESHOLD = 0.3
#: Labelled rows with this remainder of crc32(doc_id as text) modulo ``FOLDS`` are held out.
FOLDS, HELD_OUT = 5, 0

WORD_TERMS, SHAPE_TERMS, LAGS, LENGTHS = 2048, 1024, 16, 32
TERMS = WORD_TERMS + SHAPE_TERMS + LAGS + LENGTHS
#: Texts that are multiplied with the voters at once.
BLOCK = 256


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: its lower case, and its class (letters of any script are one class, each ASCII sign its own)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kind = np.arange(256, dtype=np.uint8)
    kind[97:123] = 97
    kind[65:91] = 65
    kind[48:58] = 48
    kind[128:] = 97
    return lower, kind


def term_counter() -> Callable[[list[bytes]], np.ndarray]:
    """A function from at most a few hundred texts to their term counts, one row per text."""
    hasher = RangeHash()
    lower, kind = _tables()

    def of_part(data: np.ndarray, owner_begins: np.ndarray) -> np.ndarray:
        count = len(owner_begins) - 1
        start, end = word_edges(data)
        if not len(start):
            return np.zeros((count, TERMS), dtype=np.float32)
        owner = np.searchsorted(owner_begins, start, side="right") - 1
        words = hasher(lower[data], start, end)
        classes = kind[data]
        new = np.ones(len(data), dtype=bool)
        new[1:] = classes[1:] != classes[:-1]
        new[start] = True
        new &= ~SPACE[data]
        seen = np.concatenate([[0], np.cumsum(new)])
        shapes = hasher(classes[new], seen[start], seen[end])
        base = owner * TERMS
        terms = [
            base + (words % np.uint64(WORD_TERMS)).astype(np.int64),
            base + WORD_TERMS + (shapes % np.uint64(SHAPE_TERMS)).astype(np.int64),
            base + WORD_TERMS + SHAPE_TERMS + LAGS + np.minimum(end - start, LENGTHS) - 1,
        ]
        for lag in range(1, LAGS + 1):
            again = np.flatnonzero((words[lag:] == words[:-lag]) & (owner[lag:] == owner[:-lag]))
            terms.append(base[again] + WORD_TERMS + SHAPE_TERMS + lag - 1)
        counts = np.bincount(np.concatenate(terms), minlength=count * TERMS)
        return counts.astype(np.float32).reshape(count, TERMS)

    def count(texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), TERMS), dtype=np.float32)
        at = 0
        while at < len(texts):
            if len(texts[at]) > PART:
                for part in parts(texts[at]):
                    out[at] += of_part(np.frombuffer(part, dtype=np.uint8), np.array([0, len(part) + 1]))[0]
                at += 1
                continue
            group, size = [texts[at]], len(texts[at])
            while at + len(group) < len(texts) and size + len(texts[at + len(group)]) < PART:
                group.append(texts[at + len(group)])
                size += len(group[-1]) + 1
            begins = np.cumsum([0] + [len(t) + 1 for t in group])
            out[at : at + len(group)] = of_part(np.frombuffer(b" ".join(group), dtype=np.uint8), begins)
            at += len(group)
        return out

    return count


@dataclass(frozen=True)
class Voters:
    """Term weights, projection, and the labelled vectors with their labels and weights."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of damped counts times term weights; a text without words is all zero."""
    return _unit(np.log1p(counts) * idf)


def fit(counts: np.ndarray, labels: np.ndarray, weights: np.ndarray, prior: float, rank: int = RANK) -> Voters:
    """The latent space of labelled term counts, by subspace iteration from a fixed start."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(1)
    rows = weighted(counts, idf)
    basis = np.random.default_rng(5).standard_normal((TERMS, rank + 16)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, values, right = np.linalg.svd(rows @ basis, full_matrices=False)
    projection = (basis @ right.T)[:, :rank].astype(np.float32)
    return Voters(idf, projection, _unit(rows @ projection), labels, weights, prior)


def vote(counts: np.ndarray, voters: Voters, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Score in 0..1 per row of term counts; the share of label 1 where nothing is similar."""
    if not len(voters.labels):
        return np.full(len(counts), voters.prior)
    out = np.empty(len(counts))
    for a in range(0, len(counts), BLOCK):
        cosine = _unit(weighted(counts[a : a + BLOCK], voters.idf) @ voters.projection) @ voters.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k :]
        close = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(np.float64)
        power = close**SHARPNESS * voters.weights[near]
        total = power.sum(axis=1)
        score = (power * voters.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        out[a : a + BLOCK] = np.where(total > 0, score, voters.prior)
    return np.clip(out, 0, 1)


def _counted(texts: DataFrame, schema: str) -> DataFrame:
    """Sparse term counts of ``texts`` (label, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = term_counter()
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                rows = counter([(t or "").encode() for t in part.column(1).to_pylist()])
                at = [np.flatnonzero(r) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([x.astype("<u2").tobytes() for x in at], pa.binary()),
                        pa.array([r[x].astype("<f4").tobytes() for r, x in zip(rows, at)], pa.binary()),
                    ],
                    ["label", "terms", "counts"],
                )

    return texts.select("label", "text").mapInArrow(count, schema)


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality",
) -> Voters:
    """Voters from at most ``sample`` labelled rows outside the held-out fold.

    Rows are picked by a hash of the id, half of the sample per label; voters are weighted so that each label counts as
    often as among all labelled rows. Null ids and labels are left out; several labels of one id are averaged and rounded.
    """
    known = (
        labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("double").alias("label"))
        .where("of is not null and label is not null")
        .groupBy("of")
        .agg(F.round(F.avg("label")).alias("label"))
        .where(F.crc32(F.col("of").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    )
    shares = {r[0]: r[1] for r in known.groupBy("label").count().collect() if r[0] in (0.0, 1.0)}
    if not shares:
        return fit(np.zeros((0, TERMS), np.float32), np.zeros(0), np.zeros(0), 1.0, min(rank, 1))
    picked = None
    for label in sorted(shares):
        one = known.where(F.col("label") == label).orderBy(F.xxhash64("of"), "of").limit(sample // 2)
        picked = one if picked is None else picked.unionByName(one)
    # At most ``sample`` ids; ids that come often are cut again after the join.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(picked), F.col("doc_id") == F.col("of")
    )
    rows = _counted(texts, "label double, terms binary, counts binary")
    order = F.xxhash64("terms", "counts")
    held = rows.orderBy(order, "label", "terms", "counts").limit(sample).collect()
    counts = np.zeros((len(held), TERMS), dtype=np.float32)
    for i, r in enumerate(held):
        counts[i, np.frombuffer(r["terms"], dtype="<u2")] = np.frombuffer(r["counts"], dtype="<f4")
    given = np.array([r["label"] for r in held], dtype=np.float64)
    total = sum(shares.values())
    weight = {c: shares[c] / total / max((given == c).mean() if len(given) else 1, 1e-9) for c in shares}
    weights = np.array([weight[c] for c in given], dtype=np.float64)
    return fit(counts, given, weights, shares.get(1.0, 0) / total, rank)


def scored(docs: DataFrame, voters: Voters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, key, held_out, score, predicted.

    Null and empty texts get the share of label 1 among the labelled rows. A null id is not held out. Repeated rows get
    equal scores. Only the text decides the score.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vars(voters))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = term_counter()
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                counts = counter([(t or "").encode() for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(vote(counts, Voters(**sent.value)), pa.float64())],
                    ["doc_id", "key", "score"],
                )

    rows = docs.select(
        F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"),
        F.col(text_col).cast("string").alias("text"),
    ).mapInArrow(score, f"doc_id {kind}, key long, score double")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return rows.select(
        "doc_id", "key", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def predicted_rows(docs: DataFrame, voters: Voters, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns and in no order, that are not predicted as label 0. The rows are not moved."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(voters))
    at = docs.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = term_counter()
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                counts = counter([(t or "").encode() for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(vote(counts, Voters(**sent.value)) >= THRESHOLD))

    return docs.mapInArrow(choose, docs.schema)
