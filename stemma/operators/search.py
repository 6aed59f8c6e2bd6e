"""Vector search and prompt context.

``vector_search`` is exact. Vectors are assigned to the nearest of a bounded set
of pivots; a cell with all its members farther than the best known k-th distance
cannot hold a hit and is skipped; where hardly any cell is, all vectors form one. Cells are cut into blocks of bounded size, so a
cell that holds a third of all vectors (copies, for instance) is spread over many
tasks. Each task multiplies one block of queries with one block of vectors in single
precision, measures the few pairs that may be hits exactly, and
returns only its k best per query; the few survivors are ranked per query.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions.replies import prompt_messages
from stemma.functions.scores import distance_to_score
from stemma.functions.text import strip
from stemma.operators.store import last_per_key
from stemma.session import materialize

DIMENSIONS = 64
PIVOTS = 64
#: Most vectors, and most queries, that a task holds.
BLOCK_ROWS = 65536
QUERY_ROWS = 65536
#: Queries that tell whether cells are skipped, the share of vectors visited from which they are not used, and queries
#: below which a chunk is not cut further. These steer the work only; every query meets all vectors that may be hits.
PLAN_QUERIES, WHOLE_SHARE, LEAST_QUERIES = 1024, 0.5, 1024
#: Queries and vectors that are multiplied at once, and pairs that are held before they are measured.
TILE_QUERIES, TILE_VECTORS, HELD_PAIRS = 512, 1024, 2_000_000
DECIMALS = 6
CONTEXT_CHARS, SNIPPET_CHARS = 3500, 900


# ---- embedding ----------------------------------------------------------------


def hashed_words(text: Column, dim: int = DIMENSIONS) -> Column:
    """Hashed word counts of a text, scaled to length 1, as a list of ``dim`` numbers.

    Spark cuts the whole text into words; a batch of rows is counted at once, and each of its different words is hashed once.
    Nothing is shuffled.
    """

    def vectors(words: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(words.flatten())
        buckets = np.array(
            [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in coded.dictionary.to_pylist()], dtype=np.int64
        )
        cells = np.repeat(np.arange(len(words)), lengths) * dim + (buckets[coded.indices.to_numpy()] if len(coded) else 0)
        counts = np.bincount(cells, minlength=len(words) * dim).reshape(-1, dim)
        norms = np.sqrt((counts * counts).sum(1).astype(np.float64))
        values = counts / np.where(norms > 0, norms, 1.0)[:, None]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dim, pa.int32()), pa.array(values.ravel()))

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.arrow_udf(vectors, "array<double>")(words)


def embed_texts(docs: DataFrame, key: str = "id", text: str = "text", dim: int = DIMENSIONS) -> DataFrame:
    """(key, embedding): hashed word counts of the whole text, scaled to length 1, one row per row of ``docs``.

    A word goes to the dimension given by the first 8 hex digits of its md5. A text without words gives a zero vector.
    """
    return docs.select(key, hashed_words(F.col(text), dim).alias("embedding"))


def embed_with(
    docs: DataFrame,
    load_model: Callable[[], Callable[[list[str]], np.ndarray]],
    text: str = "text",
    batch: int = 64,
) -> DataFrame:
    """Adds ``embedding`` from a user's model, loaded once per task and fed in batches."""

    @F.pandas_udf("array<float>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for series in texts:
            parts = [
                np.asarray(model(series.iloc[i : i + batch].tolist()), dtype=np.float32)
                for i in range(0, len(series), batch)
            ]
            yield pd.Series([row for part in parts for row in part])

    return docs.withColumn("embedding", encode(F.coalesce(text, F.lit(""))))


def mean_pool(tokens: DataFrame, key: str = "id") -> DataFrame:
    """Masked average of the token vectors of each key: rows (key, mask, embedding).

    The divisor is at least 1e-9. Sums are combined per (key, position) before the
    shuffle, so the number of token rows per key does not matter.
    """
    cells = tokens.select(
        key, F.col("mask").cast("double").alias("mask"), F.posexplode("embedding").alias("position", "value")
    )
    mean = F.sum(F.col("value").cast("double") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1e-9))
    pooled = cells.groupBy(key, "position").agg(mean.alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "value")))
    return pooled.groupBy(key).agg(F.transform(ordered, lambda x: x["value"]).alias("embedding"))


# ---- exact nearest neighbours -------------------------------------------------


def _matrix(embeddings: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(e, dtype=np.float64) for e in embeddings])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def _assign_udf(pivots: np.ndarray):
    @F.pandas_udf("cell int, reach double")
    def assign(embedding: pd.Series) -> pd.DataFrame:
        d = _squared(_matrix(embedding), pivots)
        cell = d.argmin(1)
        return pd.DataFrame({"cell": cell, "reach": np.sqrt(d[np.arange(len(d)), cell])})

    return assign


def _visits(
    q: np.ndarray, pivots: np.ndarray, known: np.ndarray, radius: np.ndarray, size: np.ndarray, k: int
) -> np.ndarray:
    """Which cells each query has to visit: every cell that may hold one of its k best."""
    d = np.sqrt(_squared(q, pivots))
    far = d + radius[None, :]
    order = far.argsort(1)
    filled = size[order].cumsum(1) >= k
    at = np.where(filled.any(1), filled.argmax(1), len(size) - 1)
    best = far[np.arange(len(q)), order[np.arange(len(q)), at]]
    best = np.where(filled.any(1), best, np.inf)
    if len(known) >= k:
        to_known = np.sqrt(_squared(q, known))
        best = np.minimum(best, np.partition(to_known, k - 1, axis=1)[:, k - 1])
    return ((d - radius[None, :]) <= best[:, None] + 1e-3) & (size > 0)


def _cells_udf(pivots: np.ndarray, known: np.ndarray, radius: np.ndarray, size: np.ndarray, k: int):
    @F.pandas_udf("array<int>")
    def cells(embedding: pd.Series) -> pd.Series:
        near = _visits(_matrix(embedding), pivots, known, radius, size, k)
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in near])

    return cells


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1)


def _first_copies(v: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` rows of each group of equal rows, in order; more of a group can never be among k hits."""
    bits = (v + 0.0).view(np.uint64)  # -0.0 equals 0.0
    odd = np.random.default_rng(3).integers(1 << 63, size=v.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    order = np.argsort(((bits ^ (bits >> np.uint64(32))) * odd).sum(1), kind="stable")
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[order[1:]] != v[order[:-1]]).any(1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    return np.sort(order[np.arange(len(v)) - start < k])


def _nearest(q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of the k nearest rows of ``v`` for each row of ``q``, ties by place in ``v``.

    Single precision products tell which pairs may be hits: the order of ``q.v - v.v/2`` is that of the distances, and a
    pair is left out only if it is worse than the k-th best so far by more than the rounding of these numbers allows.
    The few pairs that remain are measured in double precision and decide.
    """
    dim, v_norm, q_norm = v.shape[1], (v * v).sum(1), np.sqrt((q * q).sum(1))
    longest = math.sqrt(v_norm.max())
    kind = np.float32 if max(longest, q_norm.max()) < 1e15 else np.float64
    unit = float(np.finfo(kind).eps) * (dim + 8)
    # Twice the error of a product, and half of the last decimal that counts.
    slack = 2 * unit * (q_norm * longest + longest * longest) + 10.0**-DECIMALS
    left = np.concatenate([q, np.ones((len(q), 1))], axis=1).astype(kind)
    right = np.concatenate([v, -0.5 * v_norm[:, None]], axis=1).astype(kind)
    out: list[tuple[np.ndarray, ...]] = []

    def settled(pairs: list[tuple[np.ndarray, ...]], limit: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the pairs held, the k best of each query by exact distance."""
        at, place, value = (np.concatenate(c) for c in zip(*pairs))
        near = value >= limit[at]
        at, place, value = at[near], place[near], value[near]
        exact = np.empty(len(at))
        for a in range(0, len(at), 100_000):
            apart = q[at[a : a + 100_000]] - v[place[a : a + 100_000]]
            exact[a : a + 100_000] = np.round((apart * apart).sum(1), DECIMALS)
        order = np.lexsort((place, exact, at))
        at, place, value, exact = at[order], place[order], value[order], exact[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate([first, [len(at)]])))
        keep = rank < k
        return at[keep], place[keep], value[keep], exact[keep]

    for start in range(0, len(q), TILE_QUERIES):
        stop = min(start + TILE_QUERIES, len(q))
        limit = np.full(len(q), -np.inf)
        best = np.full((stop - start, k), -np.inf, dtype=kind)  # the k best products of a query so far
        held, n_held = [], 0
        for low in range(0, len(v), TILE_VECTORS):
            tile = left[start:stop] @ right[low : low + TILE_VECTORS].T
            rows = np.flatnonzero(tile.max(1) >= limit[start:stop])
            if not len(rows):
                continue
            some = tile[rows] if len(rows) < len(tile) else tile
            if low == 0 or k > 16:
                both = np.concatenate([best[rows], some], axis=1)
                best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                limit[start:stop] = best.min(1) - slack[start:stop]
            at, place = np.nonzero(some >= limit[start:stop][rows, None])
            value = some[at, place]
            held.append((rows[at] + start, place + low, value))
            n_held += len(at)
            if low and k <= 16:  # few are new: each replaces the worst of its query, one of a query at a time
                turn = np.arange(len(at)) - np.searchsorted(at, at, side="left")
                for one in range(min(int(turn.max()) + 1, k)) if turn.max() < k else ():
                    now = rows[at[turn == one]]
                    worst = best[now].argmin(1)
                    best[now, worst] = np.maximum(best[now, worst], value[turn == one])
                if turn.max() >= k:
                    both = np.concatenate([best[rows], some], axis=1)
                    best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                limit[start:stop] = best.min(1) - slack[start:stop]
            if n_held > HELD_PAIRS:
                held = [settled(held, limit)[:3]]
                n_held = len(held[0][0])
        at, place, _, exact = settled(held, limit)
        out.append((at, place, exact))
    return tuple(np.concatenate(c) for c in zip(*out))


def _block_hits(k: int, queries: pa.Table, vectors: pa.Table, schema: pa.Schema) -> pa.Table:
    """k best vectors of one block for each query of one block, ties by id."""
    if not queries.num_rows or not vectors.num_rows:
        return schema.empty_table()
    vectors = vectors.take(pc.sort_indices(vectors["id"]))
    q, v = _rows(queries["embedding"]), _rows(vectors["embedding"])
    asked, there = (np.flatnonzero(np.isfinite((x * x).sum(1))) for x in (q, v))
    there = there[_first_copies(v[there], k)]
    if not len(asked) or not len(there):
        return schema.empty_table()
    at, place, distance = _nearest(q[asked], v[there], min(k, len(there)))
    columns = [queries["query_id"].take(pa.array(asked[at])), vectors["id"].take(pa.array(there[place])), pa.array(distance)]
    return pa.table(columns, names=schema.names)


def _filled(rows: DataFrame) -> DataFrame:
    """Rows with a vector of finite numbers."""
    return rows.where(
        F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )


def other_lengths(vectors: DataFrame, length: int) -> DataFrame:
    """(id, length) of the vectors that a search with queries of this length leaves out."""
    return vectors.select("id", F.size("embedding").alias("length")).where((F.col("length") >= 0) & (F.col("length") != length))


def vector_search(queries: DataFrame, vectors: DataFrame, top_k: int = 5) -> DataFrame:
    """The ``top_k`` nearest vectors of each query by squared L2 distance.

    Input (query_id, embedding) and (id, embedding); output (query_id, rank, id,
    distance, score). Distances count to six decimals, ties go by id. Only the
    pivots and one row of figures per cell reach the driver. Rows without a vector, with nulls or numbers that are not
    finite in it, or with another length than the longest query, take no part (``other_lengths`` lists these).
    """
    queries = _filled(queries.select("query_id", "embedding"))
    vectors = _filled(vectors.select("id", "embedding"))
    length = queries.agg(F.max(F.size("embedding"))).first()[0] or 0
    queries, vectors = (v.where(F.size("embedding") == length) for v in (queries, vectors))
    kinds = dict(queries.dtypes), dict(vectors.dtypes)
    schema = f"query_id {kinds[0]['query_id']}, id {kinds[1]['id']}, distance double"

    known = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("embedding").toPandas()
    if known.empty:
        return _ranked(vectors.sparkSession.createDataFrame([], schema), top_k)
    sample = _matrix(known["embedding"])
    pivots = np.unique(sample, axis=0)

    assigned = vectors.withColumn("_a", _assign_udf(pivots)("embedding")).select("id", "embedding", "_a.*")
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), dtype=np.int64)
    for row in assigned.groupBy("cell").agg(F.max("reach").alias("r"), F.count("id").alias("n")).collect():
        radius[row["cell"]], size[row["cell"]] = row["r"], row["n"]
    some = queries.orderBy(F.xxhash64("query_id")).limit(PLAN_QUERIES).select("embedding").toPandas()
    if some.empty:
        return _ranked(vectors.sparkSession.createDataFrame([], schema), top_k)
    visits = _visits(_matrix(some["embedding"]), pivots, sample, radius, size, top_k)
    if (visits @ size).mean() > WHOLE_SHARE * size.sum():  # cells that hardly anything skips only cut blocks into small ones
        size = size.sum(keepdims=True)
        assigned = vectors.withColumn("cell", F.lit(0))
        cells = F.array(F.lit(0))
    else:
        cells = _cells_udf(pivots, sample, radius, size, top_k)("embedding")
    cuts = np.maximum(1, -(-size // BLOCK_ROWS))
    blocks = F.array(*[F.lit(int(n)) for n in cuts])
    # Few blocks: queries are cut finer, so that every core has work.
    asked, cores = queries.count(), vectors.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, math.ceil(asked / QUERY_ROWS), min(math.ceil(3 * cores / int(cuts.sum())), asked // LEAST_QUERIES))

    def blocks_of(cell: Column) -> Column:
        return F.element_at(blocks, cell + 1)

    right = assigned.select(
        "id",
        "embedding",
        "cell",
        F.pmod(F.xxhash64("id"), blocks_of(F.col("cell"))).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
    )
    left = (
        queries.withColumn("cell", F.explode(cells))
        .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks_of(F.col("cell")) - 1)))
    )
    where = ["cell", "block", "chunk"]

    def hits(q: pa.Table, v: pa.Table) -> pa.Table:
        names = [q.schema.field("query_id"), v.schema.field("id"), pa.field("distance", pa.float64())]
        return _block_hits(top_k, q, v, pa.schema(names))

    return _ranked(left.groupBy(*where).cogroup(right.groupBy(*where)).applyInArrow(hits, schema), top_k)


def _ranked(found: DataFrame, top_k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy("distance", "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top_k)
        .select("query_id", "rank", "id", "distance", distance_to_score(F.col("distance")).alias("score"))
    )


# ---- questions over documents -------------------------------------------------


def one_per_id(docs: DataFrame, key: str) -> DataFrame:
    """One row per id: of several, the one with the highest values, text first."""
    rest = [c for c in docs.columns if c not in (key, "text")]
    return last_per_key(docs, [key], F.struct("text", *rest))


def search_documents(
    questions: DataFrame, docs: DataFrame, top_k: int = 5, search: Callable[..., DataFrame] = vector_search
) -> DataFrame:
    """Nearest documents of each question by hashed word counts.

    Input (query_id, text) and (id, text); output as ``vector_search``. Both sets
    of vectors are read several times, so they are written once first. Of several texts with one id
    the highest counts. ``search`` may be ``hashed_search.approximate_search``.
    """
    q = materialize(embed_texts(one_per_id(questions, "query_id"), "query_id"), "question-vectors")
    v = materialize(embed_texts(one_per_id(docs, "id"), "id"), "document-vectors")
    return search(q, v, top_k)


def search_hits(
    questions: DataFrame, docs: DataFrame, top_k: int = 5, search: Callable[..., DataFrame] = vector_search
) -> DataFrame:
    """Search hits in their public shape, with the number of hits of the question as ``total``."""
    docs = one_per_id(docs.select("id", "text", "asset_type"), "id")
    hits = search_documents(questions, docs, top_k, search)
    total = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    return (
        hits.withColumn("total", total)
        .join(docs.select("id", "text", "asset_type"), "id", "left")
        .select(
            "query_id",
            "rank",
            F.col("id").alias("data_asset"),
            F.col("text").alias("description"),
            F.col("score").alias("relevance_score"),
            "asset_type",
            "total",
        )
    )


def catalog_context(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """(query_id, context, tables_used) from ranked hits.

    Input (query_id, rank, id, snippet, asset_type), where ``snippet`` comes from
    ``snippet_of``. Blocks are taken in rank order up to the first that would
    exceed the budget; a table counts as used when its block was looked at, so
    the first block left out still counts.
    """
    kind = F.coalesce("asset_type", F.lit("asset"))
    block = F.concat(
        F.lit("--- Catalog asset "), F.col("rank").cast("string"), F.lit(": "), "id",
        F.lit(" ("), kind, F.lit(") ---\n"), "snippet",
    )
    so_far = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = (
        hits.withColumn("block", block)
        .withColumn("length", F.length("block"))
        .withColumn("total", F.sum("length").over(so_far))
        .withColumn("kept", F.col("total") <= budget)
        .withColumn("seen", F.col("total") - F.col("length") <= budget)
    )
    is_table = F.col("seen") & (kind == "table") & (F.coalesce("id", F.lit("")) != "")
    blocks = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("rank", F.col("block").alias("v")))))
    tables = F.array_sort(F.collect_list(F.when(is_table, F.struct("rank", F.col("id").alias("v")))))
    return marked.groupBy("query_id").agg(
        F.array_join(F.transform(blocks, lambda x: x["v"]), "\n\n").alias("context"),
        F.array_distinct(F.transform(tables, lambda x: x["v"])).alias("tables_used"),
    )


def snippet_of(text: Column) -> Column:
    trimmed = strip(F.coalesce(text, F.lit("")))
    return F.when(
        F.length(trimmed) > SNIPPET_CHARS,
        F.concat(F.substring(trimmed, 1, SNIPPET_CHARS), F.lit("...")),
    ).otherwise(trimmed)


def stored_hits(questions: DataFrame, vectors: DataFrame, top_k: int = 5) -> DataFrame:
    """Search hits of questions (query_id, text) in a stored vector collection."""
    q = materialize(embed_texts(one_per_id(questions, "query_id"), "query_id"), "question-vectors")
    hits = vector_search(q, vectors, top_k)
    return hits.join(vectors.select("id", "text", "metadata"), "id", "left").select(
        "query_id",
        "rank",
        F.col("id").alias("data_asset"),
        F.col("text").alias("description"),
        F.col("score").alias("relevance_score"),
        "metadata",
        F.try_element_at("metadata", F.lit("asset_type")).alias("asset_type"),
    )


def with_contexts(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Questions with the context of their hits; without hits the context is empty."""
    return questions.join(catalog_context(ranked), "query_id", "left").select(
        "query_id",
        "text",
        F.coalesce("context", F.lit("")).alias("context"),
        F.coalesce("tables_used", F.array().cast("array<string>")).alias("tables_used"),
    )


def context_of_hits(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Prompt context from the public shape of search hits."""
    ranked = hits.select(
        "query_id", "rank", F.col("data_asset").alias("id"),
        snippet_of(F.col("description")).alias("snippet"), "asset_type",
    )
    return with_contexts(questions, ranked)


def question_contexts(questions: DataFrame, docs: DataFrame, top_k: int = 5) -> DataFrame:
    """Prompt context of every question over documents (id, text, asset_type).

    Only the snippet of a document, not its text, travels to the hits.
    """
    hits = search_documents(questions, docs, top_k)
    snippets = docs.select("id", snippet_of(F.col("text")).alias("snippet"), "asset_type")
    return with_contexts(questions, hits.join(snippets, "id", "left"))


def question_prompts(contexts: DataFrame) -> DataFrame:
    """Chat messages per question, ready for a batch model outside."""
    return contexts.select(
        "query_id", prompt_messages(F.col("text"), F.col("context")).alias("messages"), "tables_used"
    )
