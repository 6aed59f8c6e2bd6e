"""Audit of how far the sources of a language differ in their words.

Copies of a text count as often as they come, but are read once: rows are counted per (lang, digest of the text, source),
one row of each text crosses the shuffle with these counts beside it, is cut into terms once, and adds its document
and its occurrences times the counts of each source. Only terms of enough documents stay.

Shares of pairs of sources are compared sparsely. Where neither source has a term, both give it the share of
no occurrence, so those terms add one known difference times their number. The others are compared in blocks: a slice of
the terms with one or two tiles of sources, as a matrix of shares. A block gives one partial sum per pair, however many terms
it holds, and tiles bound its memory however many sources there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import stored, whole_text

#: Between terms: ASCII characters other than letters.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term occurs in, at least.
LEAST_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP = 50
#: Bytes of text that are cut into terms at once.
PART = 8 << 20
#: Sources whose weights are listed beside one text; more sources take several slices.
LISTED = 4096
#: Sources of a tile and shares of a block, about.
TILE = 256
BLOCK_ROWS = 200_000
#: Terms that are compared at once.
COLUMNS = 4096


def _weighed_texts(rows: DataFrame, n_groups: int) -> DataFrame:
    """Each distinct (lang, text) with its rows per source, listed in slices of at most about ``LISTED`` sources."""
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    of_source = F.pmod(F.xxhash64("source"), F.lit(1 + n_groups // LISTED))
    weights = (
        keyed.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("docs"))
        .groupBy("lang", "digest", of_source.alias("slice"))
        .agg(F.collect_list(F.struct("source", "docs")).alias("weights"))
    )
    once = keyed.select("lang", "digest", "text").dropDuplicates(["lang", "digest"])
    return once.join(weights, ["lang", "digest"]).select("lang", "text", "weights")


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, docs, n) summed over some texts at a time."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
        bounds = np.flatnonzero(np.diff(np.concatenate([[-1], np.cumsum(sizes) // PART]))).tolist() + [batch.num_rows]
        for low, high in zip([0, *bounds], bounds):
            if high > low:
                yield from _count_terms(batch.slice(low, high - low))


def _count_terms(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    cut = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), NO_TERM)
    terms, row = pc.list_flatten(cut), np.asarray(pc.list_parent_indices(cut))
    real = pc.not_equal(terms, "")
    coded = terms.filter(real).dictionary_encode()
    row = row[np.asarray(real.cast(pa.int8())).astype(bool)]
    n_terms = max(1, len(coded.dictionary))
    pair, times = np.unique(row.astype(np.int64) * n_terms + np.asarray(coded.indices), return_counts=True)
    row, code = pair // n_terms, pair % n_terms
    # Each (text, term) meets the text's sources.
    weights = batch.column("weights")
    listed, owner = pc.list_flatten(weights), np.asarray(pc.list_parent_indices(weights))
    langs, sources = batch.column("lang").dictionary_encode(), listed.field(0).dictionary_encode()
    n_sources = max(1, len(sources.dictionary))
    group = np.asarray(langs.indices, dtype=np.int64)[owner] * n_sources + np.asarray(sources.indices)
    docs = np.asarray(listed.field(1))
    count = np.bincount(owner, minlength=batch.num_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    times_each = count[row]
    at = np.repeat(np.arange(len(row)), times_each)
    source_at = first[row[at]] + np.arange(len(at)) - np.repeat(np.cumsum(times_each) - times_each, times_each)
    key, back = np.unique(group[source_at] * n_terms + code[at], return_inverse=True)
    in_docs = np.zeros(len(key), dtype=np.int64)
    occurs = np.zeros(len(key), dtype=np.int64)
    np.add.at(in_docs, back, docs[source_at])
    np.add.at(occurs, back, docs[source_at] * times[at])
    group, code = key // n_terms, key % n_terms
    yield pa.RecordBatch.from_arrays(
        [
            langs.dictionary.take(pa.array(group // n_sources)), sources.dictionary.take(pa.array(group % n_sources)),
            coded.dictionary.take(pa.array(code)), pa.array(in_docs), pa.array(occurs),
        ],
        ["lang", "source", "term", "docs", "n"],
    )


def term_counts(rows: DataFrame, n_groups: int, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, head) of the kept terms; ``head`` is 1 in one row of each (lang, term)."""
    counted = (
        _weighed_texts(rows, n_groups)
        .mapInArrow(_term_rows, "lang string, source string, term string, docs long, n long")
        .groupBy("lang", "term", "source")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    )
    of_term = Window.partitionBy("lang", "term")
    return (
        counted.withColumn("in_docs", F.sum("docs").over(of_term))
        .withColumn("lang_n", F.sum("n").over(of_term))
        .withColumn("head", (F.row_number().over(of_term.orderBy("source")) == 1).cast("long"))
        .where(F.col("in_docs") >= least_docs)
        .select("lang", "source", "term", "n", "lang_n", "head")
    )


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exact."""
    wide = "decimal(20,0)"
    return F.lit(1) + F.call_function(
        "div", F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast(wide), (total + terms * SMOOTH).cast(wide)
    ).cast("long")


def _pair_sums(table: pa.Table) -> pa.Table:
    """Sums of differences of all pairs of a block's sources, the first of the lower tile.

    Rows without a term name the sources and their share of no occurrence.
    """
    lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
    is_group = np.asarray(pc.is_null(table.column("term")).combine_chunks().cast(pa.int8())).astype(bool)
    named = table.filter(pa.array(is_group)).sort_by("source")
    names = named.column("source").combine_chunks()
    base = np.asarray(named.column("p").combine_chunks())
    tile = np.asarray(named.column("tile").combine_chunks())
    n_terms = named.column("n_terms")[0].as_py()
    entries = table.filter(pa.array(~is_group))
    source = np.asarray(pc.index_in(entries.column("source").combine_chunks(), value_set=names))
    coded = entries.column("term").combine_chunks().dictionary_encode()
    code, p = np.asarray(coded.indices), np.asarray(entries.column("p").combine_chunks())
    order = np.argsort(code, kind="stable")
    source, code, p = source[order], code[order], p[order]
    lows, highs = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
    sums = np.zeros((len(lows), len(highs)), dtype=np.int64)
    present = len(coded.dictionary)
    for start in range(0, present, COLUMNS):
        a, b = np.searchsorted(code, [start, start + COLUMNS])
        width = min(COLUMNS, present - start)
        shares = np.repeat(base[:, None], width, axis=1)
        shares[source[a:b], code[a:b] - start] = p[a:b]
        for k, s in enumerate(lows):
            sums[k] += np.abs(shares[highs] - shares[s]).sum(axis=1)
    left, right = np.meshgrid(np.arange(len(lows)), np.arange(len(highs)), indexing="ij")
    wanted = lows[left] < highs[right] if low == high else np.ones_like(left, dtype=bool)
    left, right = left[wanted], right[wanted]
    n = len(left)
    return pa.table(
        {
            "lang": pa.array([lang] * n, pa.string()),
            "a": names.take(pa.array(lows[left])), "b": names.take(pa.array(highs[right])),
            "value": pa.array(sums[left, right], pa.int64()), "present": pa.array([present] * n, pa.int64()),
            "gap": pa.array(np.abs(base[lows[left]] - base[highs[right]]), pa.int64()),
            "n_terms": pa.array([n_terms] * n, pa.int64()),
        }
    )


def pair_values(entries: DataFrame, groups: DataFrame, n_groups: int, n_entries: int) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language.

    ``entries``: lang, source, term, p. ``groups``: lang, source, p (of no occurrence), n_terms.
    """
    tiles, slices = 1 + n_groups // TILE, 1 + n_entries // BLOCK_ROWS
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    of_term = F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("slice")
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    columns = ["lang", "source", "term", "p", "n_terms", "tile", "slice"]
    held = entries.select(
        "lang", "source", "term", "p", F.lit(None).cast("long").alias("n_terms"), tile.alias("tile"), of_term
    ).unionByName(
        groups.select("lang", "source", F.lit(None).cast("string").alias("term"), "p", "n_terms", tile.alias("tile"), every)
    )
    blocks = held.select(*columns, other).select(
        *columns, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")
    )
    sums = (
        blocks.groupBy("lang", "low", "high", "slice")
        .applyInArrow(_pair_sums, "lang string, a string, b string, value long, present long, gap long, n_terms long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"), F.sum("present").alias("present"), F.max("gap").alias("gap"),
             F.max("n_terms").alias("n_terms"))
        .withColumn("value", F.col("value") + (F.col("n_terms") - F.col("present")) * F.col("gap"))
    )
    both = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    return sums.select("lang", "value", F.explode(both).alias("way")).select("lang", "way.source", "way.item", "value")


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = LEAST_DOCS, top: int = TOP,
) -> DataFrame:
    """Per lang, source, part and item: value and rank.

    Part ``pair``: how far each other source of the language is (sum of differences of shares over all kept terms).
    Part ``term``: the ``top`` terms whose share lies above the language's.

    Null text, lang and source count as empty and are a language or source like any other. Texts without terms
    count their source only. Repeated rows count each time. A language with one source has no pairs; without kept terms all its pairs
    are 0. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(
        whole_text(F.col(lang_col)).alias("lang"), whole_text(F.col(source_col)).alias("source"),
        whole_text(F.col(text_col)).alias("text"),
    )
    present = stored(rows.select("lang", "source").distinct(), "audit-groups")
    n_groups = present.count()
    counts = stored(term_counts(rows, n_groups, least_docs), "audit-terms")
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("head").alias("n_terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = stored(
        present.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "lang_total", "n_terms")]
        ),
        "audit-totals",
    )
    shared = counts.drop("head").join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms")).alias("q"),
    )
    unseen = F.when(F.col("n_terms") > 0, share(none, F.col("total"), F.col("n_terms"))).otherwise(none)
    pairs = pair_values(
        shared.drop("q"), groups.select("lang", "source", unseen.alias("p"), "n_terms"), n_groups, counts.count()
    )
    terms = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by_value)).select(columns)
        .unionByName(
            terms.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(by_value))
            .where(F.col("rank") <= top).select(columns)
        )
    )


def comparison_sql() -> str:
    """DuckDB SQL for :func:`audit` over ``documents``, every term of every pair."""
    return rf"""
    with d as (
        select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
        from documents
    ), tokens as (
        select id, lang, source, unnest(terms) as term from d
    ), kept as (
        select lang, term, count(*) as lang_n from tokens group by lang, term having count(distinct id) >= {LEAST_DOCS}
    ), langs as (
        select lang, sum(lang_n) as lang_total, count(*) as v from kept group by lang
    ), groups as (
        select distinct lang, source from d
    ), counts as (
        select lang, source, term, count(*) as n from tokens semi join kept using (lang, term) group by all
    ), totals as (
        select lang, source, sum(n) as total from counts group by all
    ), cells as (
        select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
               1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + {SMOOTH})) // (coalesce(t.total, 0) + {SMOOTH} * l.v) as p,
               1 + ({SCALE}::hugeint * (k.lang_n + {SMOOTH})) // (l.lang_total + {SMOOTH} * l.v) as q
        from groups g join kept k on g.lang = k.lang join langs l on l.lang = g.lang
             left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
             left join totals t on t.lang = g.lang and t.source = g.source
    ), pairs as (
        select a.lang, a.source, b.source as item, 'pair' as part, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
        from groups a join groups b on a.lang = b.lang and a.source <> b.source
             left join cells x on x.lang = a.lang and x.source = a.source
             left join cells y on y.lang = b.lang and y.source = b.source and y.term = x.term
        group by all
    ), terms as (
        select lang, source, term as item, 'term' as part, (p - q)::bigint as value from cells where n > 0 and p > q
    ), ranks as (
        select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
        from (select * from pairs union all select * from terms)
    )
    select lang, source, part, item, value, rank from ranks where part = 'pair' or rank <= {TOP}
    """
