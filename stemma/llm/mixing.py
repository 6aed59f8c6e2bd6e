"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Every document of a source is taken a certain number of whole times;
the rest of the target is a sample without replacement. Documents are ranked by
``(u / (1 - u)) / (p / (1 - p))``: the odds of a random number that only id and text decide, over the odds
of the inclusion probability p, the source's rest over its size. Documents are taken in that order
until the rest is reached. The one that would go beyond it is left, and the gap is filled twice more with
the later documents that are small enough, so a source misses its target by less than the
smallest document it left.

No source is gathered in one task: words are summed per (source, slice of the random numbers), the slice
that crosses the rest is found from these sums, and only that slice (about ``SLICE_ROWS`` rows) is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import stored, whole_text, word_count

#: Weights of the sources in code point order, null last; repeated when there are more sources.
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of the input.
SHARE = 1.5
#: A source or document is taken at most so many times.
MOST = 2
#: Rows of a source in one slice of the random numbers.
SLICE_ROWS = 20_000
#: Passes over a source's later documents: the first, then those that fill its gap.
PASSES = 3
SEED = "mix"


def random_number(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) with 52 random bits, the same in every run."""
    told = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), whole_text(text))
    bits = F.conv(F.substring(F.sha2(told, 256), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, source, size in words and its random number u."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(whole_text(F.col(text_col))).alias("size"),
        random_number(F.col(id_col), F.col(text_col)).alias("u"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per source: its weight and target.

    ``sizes`` has one row per source (the mix's own configuration, sorted in one task).
    A source that would get more than ``MOST`` times its size is held there and what it leaves goes to the
    others by weight. Sorted by that limit over weight, the level per unit of weight rises while
    limits are below it and falls after, so the final level is its largest value.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    by_limit = Window.orderBy("limit_per_weight", F.asc_nulls_last("source"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    listed = F.array(*[F.lit(w) for w in weights])
    weighed = sizes.withColumn(
        "weight", F.element_at(listed, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ).withColumn("limit_words", F.col("source_size") * MOST)
    levels = weighed.withColumn("limit_per_weight", F.col("limit_words") / F.col("weight")).withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit_words").over(before), F.lit(0)))
        / F.sum("weight").over(after),
    )
    level = F.max("level").over(everything)
    return levels.withColumn("target", F.least(F.col("limit_words").cast("double"), level * F.col("weight"))).select(
        "source", "source_size", "n_rows", "weight", "target"
    )


def _rank(u: Column, p: Column) -> Column:
    return F.try_divide(u / (1 - u), p / (1 - p))


def sample_plan(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE
) -> DataFrame:
    """Per source: source_size, target, whole copies, p, and the cut and gap after each pass."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = (
        targets(sizes, weights, share)
        .withColumn("whole", whole.cast("long"))
        .withColumn("gap0", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("p", F.when(F.col("source_size") > 0, F.col("gap0") / F.col("source_size")).otherwise(0.0))
        .withColumn("slices", F.ceil(F.col("n_rows") / F.lit(SLICE_ROWS)).cast("long"))
        .withColumn("cut0", F.lit(-1.0).cast("double"))
    )
    plan = stored(plan, "mix-plan")
    for k in range(PASSES):
        # One row per source on the right; large sources split as a skewed left side.
        left = (
            rows.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
            .where((F.col("p") > 0) & (F.col("size") > 0))
            .withColumn("rank", _rank(F.col("u"), F.col("p")))
            .where((F.col("rank") > F.col(f"cut{k}")) & (F.col("size") <= F.col(f"gap{k}") if k else F.lit(True)))
            .select("source", "size", "rank", F.floor(F.col("u") * F.col("slices")).alias("slice"), f"gap{k}")
        )
        name = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
        sums = left.groupBy("source", f"gap{k}", "slice").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy(name).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        crossing = (
            sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
            .where((F.col("before") <= F.col(f"gap{k}")) & (F.col("before") + F.col("words") > F.col(f"gap{k}")))
            .select(F.col("source").alias("of"), F.col("slice").alias("at"), "before")
        )
        crossing = stored(crossing, "mix-crossing")
        inside = left.join(crossing, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
        # Equal ranks are the same id and text; the default frame takes them together.
        by_rank = Window.partitionBy(name).orderBy("rank")
        cuts = (
            inside.withColumn("upto", F.col("before") + F.sum("size").over(by_rank))
            .groupBy("source", f"gap{k}", "before")
            .agg(
                F.min(F.when(F.col("upto") > F.col(f"gap{k}"), F.col("rank"))).alias("cut"),
                F.max(F.when(F.col("upto") <= F.col(f"gap{k}"), F.col("upto"))).alias("words"),
            )
            .select(
                F.col("source").alias("of"), "cut",
                (F.col(f"gap{k}") - F.coalesce("words", "before")).alias("gap"),
            )
        )
        plan = stored(
            plan.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left")
            .withColumn(f"cut{k + 1}", F.coalesce("cut", F.lit(float("inf"))))
            .withColumn(f"gap{k + 1}", F.coalesce("gap", F.lit(0.0)))
            .drop("of", "cut", "gap"),
            "mix-plan",
        )
    return plan


def copies_taken() -> Column:
    """Copies of a row that is joined with its source's plan."""
    rank = _rank(F.col("u"), F.col("p"))
    taken = F.lit(False)
    for k in range(PASSES):
        small = F.col("size") <= F.col(f"gap{k}") if k else F.lit(True)
        taken = taken | ((rank > F.col(f"cut{k}")) & (rank < F.col(f"cut{k + 1}")) & small)
    return F.col("whole") + F.when((F.col("p") > 0) & taken, 1).otherwise(0)


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (of :func:`units`, other columns kept) with source_size, target and copies."""
    named = plan.withColumnRenamed("source", "of").drop("n_rows", "weight")
    extra = [c for c in named.columns if c not in ("source_size", "target")]
    return (
        rows.join(named, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", copies_taken().cast("long"))
        .drop(*extra)
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    Null and empty texts have no words, are part of their source and add nothing. A null source is a
    source of its own. Rows with the same id and text share their random number and are sampled together.
    An empty table gives no rows. Other columns are not read.
    """
    rows = stored(units(docs, id_col, text_col, source_col), "mix-units")
    return with_copies(rows, sample_plan(rows)).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    plan = sample_plan(stored(units(docs, id_col, text_col, source_col), "mix-units"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = whole.select(
        "row",
        F.col(f"row.{source_col}").cast("string").alias("source"),
        word_count(whole_text(F.col(f"row.{text_col}"))).alias("size"),
        random_number(F.col(f"row.{id_col}"), F.col(f"row.{text_col}")).alias("u"),
    )
    taken = with_copies(rows, plan).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def comparison_sql() -> str:
    """DuckDB SQL for :func:`mix` over ``documents``, pass by pass."""
    rank = "(u / (1 - u)) / (p / (1 - p))"
    text = f"""
    with r as (
        select doc_id, source,
               cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
               (cast(('0x' || substr(sha256('{SEED}|' || coalesce(cast(doc_id as varchar), '') || '|'
                   || coalesce(text, '')), 1, 13)) as bigint) + 0.5::double) / {2**52}::double as u
        from documents
    ), s as (
        select source, sum(size) as source_size,
               case (row_number() over (order by source asc nulls last) - 1) % 3
                   when 0 then 3 when 1 then 1 else 2 end as weight
        from r group by source
    ), l as (
        select *, (({SHARE}::double * sum(source_size) over ()
                    - coalesce(sum({MOST} * source_size) over (order by {MOST} * source_size / weight::double, source asc nulls last
                          rows between unbounded preceding and 1 preceding), 0))::double
                   / sum(weight) over (order by {MOST} * source_size / weight::double, source asc nulls last
                          rows between current row and unbounded following)::double) as level
        from s
    ), t as (
        select source, source_size, least(({MOST} * source_size)::double, max(level) over () * weight::double) as target
        from l
    ), pl as (
        select *, case when source_size > 0 then floor(target / source_size::double) else 0 end as whole from t
    ), c0 as (
        select r.doc_id, r.size, r.u, pl.source, pl.source_size::bigint as source_size, pl.target,
               pl.whole::bigint as whole, pl.target - pl.whole * pl.source_size::double as gap0,
               case when pl.source_size > 0 then (pl.target - pl.whole * pl.source_size::double) / pl.source_size::double
                    else 0 end as p,
               -1::double as cut0
        from r join pl on r.source is not distinct from pl.source
    )"""
    for k in range(PASSES):
        small = f"and size <= gap{k}" if k else ""
        text += f""", x{k} as (
        select *, p > 0 and size > 0 and {rank} > cut{k} {small} as open{k} from c{k}
    ), y{k} as (
        select *, case when open{k} then sum(size) over (partition by source, open{k} order by {rank}) end as upto{k}
        from x{k}
    ), c{k + 1} as (
        select *, coalesce(min(case when upto{k} > gap{k} then {rank} end) over (partition by source), 'inf'::double) as cut{k + 1},
               case when max(upto{k}) over (partition by source) > gap{k}
                    then gap{k} - coalesce(max(case when upto{k} <= gap{k} then upto{k} end) over (partition by source), 0)
                    else 0 end as gap{k + 1}
        from y{k}
    )"""
    taken = " or ".join(
        f"({rank} > cut{k} and {rank} < cut{k + 1}" + (f" and size <= gap{k})" if k else ")") for k in range(PASSES)
    )
    return text + f"""
    select doc_id, size, source_size, target,
           ((whole + case when p > 0 and ({taken}) then 1 else 0 end) * size)::bigint as taken
    from c{PASSES}"""
