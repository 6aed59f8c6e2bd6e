"""Embedding, vector search, question answering context and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions import replies as P
from stemma.functions.scores import distance_to_score
from stemma.operators import search as V
from stemma.operators.hashed_search import approximate_search
from stemma.operators.catalog import hit_blocks
from stemma.plans.registry import Inputs, query
from stemma.plans.star import RELATIONS

RELATIONS["questions"] = "select conv_id*1000+turn as query_id, text from {conversations} where role = 'user'"
RELATIONS["catalog_docs"] = """
select 'doc-'||doc_id as id, text, case when lang = 'en' then 'table' when lang = 'de' then 'sql' end as asset_type from {documents}
"""
RELATIONS["example_queries"] = "select item_id as query_id, text from {benchmark}"


def _embedded(texts: str, key: str) -> str:
    """Comparison-only: dense hashed word counts of length 1 as a list of 64 doubles."""
    return f"""
with words as (
 select {key}, ('0x'||substring(md5(w), 1, 8))::bigint % 64 as bucket
 from (select {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+')) as w from {{{texts}}}) where w <> ''),
counts as (select {key}, bucket, count(*) as n from words group by all),
norms as (select {key}, sqrt(sum(n * n)) as norm from counts group by all),
dense as (
 select t.{key}, d.i, coalesce(c.n / m.norm, 0.0::double) as value
 from {{{texts}}} t cross join (select unnest(range(64)) as i) d
 left join counts c on c.{key} = t.{key} and c.bucket = d.i left join norms m on m.{key} = t.{key})
select {key}, list(value order by i) as embedding from dense group by {key}
"""


RELATIONS["x_doc_vectors"] = _embedded("catalog_docs", "id")
RELATIONS["x_question_vectors"] = _embedded("questions", "query_id")
RELATIONS["x_example_vectors"] = _embedded("example_queries", "query_id")


def _nearest(queries: str, vectors: str, k: int, same: str = "") -> str:
    return f"""
with pairs as (
 select q.query_id, v.id, round(pow(list_distance(q.embedding, v.embedding), 2), 6) as distance
 from {{{queries}}} q cross join {{{vectors}}} v {same}),
ranked as (select *, row_number() over (partition by query_id order by distance, id) as rank from pairs)
select query_id, cast(rank as integer) as rank, id, distance,
 case when distance between 0 and 1 then 1 - distance else 1 / (1 + distance) end as score
from ranked where rank <= {k}
"""


RELATIONS["x_vectors"] = "select vec_id as id, vec_id as query_id, embedding::double[] as embedding from {embeddings}"
RELATIONS["x_vector_hits"] = _nearest("x_vectors", "x_vectors", 5)
RELATIONS["x_question_hits"] = _nearest("x_question_vectors", "x_doc_vectors", 5)
RELATIONS["x_example_hits"] = _nearest("x_example_vectors", "x_doc_vectors", 3)


@query(
    "embed_texts",
    """
select id, cast(i as integer) as position, round(value, 9) as value
from (select id, unnest(range(64)) as i, unnest(embedding) as value from {x_doc_vectors}) where value > 0
""",
)
def embed_texts(t: Inputs) -> DataFrame:
    return (
        V.embed_texts(t.spread("catalog_docs", "id"))
        .select("id", F.posexplode("embedding").alias("position", "value"))
        .where(F.col("value") > 0)
        .withColumn("value", F.round("value", 9))
    )


@query(
    "mean_pool",
    """
with cells as (
 select label, case when embedding[1] > 0 then 1 else 0 end as mask, unnest(range(64)) as i, unnest(embedding)::double as value from {embeddings})
select label, cast(i as integer) as position, round(sum(value * mask) / greatest(sum(mask), 1e-9), 6) as value from cells group by label, i
""",
)
def mean_pool(t: Inputs) -> DataFrame:
    mask = F.when(F.get("embedding", F.lit(0)) > 0, 1).otherwise(0)
    pooled = V.mean_pool(t("embeddings").select("label", mask.alias("mask"), "embedding"), "label")
    return pooled.select("label", F.posexplode("embedding").alias("position", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query("vector_search", "select * from {x_vector_hits}")
def vector_search(t: Inputs) -> DataFrame:
    vectors = t("embeddings")
    return V.vector_search(
        vectors.select(F.col("vec_id").alias("query_id"), "embedding"),
        vectors.select(F.col("vec_id").alias("id"), "embedding"),
        5,
    )


@query("vector_search_hashed")
def vector_search_hashed(t: Inputs) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query against all vectors; a search that may miss hits has no SQL."""
    vectors = t("embeddings")
    return approximate_search(
        vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"),
        vectors.select(F.col("vec_id").alias("id"), "embedding"),
        5,
    )


@query(
    "distance_to_score",
    """
select o_orderkey, o_totalprice / 250000 as distance,
 case when o_totalprice / 250000 between 0 and 1 then 1 - o_totalprice / 250000 else 1 / (1 + o_totalprice / 250000) end as score
from {orders}
""",
)
def distance_scores(t: Inputs) -> DataFrame:
    distance = F.col("o_totalprice") / F.lit(250000)
    return t("orders").select(
        "o_orderkey", distance.alias("distance"), distance_to_score(distance).alias("score")
    )


def _hits(relation: str) -> str:
    return f"""
select h.query_id, h.rank, h.id as data_asset, d.text as description, h.score as relevance_score, d.asset_type,
 count(*) over (partition by h.query_id) as total
from {{{relation}}} h left join {{catalog_docs}} d on d.id = h.id
"""


@query("search_data_assets", _hits("x_question_hits"))
def search_data_assets(t: Inputs) -> DataFrame:
    return V.search_hits(t.spread("questions", "query_id"), t.spread("catalog_docs", "id"), 5)


@query(
    "search_hit_blocks",
    f"""
select query_id, rank, '### '||rank||'. '||data_asset||' ('||coalesce(asset_type, 'asset')||', score='||printf('%.3f', relevance_score)||')'||chr(10)||substring(description, 1, 1500) as block
from ({_hits('x_question_hits')})
""",
)
def search_hit_blocks(t: Inputs) -> DataFrame:
    return hit_blocks(search_data_assets(t))


@query("search_similar_queries", _hits("x_example_hits"))
def search_similar_queries(t: Inputs) -> DataFrame:
    return V.search_hits(t.spread("example_queries", "query_id"), t.spread("catalog_docs", "id"), 3)


# Comparison-only: prompt context of every question.
RELATIONS["x_contexts"] = """
with blocks as (
 select h.query_id, h.rank, h.id, coalesce(d.asset_type, 'asset') as kind,
  '--- Catalog asset '||h.rank||': '||h.id||' ('||coalesce(d.asset_type, 'asset')||') ---'||chr(10)
  ||case when length(trim(d.text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')) > 900
     then substring(trim(d.text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '), 1, 900)||'...' else trim(d.text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ') end as block
 from {x_question_hits} h join {catalog_docs} d on d.id = h.id),
sums as (select *, sum(length(block)) over (partition by query_id order by rank) as total from blocks)
select q.query_id, q.text, coalesce(string_agg(s.block, chr(10)||chr(10) order by s.rank) filter (where s.total <= 3500), '') as context,
 coalesce(string_agg(s.id, ', ' order by s.rank) filter (where s.kind = 'table' and s.total - length(s.block) <= 3500), '') as tables_used
from {questions} q left join sums s on s.query_id = q.query_id group by q.query_id, q.text
"""


def _contexts(t: Inputs) -> DataFrame:
    return V.question_contexts(t.spread("questions", "query_id"), t.spread("catalog_docs", "id"), 5)


@query("catalog_context", "select query_id, context, tables_used from {x_contexts}")
def catalog_context(t: Inputs) -> DataFrame:
    return _contexts(t).select("query_id", "context", F.array_join("tables_used", ", ").alias("tables_used"))


@query(
    "prompt_messages",
    f"""
select query_id, '{P.SYSTEM_PROMPT.replace("'", "''")}' as system_message,
 case when context <> '' then 'Data catalog context (relevant tables, columns, and assets):'||chr(10)||chr(10)||context||chr(10)||chr(10)||'User request: '||text else text end as user_message,
 tables_used
from {{x_contexts}}
""",
)
def prompt_messages(t: Inputs) -> DataFrame:
    messages = V.question_prompts(_contexts(t))
    return messages.select(
        "query_id",
        F.col("messages")[0]["content"].alias("system_message"),
        F.col("messages")[1]["content"].alias("user_message"),
        F.array_join("tables_used", ", ").alias("tables_used"),
    )
