"""SQL-text, identifier and reply rules over derived texts.

For the structural rules the comparison states the expected result of every text
shape by hand; for the checks it evaluates the same rule in the other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions import replies as P
from stemma.functions import sql_rules as R
from stemma.functions import text as X
from stemma.operators import sql_texts as Q
from stemma.plans.registry import Inputs, query
from stemma.plans.star import RELATIONS


def _cases(column: str, expected: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"when '{shape}' then {value}" for shape, value in expected.items())
    return f"case {column} {whens} else {otherwise} end"


# Expected tables per text shape, by hand.
TABLES = _cases(
    "shape",
    {
        "1F": "'public.customer, public.orders'",
        "2F": "'public.t'||o_orderkey",
        "3F": "'public.lineitem, public.part'",
        "4F": "'sales.fact, stage.s'||o_custkey",
        "5F": "'public.dim'",
        "1O": "'a.base, public.region'",
        "4O": "'public.orders, sales.items'",
        "5O": "'public.dims, public.facts'",
        "2P": "'stage.s'||o_custkey",
        "3P": "'mart.m'||o_custkey||', public.src_a, public.src_b, public.src_c'",
        "4P": "'public.base_'||o_custkey||', public.names'",
    },
    "''",
)
TYPES = _cases(
    "shape",
    {
        "1F": "'SELECT'", "2F": "'DROP'", "3F": "'SELECT'", "4F": "'INSERT'", "5F": "'UPDATE'",
        "1O": "'SELECT'", "4O": "'SELECT'", "5O": "'SELECT'", "2P": "'DELETE'", "3P": "'CREATE'",
        "4P": "'SELECT'",
    },
    "'UNKNOWN'",
)
JOINS = _cases(
    "shape",
    {
        "1F": "'JOIN public.customer'", "1O": "'JOIN public.region'",
        "4O": "'LEFT OUTER JOIN sales.items'", "3P": "'CROSS JOIN public.src_c'",
        "4P": "'NATURAL JOIN public.names'",
    },
    "''",
)
COLUMNS = _cases("shape", {"3F": "'p_name, qty'", "1O": "'k'", "4O": "'id'", "4P": "'n'"}, "''")

RELATIONS["x_parsed"] = f"""
select o_orderkey as sql_id, {TABLES} as tables, {TYPES} as statement_type, {JOINS} as joins, {COLUMNS} as columns, shape
from (select *, substring(o_orderpriority, 1, 1)||o_orderstatus as shape from {{orders}})
"""
DESCRIBED = (
    "case when shape = '2O' then 'QUERY' else statement_type end||"
    "case when tables = '' then ' (no tables detected)' else ' using tables: '||tables end"
)


def _parsed(t: Inputs) -> DataFrame:
    return Q.parse_sql_texts(t.spread("sql_texts", "sql_id"))


def _join_text():
    return F.array_join(F.transform("joins", lambda j: F.concat(j["join_type"], F.lit(" "), j["table"])), "; ")


@query("extract_sql_tables", "select sql_id, tables from {x_parsed}")
def extract_sql_tables(t: Inputs) -> DataFrame:
    return _parsed(t).select("sql_id", F.array_join("tables", ", ").alias("tables"))


@query("extract_sql_joins", "select sql_id, joins from {x_parsed}")
def extract_sql_joins(t: Inputs) -> DataFrame:
    return _parsed(t).select("sql_id", _join_text().alias("joins"))


@query("extract_select_columns", "select sql_id, columns from {x_parsed}")
def extract_select_columns(t: Inputs) -> DataFrame:
    return _parsed(t).select("sql_id", F.array_join("columns", ", ").alias("columns"))


@query("statement_type", "select sql_id, statement_type from {x_parsed}")
def statement_type(t: Inputs) -> DataFrame:
    return _parsed(t).select("sql_id", "statement_type")


@query("describe_sql", f"select sql_id, {DESCRIBED} as description from {{x_parsed}}")
def describe_sql(t: Inputs) -> DataFrame:
    return _parsed(t).select("sql_id", F.col("transformation_description").alias("description"))


@query(
    "parse_sql",
    f"select sql_id, tables, columns, joins, statement_type, 0 as unfilled, {DESCRIBED} as transformation_description from {{x_parsed}}",
)
def parse_sql(t: Inputs) -> DataFrame:
    return _parsed(t).select(
        "sql_id",
        F.array_join("tables", ", ").alias("tables"),
        F.array_join("columns", ", ").alias("columns"),
        _join_text().alias("joins"),
        "statement_type",
        (F.size("filters") + F.size("aggregations") + F.size("subqueries")).alias("unfilled"),
        "transformation_description",
    )


# ---- checks -------------------------------------------------------------------

_WORDS = " ".join(
    f"when regexp_matches(lower(sql), '\\b{w}\\b') then 'Contains dangerous keyword: {w}'" for w in R.BLOCKED_WORDS
)
_STATEMENT = "regexp_matches(lower(sql), '\\b(select|with|insert|update)\\b')"
REASON = (
    f"case when trim(sql) = '' then 'Empty SQL' {_WORDS} when not {_STATEMENT} "
    "then 'SQL does not appear to be a SELECT/INSERT/UPDATE/WITH statement' else '' end"
)


@query("validate_sql", f"select sql_id, {REASON} = '' as valid, {REASON} as reason from {{sql_texts}}")
def validate_sql(t: Inputs) -> DataFrame:
    return Q.validate_sql_texts(t.spread("sql_texts", "sql_id")).select("sql_id", "valid", "reason")


REFS = (
    "list_transform(list_concat(regexp_extract_all(sql, '(?i)\\bfrom\\s+([\\w.\"]+)', 1), "
    "regexp_extract_all(sql, '(?i)\\bjoin\\s+([\\w.\"]+)', 1)), lambda x: trim(x, '\"'))"
)


@query("referenced_tables_naive", f"select sql_id, array_to_string({REFS}, ', ') as refs from {{sql_texts}}")
def referenced_tables_naive(t: Inputs) -> DataFrame:
    refs = R.referenced_tables(F.col("sql"))
    return t.spread("sql_texts", "sql_id").select("sql_id", F.array_join(refs, ", ").alias("refs"))


# An allowlist in the forms users write: qualified, quoted, mixed case.
ALLOWED = ('public."Orders"', "PART", "lineitem", "other.T", "Items", "d", "base")
OUTSIDE = (
    f"list_filter(list_transform({REFS}, lambda x: trim(split_part(x, '.', -1), '\"')), "
    "lambda x: x <> '' and not list_contains(['orders', 'part', 'lineitem', 't', 'items', 'd', 'base'], lower(x)))[1]"
)


@query(
    "check_allowed_tables",
    f"""
select sql_id, {OUTSIDE} as outside,
 case when {REASON} <> '' then {REASON} when {OUTSIDE} is not null then 'References disallowed table: '||{OUTSIDE} else '' end as reason
from {{sql_texts}}
""",
)
def check_allowed_tables(t: Inputs) -> DataFrame:
    allowed = F.array(*[F.lit(a) for a in ALLOWED])
    texts = t.spread("sql_texts", "sql_id").withColumn("allowed", allowed)
    outside = R.first_disallowed_table(F.col("sql"), F.col("allowed"))
    return Q.validate_sql_texts(texts, "sql", "allowed").select("sql_id", outside.alias("outside"), "reason")


_TOKENS = " ".join(
    f"when contains(lower(sql), '{w} ') then 'Contains dangerous token: {w}'" for w in R.BLOCKED_WORDS
)


@query(
    "basic_sql_safety",
    f"""
select sql_id, case {_TOKENS} when not {_STATEMENT}
 then 'Generated SQL does not appear to be a SELECT/WITH/INSERT/UPDATE statement' else '' end as reason
from {{sql_texts}}
""",
)
def basic_sql_safety(t: Inputs) -> DataFrame:
    texts = t.spread("sql_texts", "sql_id").withColumn("lowered", F.lower("sql"))
    reason = F.coalesce(R.basic_safety_reason(F.col("lowered")), F.lit(""))
    return texts.select("sql_id", reason.alias("reason"))


_STRICT = " ".join(
    f"when contains(upper(sql), '{w}') then 'Query contains dangerous keyword: {w}'" for w in R.STRICT_WORDS
)


@query(
    "strict_select_check",
    f"""
select sql_id, case when sql = '' then 'SQL query is empty' {_STRICT}
 when not contains(upper(sql), 'SELECT') then 'Query must contain SELECT statement' else '' end as reason
from {{sql_texts}}
""",
)
def strict_select_check(t: Inputs) -> DataFrame:
    reason = F.coalesce(R.strict_select_reason(F.col("sql")), F.lit(""))
    return t.spread("sql_texts", "sql_id").select("sql_id", reason.alias("reason"))


@query(
    "validate_query_result",
    f"""
select sql_id, {REASON} = '' as valid, {REASON} as errors,
 case when {REASON} = '' then '' else 'Query failed processor validation' end as processor_errors, 0 as warnings
from {{sql_texts}}
""",
)
def validate_query_result(t: Inputs) -> DataFrame:
    checked = Q.validate_sql_texts(t.spread("sql_texts", "sql_id"))
    reason = F.when(~F.col("valid"), F.col("reason"))
    return (
        checked.withColumn("r", R.validation_result(reason))
        .withColumn("p", R.validation_result(reason, with_processor=True))
        .select(
            "sql_id",
            "r.valid",
            F.array_join("r.errors", "; ").alias("errors"),
            F.array_join("p.errors", "; ").alias("processor_errors"),
            F.size("r.warnings").alias("warnings"),
        )
    )


@query(
    "explain_query",
    """
select sql_id, case when lower(trim(sql)) like 'select%' then 'Selects data from one or more tables.'
 when lower(trim(sql)) like 'insert%' then 'Inserts new rows into a table.'
 when lower(trim(sql)) like 'update%' then 'Updates existing rows in a table.'
 when lower(trim(sql)) like 'delete%' then 'Deletes rows from a table.'
 else 'This query executes a SQL statement.' end as explanation
from {sql_texts}
""",
)
def explain_query(t: Inputs) -> DataFrame:
    return t.spread("sql_texts", "sql_id").select("sql_id", R.explain_query(F.col("sql")).alias("explanation"))


@query(
    "suggest_optimizations",
    """
with found as (
 select sql_id, contains(lower(sql), 'select *') as star, contains(lower(sql), 'join') and not contains(lower(sql), 'on') as cartesian
 from {sql_texts})
select sql_id, case when not star and not cartesian then 'Review indexes on referenced tables and limit returned rows if possible.'
 else concat_ws(' | ', case when star then 'Avoid SELECT * and specify only needed columns.' end,
  case when cartesian then 'Include an explicit JOIN condition to avoid Cartesian products.' end) end as suggestions
from found
""",
)
def suggest_optimizations(t: Inputs) -> DataFrame:
    advice = R.suggest_optimizations(F.col("sql"))
    return t.spread("sql_texts", "sql_id").select("sql_id", F.array_join(advice, " | ").alias("suggestions"))


# ---- names --------------------------------------------------------------------

RELATIONS["raw_names"] = """
select p_partkey as id, case p_type when 'ECONOMY' then '  "Stage.P'||p_partkey||'" ' when 'MEDIUM' then '*'
 when 'STANDARD' then '`Part'||p_partkey||'`' when 'PROMO' then '''Mixed.'||p_brand||'''' when 'SMALL' then '' else p_name end as raw
from {part}
"""


def _qualified(cleaned: str) -> str:
    return (
        f"case when {cleaned} = '' then '' when contains({cleaned}, '.') then lower({cleaned}) "
        f"else 'public.'||lower({cleaned}) end"
    )


_SQL_NAME = "trim(trim(trim(trim(raw), '\"'), ''''), '`')"


@query(
    "normalize_table_name",
    f"""
select id, raw, {_qualified(f"case when {_SQL_NAME} = '*' then '' else {_SQL_NAME} end")} as in_sql,
 {_qualified("trim(trim(trim(raw), '\"'), '''')")} as in_job,
 {_qualified("trim(lower(trim(raw)), '`\"''')")} as in_change_text
from {{raw_names}}
""",
)
def normalize_table_name(t: Inputs) -> DataFrame:
    raw = F.col("raw")
    return t("raw_names").select(
        "id", "raw",
        X.sql_table_ref(raw).alias("in_sql"),
        X.etl_table_ref(raw).alias("in_job"),
        X.change_table_ref(raw).alias("in_change_text"),
    )


RELATIONS["identifiers"] = """
select c_custkey as id, case c_mktsegment when 'MACHINERY' then c_name when 'BUILDING' then 'col_'||c_custkey
 when 'AUTOMOBILE' then '' when 'FURNITURE' then repeat('x', 120 + c_nationkey) else c_custkey||'st' end as name,
 case c_mktsegment when 'MACHINERY' then 'user.'||c_custkey||'@mail.example.org' when 'BUILDING' then 'no-at-sign.example'
 when 'AUTOMOBILE' then 'x@y.z' when 'FURNITURE' then 'A+b%c_d-'||c_custkey||'@sub-domain.example.com' else 'two@@example.com' end as email
from {customer}
"""


def _identifier(what: str) -> str:
    return (
        f"case when name = '' then '{what} is empty' when length(name) > 128 then '{what} is too long' "
        f"when not regexp_matches(name, '^[a-zA-Z_][a-zA-Z0-9_]*$') then '{what} contains invalid characters' else '' end"
    )


@query(
    "validate_identifier",
    f"select id, name, {_identifier('Table name')} as table_reason, {_identifier('Column name')} as column_reason from {{identifiers}}",
)
def validate_identifier(t: Inputs) -> DataFrame:
    def reason(what: str):
        return F.coalesce(R.identifier_reason(F.col("name"), what), F.lit(""))

    return t("identifiers").select(
        "id", "name", reason("Table name").alias("table_reason"), reason("Column name").alias("column_reason")
    )


@query(
    "validate_email",
    """
select id, email, case when regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') then '' else 'Invalid email address' end as reason
from {identifiers}
""",
)
def validate_email(t: Inputs) -> DataFrame:
    reason = F.coalesce(R.email_reason(F.col("email")), F.lit(""))
    return t("identifiers").select("id", "email", reason.alias("reason"))


# ---- replies ------------------------------------------------------------------

# Expected SQL and explanation per reply shape, by hand.
RELATIONS["x_replies"] = """
select conv_id*1000+turn as reply_id,
 case turn when 1 then 'SELECT a FROM t'||conv_id||';' when 3 then 'select b from u where k = '||conv_id||';'
  when 5 then 'DROP TABLE x'||chr(10)||'is what you asked for' when 7 then 'SELECT c FROM v' when 2 then ''
  when 4 then 'WITH q AS (SELECT 1) SELECT * FROM q' else 'update w set a = 1' end as sql,
 case turn when 1 then 'uses t' when 7 then 'short' else '' end as explanation,
 case turn when 5 then 'Contains dangerous keyword: drop' when 2 then 'Empty SQL' else '' end as reason
from {conversations} where role = 'assistant'
"""


@query("extract_sql_from_text", "select reply_id, sql, explanation from {x_replies}")
def extract_sql_from_text(t: Inputs) -> DataFrame:
    return Q.extract_sql_from_texts(t.spread("llm_replies", "reply_id")).select("reply_id", "sql", "explanation")


@query(
    "llm_result_shape",
    """
select reply_id, case when reason = '' then sql else '' end as query,
 cast(case when reason = '' then 0.8 else 0.0 end as double) as confidence,
 case when reason = '' then explanation
  else 'Safety check failed: '||reason||'. Model output preview: '||replace(substring(sql, 1, 300), chr(10), ' ') end as explanation
from {x_replies}
""",
)
def llm_result_shape(t: Inputs) -> DataFrame:
    return Q.reply_results(t.spread("llm_replies", "reply_id")).select("reply_id", "query", "confidence", "explanation")


@query(
    "normalize_llm_result",
    """
select reply_id, case when reason = '' then sql else '' end as sql,
 cast(case when reason = '' then 0.8 else 0.0 end as double) as confidence,
 case when reason = '' then explanation else '' end as explanation, 0 as tables_used
from {x_replies}
""",
)
def normalize_llm_result(t: Inputs) -> DataFrame:
    results = Q.reply_results(t.spread("llm_replies", "reply_id"))
    safe = F.col("confidence") > 0
    # What a caller gets from a model that leaves fields out.
    sparse = results.select(
        "reply_id",
        F.lit(None).cast("string").alias("sql"),
        F.nullif("query", F.lit("")).alias("query"),
        F.when(safe, F.col("confidence")).alias("confidence"),
        F.when(safe, F.col("explanation")).alias("explanation"),
        F.lit(None).cast("array<string>").alias("tables_used"),
    )
    shaped = P.normalize_result(*[F.col(c) for c in sparse.columns[1:]])
    return sparse.select("reply_id", shaped.alias("r")).select(
        "reply_id", "r.sql", "r.confidence", "r.explanation", F.size("r.tables_used").alias("tables_used")
    )
