"""Rules over SQL texts as column expressions: safety checks, references, descriptions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions.sql_parentheses import AFTER_ON, NAME, resolved
from stemma.functions.text import sql_table_ref, strip

# Blocked words of the main check, in the order they are reported.
BLOCKED_WORDS = ("drop", "truncate", "delete", "alter", "grant", "revoke", "shutdown")
# Blocked substrings of the strict select-only check, in order.
STRICT_WORDS = ("DROP", "DELETE", "TRUNCATE", "ALTER")
STATEMENT_WORDS = r"(?U)\b(select|with|insert|update)\b"

# Messages of the checks.
EMPTY = "Empty SQL"
DANGEROUS_KEYWORD = "Contains dangerous keyword: "
DANGEROUS_TOKEN = "Contains dangerous token: "
NOT_A_STATEMENT = "SQL does not appear to be a SELECT/INSERT/UPDATE/WITH statement"
NOT_A_GENERATED_STATEMENT = (
    "Generated SQL does not appear to be a SELECT/WITH/INSERT/UPDATE statement"
)
DISALLOWED_TABLE = "References disallowed table: "
PROCESSOR_FAILED = "Query failed processor validation"
STRICT_EMPTY = "SQL query is empty"
STRICT_DANGEROUS = "Query contains dangerous keyword: "
STRICT_NO_SELECT = "Query must contain SELECT statement"

TABLE_INTRO = (
    r"(?:\b(?:from|join)\s*(?:\(\s*)*(?<=[\s(])|\b(?:into|using|(?<!\bon\s{1,9})update|table)\s+)"
    r"(?:if\s+(?:not\s+)?exists\s+|only\b\s*\(?\s*)?"
)
ONE_REF = NAME + r"(?:\s+(?:as\s+)?\w+)?"
MORE_REFS = r"(?:\s*,\s*" + ONE_REF + ")+"
TABLE_AFTER_WORD = "(?iU)" + TABLE_INTRO + "(" + NAME + ")"
TABLE_LIST = "(?iU)" + TABLE_INTRO + "(" + ONE_REF + MORE_REFS + ")"
COMMA_AFTER_ON = "(?iU)" + AFTER_ON
# Table hints in parentheses.
HINTS = (
    "nolock|readuncommitted|readcommitted|readpast|repeatableread|serializable|snapshot|updlock|xlock|rowlock|paglock|"
    "tablock|tablockx|holdlock|nowait|noexpand"
)
HINT_LIST = r"(?iU)(?:\bwith\s*)?\(\s*(?:" + HINTS + r")(?:\s*,\s*(?:" + HINTS + r"))*\s*\)"
CTE_FIRST = r"(?iU)\bwith\s+(?:recursive\s+)?(\w+)\s*(?:\([^()]*\)\s*)?as\b"
CTE_NEXT = r"(?iU),\s*(\w+)\s*(?:\([^()]*\)\s*)?as\s*(?:not\s+)?(?:materialized\s*)?\("
JOIN = (
    r"(?iU)\b((?:(?:left|right|full)\s+)?(?:(?:inner|outer|straight)\s+)?"
    r"(?:(?:cross|natural)\s+)?join)\s+(" + NAME + ")"
)
# Words that can follow a table word without naming a table.
NOT_NAMES = ("select", "set", "of", "lateral", "values", "nowait", "skip", "where", "*")
# First words that give a statement its type.
TYPE_WORDS = (
    "SELECT", "INSERT", "UPDATE", "DELETE", "UPSERT", "REPLACE", "MERGE", "COMMIT",
    "ROLLBACK", "START", "CREATE", "ALTER", "DROP", "TRUNCATE",
)


def has_word(lowered: Column, word: str) -> Column:
    return F.contains(lowered, F.lit(word)) & lowered.rlike(rf"(?U)\b{word}\b")


def is_blank(sql: Column) -> Column:
    return F.coalesce(strip(sql), F.lit("")) == ""


# ---- references and structure -------------------------------------------------


def _replaced(text: Column, may_match, pattern: str, by: str) -> Column:
    """``regexp_replace`` only where ``may_match`` holds, a cheap test that every match needs; the text is evaluated once."""
    return F.transform(F.array(text), lambda x: F.when(may_match(x), F.regexp_replace(x, pattern, by)).otherwise(x))[0]


def without_literals(sql: Column) -> Column:
    """Comments, quoted literals, IS DISTINCT FROM and table hints become blanks."""

    def has_any(*marks: str):
        return lambda x: reduce(Column.__or__, [F.contains(x, F.lit(m)) for m in marks])

    plain = _replaced(
        sql, has_any("'", "$", "--", "/*"),
        r"(?i)\be'(?:[^'\\]|\\.|'')*+'|'[^']*'|\$(\w*)\$[\s\S]*?\$\1\$|--[^\n]*|/\*[\s\S]*?\*/", " ",
    )
    plain = _replaced(plain, lambda x: x.rlike("(?iu)distinct"), r"(?iU)\bis\s+(?:not\s+)?distinct\s+from\b", " = ")
    return _replaced(plain, has_any("("), HINT_LIST, " ")


def resolved_lists(plain: Column) -> Column:
    """Second half of :func:`mask`, from the text ``without_literals``; give it a column, as it reads the text several times."""
    nested = F.contains(plain, F.lit("("))
    goes_on = F.contains(plain, F.lit(",")) & plain.rlike("(?iu)on")
    flat = F.when(goes_on, F.regexp_replace(plain, COMMA_AFTER_ON, "$1 from ")).otherwise(plain)
    return F.when(nested, resolved(F.when(nested, plain))).otherwise(flat)


def mask(sql: Column) -> Column:
    """Comments, quoted literals and whatever uses FROM as a word of an expression become blanks.

    Calls that use FROM lose their arguments, and functions in FROM, behind a comma too, become LATERAL; the statements in
    their arguments follow behind the text. A comma that goes on with the FROM list after a join condition becomes FROM.
    Texts with parentheses pass through ``sql_parentheses.resolved`` in Arrow batches; the others stay in the JVM.
    """
    return resolved_lists(without_literals(sql))


def outer_text(sql: Column) -> Column:
    """The text outside all parentheses, whatever their depth; an outermost pair becomes '#'."""

    def step(state: Column, part: Column) -> Column:
        opens, closes = F.startswith(part, F.lit("(")), F.startswith(part, F.lit(")"))
        depth = F.greatest(state["depth"] + opens.cast("int") - closes.cast("int"), F.lit(0))
        kept = (
            F.when(opens & (state["depth"] == 0), F.lit("#"))
            .when(closes & (depth == 0), F.substring(part, 2, 2**31 - 1))
            .when(depth == 0, part)
            .otherwise(F.lit(""))
        )
        return F.struct(depth.alias("depth"), F.concat(state["text"], kept).alias("text"))

    begin = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
    return F.aggregate(F.split(sql, "(?=[()])"), begin, step)["text"]


def _found(text: Column, may_match: Column, pattern: str) -> Column:
    """``regexp_extract_all`` of group 1 only where ``may_match`` holds, a cheap test that every match needs."""
    return F.when(may_match, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))


def cte_names(masked: Column) -> Column:
    comma = F.contains(masked, F.lit(",")) & F.contains(masked, F.lit("("))
    return F.transform(
        F.concat(_found(masked, masked.rlike("(?iu)with"), CTE_FIRST), _found(masked, comma, CTE_NEXT)), F.lower
    )


def _names(masked: Column) -> Column:
    lists = _found(masked, F.contains(masked, F.lit(",")), TABLE_LIST)
    listed = F.flatten(F.transform(lists, lambda x: F.split(x, ",")))
    return F.concat(
        F.regexp_extract_all(masked, F.lit(TABLE_AFTER_WORD), F.lit(1)),
        F.transform(listed, lambda x: F.regexp_extract(x, "(?U)" + NAME, 0)),
    )


def _ref(raw: Column, default_schema: str) -> Column:
    return sql_table_ref(F.translate(raw, '"`', ""), default_schema)


def extract_tables(masked: Column, default_schema: str = "public") -> Column:
    """Sorted distinct ``schema.table`` names a masked statement touches, CTEs left out."""
    bare = F.transform(_names(masked), lambda x: F.lower(F.translate(x, '"`', "")))
    real = F.array_except(bare, cte_names(masked))
    kept = F.filter(real, lambda x: (x != "") & ~x.isin(*NOT_NAMES))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda x: sql_table_ref(x, default_schema))))


def extract_joins(masked: Column, default_schema: str = "public") -> Column:
    """Array of (join_type, table) in text order."""
    zipped = F.arrays_zip(
        F.regexp_extract_all(masked, F.lit(JOIN), F.lit(1)).alias("word"),
        F.regexp_extract_all(masked, F.lit(JOIN), F.lit(2)).alias("name"),
    )
    named = F.filter(zipped, lambda j: ~F.lower(j["name"]).isin(*NOT_NAMES))
    joins = F.transform(
        named,
        lambda j: F.struct(
            F.upper(F.regexp_replace(j["word"], r"\s+", " ")).alias("join_type"),
            _ref(j["name"], default_schema).alias("table"),
        ),
    )
    none = F.array().cast("array<struct<join_type:string,table:string>>")
    return F.when(masked.rlike("(?iu)join"), joins).otherwise(F.when(masked.isNotNull(), none))


def statement_type(masked: Column) -> Column:
    """Type word of the first statement; after a WITH list the word that follows it."""
    word = F.upper(F.regexp_extract(masked, r"(?U)^[\s(;]*(\w+)", 1))
    body = F.upper(
        F.regexp_extract(masked, r"(?iU)\)\s*(select|insert|update|delete|merge|replace)\b", 1)
    )
    replacing = masked.rlike(r"(?iU)^[\s(;]*create\s+or\s+replace\b")
    return (
        F.when((word == "WITH") & (body != ""), body)
        .when(replacing, F.lit("CREATE OR REPLACE"))
        .when(word.isin(*TYPE_WORDS), word)
        .otherwise(F.lit("UNKNOWN"))
    )


def select_columns(masked: Column, kind: Column) -> Column:
    """Sorted plain column names of the first SELECT list (best effort)."""
    items = F.split(F.regexp_extract(outer_text(masked), r"(?isU)\bselect\s+(?:distinct\s+)?(.*?)\bfrom\b", 1), ",")
    plain = F.transform(
        items,
        lambda x: F.regexp_extract(
            strip(x), r"""(?iU)^([\w."`$]+)(?:\s+(?:as\s+)?[\w"`]+)?$""", 1
        ),
    )
    last = F.transform(plain, lambda x: F.lower(F.substring_index(F.translate(x, '"`', ""), ".", -1)))
    found = F.array_sort(F.array_distinct(F.filter(last, lambda x: x != "")))
    empty = F.array().cast("array<string>")
    return F.when(kind == "SELECT", found).otherwise(empty)


def describe_sql(kind: Column, tables: Column) -> Column:
    return F.when(
        F.size(tables) > 0,
        F.concat(kind, F.lit(" using tables: "), F.array_join(tables, ", ")),
    ).otherwise(F.concat(kind, F.lit(" (no tables detected)")))


# ---- safety checks ------------------------------------------------------------


def referenced_tables(sql: Column) -> Column:
    """Names after FROM, then names after JOIN, quotes stripped, in text order."""
    found = F.concat(
        F.regexp_extract_all(sql, F.lit(r"""(?iU)\bfrom\s+([\w."]+)"""), F.lit(1)),
        F.regexp_extract_all(sql, F.lit(r"""(?iU)\bjoin\s+([\w."]+)"""), F.lit(1)),
    )
    return F.transform(found, lambda x: strip(x, '"'))


def _last_part(name: Column) -> Column:
    return strip(F.substring_index(name, ".", -1), '"')


def first_disallowed_table(sql: Column, allowed: Column) -> Column:
    """First referenced table outside the allowlist; null when all are allowed.

    An empty allowlist means no check.
    """
    names = F.filter(F.transform(referenced_tables(sql), _last_part), lambda x: x != "")
    permitted = F.transform(allowed, lambda x: F.lower(_last_part(x)))
    outside = F.filter(names, lambda x: ~F.array_contains(permitted, F.lower(x)))
    return F.when(F.size(allowed) > 0, F.get(outside, F.lit(0)))


def invalid_reason(
    sql: Column,
    lowered: Column,
    allowed: Column | None = None,
    blocked: Sequence[str] = BLOCKED_WORDS,
) -> Column:
    """Reason a statement is refused; null when it is safe to run."""
    reason = F.when(is_blank(sql), F.lit(EMPTY))
    for word in blocked:
        reason = reason.when(has_word(lowered, word), F.lit(DANGEROUS_KEYWORD + word))
    reason = reason.when(~lowered.rlike(STATEMENT_WORDS), F.lit(NOT_A_STATEMENT))
    if allowed is not None:
        outside = first_disallowed_table(sql, allowed)
        reason = reason.when(outside.isNotNull(), F.concat(F.lit(DISALLOWED_TABLE), outside))
    return reason


def verdict(reason: Column) -> Column:
    return F.struct(
        reason.isNull().alias("valid"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    )


def basic_safety_reason(lowered: Column) -> Column:
    """Fallback check: blocked words followed by a blank, as plain substrings."""
    reason = F.when(F.lit(False), F.lit(""))
    for word in BLOCKED_WORDS:
        reason = reason.when(
            F.contains(lowered, F.lit(word + " ")), F.lit(DANGEROUS_TOKEN + word)
        )
    return reason.when(~lowered.rlike(STATEMENT_WORDS), F.lit(NOT_A_GENERATED_STATEMENT))


def strict_select_reason(sql: Column) -> Column:
    """Select-only check on plain substrings, so ``deleted_at`` is refused too."""
    upper = F.upper(sql)
    reason = F.when(F.coalesce(sql, F.lit("")) == "", F.lit(STRICT_EMPTY))
    for word in STRICT_WORDS:
        reason = reason.when(F.contains(upper, F.lit(word)), F.lit(STRICT_DANGEROUS + word))
    return reason.when(~F.contains(upper, F.lit("SELECT")), F.lit(STRICT_NO_SELECT))


def validation_result(reason: Column, with_processor: bool = False) -> Column:
    """valid / errors / warnings; a processor hides the reason behind one message."""
    message = F.lit(PROCESSOR_FAILED) if with_processor else reason
    none = F.array().cast("array<string>")
    return F.struct(
        reason.isNull().alias("valid"),
        F.when(reason.isNull(), none).otherwise(F.array(message)).alias("errors"),
        none.alias("warnings"),
    )


def identifier_reason(name: Column, what: str) -> Column:
    """Rule for table and column names; ``what`` is 'Table name' or 'Column name'."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", F.lit(f"{what} is empty"))
        .when(F.length(name) > 128, F.lit(f"{what} is too long"))
        .when(~name.rlike(r"^[a-zA-Z_][a-zA-Z0-9_]*$"), F.lit(f"{what} contains invalid characters"))
    )


def email_reason(address: Column) -> Column:
    pattern = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
    return F.when(~F.coalesce(address, F.lit("")).rlike(pattern), F.lit("Invalid email address"))


# ---- explanations -------------------------------------------------------------

# Sentence per first word.
EXPLANATIONS = {
    "select": "Selects data from one or more tables.",
    "insert": "Inserts new rows into a table.",
    "update": "Updates existing rows in a table.",
    "delete": "Deletes rows from a table.",
}
EXPLAIN_OTHER = "This query executes a SQL statement."
# Advice texts.
AVOID_STAR = "Avoid SELECT * and specify only needed columns."
JOIN_CONDITION = "Include an explicit JOIN condition to avoid Cartesian products."
DEFAULT_ADVICE = "Review indexes on referenced tables and limit returned rows if possible."


def explain_query(sql: Column) -> Column:
    start = F.lower(strip(sql))
    out = F.when(F.lit(False), F.lit(""))
    for word, sentence in EXPLANATIONS.items():
        out = out.when(F.startswith(start, F.lit(word)), F.lit(sentence))
    return out.otherwise(F.lit(EXPLAIN_OTHER))


def suggest_optimizations(sql: Column) -> Column:
    low = F.lower(sql)
    star = F.when(F.contains(low, F.lit("select *")), F.lit(AVOID_STAR))
    join = F.when(
        F.contains(low, F.lit("join")) & ~F.contains(low, F.lit("on")), F.lit(JOIN_CONDITION)
    )
    advice = F.array_compact(F.array(star, join))
    return F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(DEFAULT_ADVICE)))
