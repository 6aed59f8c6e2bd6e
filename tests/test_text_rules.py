"""Hand-written cases for SQL rules, change texts, replies and names."""

import pytest
from pyspark.sql import functions as F

from stemma.functions import changes, etl_rules, scores, sql_rules, text
from stemma.operators import sql_texts


@pytest.fixture
def over(spark):
    """Apply a DataFrame function to a list of texts, in order."""

    def run(values, fn):
        df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        return [r[0] for r in fn(df).orderBy("i").collect()]

    return run


def parsed(field):
    return lambda df: sql_texts.parse_sql_texts(df, "v").select(field, "i")


STATEMENTS = {
    "select a.x, b.y from shop.items a inner join shop.prices as b on a.id = b.id": ["shop.items", "shop.prices"],
    "-- from ghost\nselect 1 from real_t /* join ghost2 */ where c = 'from ghost3'": ["public.real_t"],
    "with a as (select * from src.one), b (k) as (select k from a join two) select * from a, b": ["public.two", "src.one"],
    "select * from (select id from inner_t) alias_t left join c.d on true": ["c.d", "public.inner_t"],
    "insert into mart.target (a, b) select a, b from stage.x, stage.y z where a in (select q from deep.t)": [
        "deep.t", "mart.target", "stage.x", "stage.y",
    ],
    "update dims set a = (select max(b) from facts)": ["public.dims", "public.facts"],
    'select trim(both from x) from "Weird"."Name"': ["weird.name"],
    "drop table if exists old_t": ["public.old_t"],
    "select 1": [],
    "select größe from überträge ü": ["public.überträge"],
    "select a from t for update of t": ["public.t"],
    "with x as (select 1 from base) insert into sink select * from x": ["public.base", "public.sink"],
}


def test_tables(over):
    assert over(STATEMENTS, parsed("tables")) == list(STATEMENTS.values())


def test_types_and_description(over):
    texts = ["with x as (select 1) insert into s select 1", "(select 1)", "create or replace view v as select 1", "", "vacuum"]
    assert over(texts, parsed("statement_type")) == ["INSERT", "SELECT", "CREATE OR REPLACE", "UNKNOWN", "UNKNOWN"]
    assert over(["", " ", "select 1 from b, a"], parsed("transformation_description")) == [
        "QUERY (no tables detected)", "UNKNOWN (no tables detected)", "SELECT using tables: public.a, public.b",
    ]


def test_joins_keep_text_order(over):
    text_ = "select 1 from a left  outer join s.b on 1=1 cross join c natural join d join lateral (select 1) x on true"
    (joins,) = over([text_], parsed("joins"))
    assert [(j.join_type, j.table) for j in joins] == [
        ("LEFT OUTER JOIN", "s.b"), ("CROSS JOIN", "public.c"), ("NATURAL JOIN", "public.d"),
    ]


def test_select_columns(over):
    texts = ["select distinct t.A, b as c, count(x, y) n, * from t", "update t set a = 1"]
    assert over(texts, parsed("columns")) == [["a", "b"], []]


def reasons(allowed=None):
    def run(df):
        if allowed is not None:
            df = df.withColumn("allowed", F.array(*[F.lit(a) for a in allowed]))
        return sql_texts.validate_sql_texts(df, "v", "allowed" if allowed is not None else None).select("reason", "i")

    return run


def test_main_check_uses_whole_words(over):
    texts = [
        "select deleted_at from t", "select 'drop' from t", "select 1 -- drop", "DROP TABLE t", "  ", "show tables",
        "truncate t; drop table t", "select \n", "insert into t select 1",
    ]
    dangerous = sql_rules.DANGEROUS_KEYWORD + "drop"
    assert over(texts, reasons()) == [
        "", dangerous, dangerous, dangerous, sql_rules.EMPTY, sql_rules.NOT_A_STATEMENT, dangerous, "", "",
    ]


def test_word_limits_count_non_ascii_letters(over):
    assert over(["select édrop from t", "select drop_é from t"], reasons()) == ["", ""]


def test_allowlist(over):
    texts = ["select 1 from sales.orders join customers on 1=1", "select 1 from admin.secret", "select 1 from a join b on 1=1"]
    assert over(texts, reasons(["orders", "public.Customers"])) == [
        "", sql_rules.DISALLOWED_TABLE + "secret", sql_rules.DISALLOWED_TABLE + "a",
    ]
    assert over(texts, reasons([])) == ["", "", ""]


def test_substring_checks_differ_from_the_main_check(over):
    def strict(df):
        return df.select(sql_rules.strict_select_reason(F.col("v")), "i")

    def basic(df):
        return df.select(sql_rules.basic_safety_reason(F.lower("v")), "i")

    texts = ["select deleted_at from t", "select 'drop' from t", "select 1 -- drop", "", "insert into t values (1)"]
    assert over(texts, strict) == [
        sql_rules.STRICT_DANGEROUS + "DELETE", sql_rules.STRICT_DANGEROUS + "DROP",
        sql_rules.STRICT_DANGEROUS + "DROP", sql_rules.STRICT_EMPTY, sql_rules.STRICT_NO_SELECT,
    ]
    assert over(["drop table t", "select 'drop'", "x"], basic) == [
        sql_rules.DANGEROUS_TOKEN + "drop", None, sql_rules.NOT_A_GENERATED_STATEMENT,
    ]


def test_replies(over):
    texts = [
        "```sql\nSELECT 1;\n```\nEXPLANATION: one",
        "```\nselect a from b\n```",
        "Here: with q as (select 1) select * from q; bye",
        "`select 1`",
        "select 'a;b' from t; x",
        "nothing here",
        "explanation: only text",
        None,
    ]

    def both(df):
        return sql_texts.extract_sql_from_texts(df, "v").select(F.struct("sql", "explanation"), "i")

    assert [tuple(r) for r in over(texts, both)] == [
        ("SELECT 1;", "one"), ("select a from b", ""), ("with q as (select 1) select * from q;", ""),
        ("select 1", ""), ("select 'a;", ""), ("nothing here", ""), ("", "only text"), ("", ""),
    ]


def test_unsafe_reply_shows_a_preview(over):
    def result(df):
        return sql_texts.reply_results(df, "v").select(F.struct("query", "confidence", "explanation"), "i")

    bad, good, long = over(["DROP\nTABLE x", "select 1", "y" * 400], result)
    assert tuple(bad) == ("", 0.0, "Safety check failed: Contains dangerous keyword: drop. Model output preview: DROP TABLE x")
    assert tuple(good) == ("select 1", 0.8, "")
    assert long.explanation.endswith("preview: " + "y" * 300)


CHANGES = {
    "Rename column X on public.customers": "public.customers",
    "Drop column freight on Orders": "public.orders",
    "ALTER TABLE public.products ADD COLUMN sku text": "public.products",
    "migrate data to warehouse.facts": "warehouse.facts",
    "Rename column company_name to legal_name": None,
    "copy a.bb into c.dd": "c.dd",
    "": None,
}


def test_change_targets(over):
    def target(df):
        return df.select(changes.extract_change_target(F.col("v")), "i")

    assert over(CHANGES, target) == list(CHANGES.values())


def test_change_text_beats_the_field(spark):
    df = spark.createDataFrame(
        [("Public.Orders ", "drop x on public.orders"), ("public.a", "drop x on bb"), (" public.a", "no table"), (None, "none")],
        "f string, t string",
    )
    got = [
        (r.asset_id, r.source, r.warning is not None)
        for r in changes.resolve_change_targets(df, "f", "t").collect()
    ]
    assert got == [
        ("public.orders", "change_text", False), ("public.bb", "change_text", True),
        ("public.a", "field", False), ("", "field", False),
    ]


def test_table_names(over):
    names = [' "Sales"."T" ', "`x`", "*", "'A.b'", "", '"']
    assert over(names, lambda d: d.select(text.sql_table_ref(F.col("v")), "i")) == [
        'sales"."t', "public.x", "", "a.b", "", "",
    ]
    assert over(names, lambda d: d.select(text.etl_table_ref(F.col("v")), "i"))[1] == "public.`x`"


def test_strip_removes_unicode_blanks(over):
    assert over([" 　 a b\x1c\n"], lambda d: d.select(text.strip(F.col("v")), "i")) == ["a b"]


def test_identifier_and_email(over):
    def name(df):
        return df.select(sql_rules.identifier_reason(F.col("v"), "Table name"), "i")

    assert over(["a_1", "1a", "", "x" * 128, "x" * 129], name) == [
        None, "Table name contains invalid characters", "Table name is empty", None, "Table name is too long",
    ]
    mail = lambda d: d.select(sql_rules.email_reason(F.col("v")), "i")
    assert over(["a.b@c.de", "a@b"], mail) == [None, "Invalid email address"]


def test_advice_and_explanation(over):
    advice = lambda d: d.select(sql_rules.suggest_optimizations(F.col("v")), "i")
    assert over(["select * from a join b", "select * from region join b", "select a from b"], advice) == [
        [sql_rules.AVOID_STAR, sql_rules.JOIN_CONDITION], [sql_rules.AVOID_STAR], [sql_rules.DEFAULT_ADVICE],
    ]
    explain = lambda d: d.select(sql_rules.explain_query(F.col("v")), "i")
    assert over([" Select 1", "with x as (select 1) select 1", "-- c\nselect 1"], explain) == [
        sql_rules.EXPLANATIONS["select"], sql_rules.EXPLAIN_OTHER, sql_rules.EXPLAIN_OTHER,
    ]


def test_scores(spark):
    df = spark.createDataFrame([(n,) for n in (0, 3, 4, 6, 7, 10, 99)], "n int")
    score = scores.degree_score(F.col("n"))
    assert [r[0] for r in df.select(scores.risk_level(score)).collect()] == [
        "low", "low", "medium", "medium", "high", "high", "high",
    ]
    half = spark.createDataFrame([(0.03125,), (0.09375,), (2.0,), (None,)], "s double")
    assert [r[0].count("█") for r in half.select(scores.score_bar(F.col("s"))).collect()] == [0, 2, 16, 0]
    d = spark.createDataFrame([(0.0,), (0.25,), (1.0,), (1.01,), (3.0,)], "d double")
    got = [r[0] for r in d.select(scores.distance_to_score(F.col("d"))).collect()]
    assert got == pytest.approx([1.0, 0.75, 0.0, 0.49751243781094523, 0.25])


def test_labels(spark):
    df = spark.createDataFrame([("a", "n", "table"), ("", "n", None), (None, None, "")], "i string, n string, t string")
    got = [r[0] for r in df.select(scores.asset_label(F.col("i"), F.col("n"), F.col("t"))).collect()]
    assert got == ["a (table)", "n", "?"]


def test_dependencies(spark):
    df = spark.createDataFrame(
        [("etl:x", None, None), (" y ", None, None), ("", None, None), (None, "e", "n"), (None, None, "n")],
        "t string, e string, n string",
    )
    dep = etl_rules.normalize_dependency(F.col("t"), F.col("e"), F.col("n"))
    assert [r[0] for r in df.select(dep).collect()] == ["etl:x", "etl:y", "", "etl:e", "etl:n"]
