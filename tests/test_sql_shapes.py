"""SQL shapes whose tables are easily missed, nested calls, and file names that need care."""

import time

import pytest
from pyspark.sql import functions as F

from stemma.functions import sql_rules as R
from stemma.functions.sql_parentheses import resolved_text
from stemma.sources import files

SHAPES = {
    'select * from "Order Details" d': ["public.order details"],
    'select * from a join "dbo"."My Table" t on a.i = t.i': ["dbo.my table", "public.a"],
    "select * from `Big Set`.`t 1`": ["big set.t 1"],
    "select * from a where a.x is distinct from b.y": ["public.a"],
    "select * from a where a.x is not distinct from b.y": ["public.a"],
    "select * from generate_series(1, 10) g, real r": ["public.real"],
    "select * from x join y on x.i = y.i, z": ["public.x", "public.y", "public.z"],
    "merge into tgt using src on tgt.i = src.i when matched then update set a = 1": ["public.src", "public.tgt"],
    "delete from a using b where a.i = b.i": ["public.a", "public.b"],
    "create table t (i int references o(id) on update cascade)": ["public.t"],
    "select * from (t1 join t2 on t1.i = t2.i)": ["public.t1", "public.t2"],
    "select * from only (t1)": ["public.t1"],
    "select $$text from q$$ from t": ["public.t"],
    "select E'it\\'s from q' from t": ["public.t"],
    "select extract(year from f(g(h(d)))) from facts": ["public.facts"],
    "select trim(both from (((((((x)))))))) from t, u": ["public.t", "public.u"],
    "insert into t (a, b) select a, b from s": ["public.s", "public.t"],
    "select a from (select b from inner_t) s join k using (id)": ["public.inner_t", "public.k"],
}


SHAPES |= {
    "select * from generate_series(1, greatest(a, b)) g": [],
    "select * from t join unnest(array_agg(x)) u on true, z": ["public.t", "public.z"],
    f"select * from f({'g(' * 8}x{')' * 8}) a, b": ["public.b"],
    "select * from unnest(array(select y from real where y in (1, 2))) u, z": ["public.real", "public.z"],
    f"select * from {'f((select x from ' * 8}t{'))' * 8}": ["public.t"],
    "select * from f(extract(year from g(d))) a join h((select 1)) b on a.x = b.x": [],
    "select * from f(g(h(x)": [],
    "select extract(year from d": [],
}


def test_tables_of_shapes(spark):
    rows = spark.createDataFrame([(s,) for s in SHAPES], "sql string")
    found = {r.sql: r.tables for r in rows.select("sql", R.extract_tables(R.mask(F.col("sql"))).alias("tables")).collect()}
    assert found == SHAPES


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_functions_in_from_are_no_joins(spark, depth):
    sql = f"select a from t left join f{'(g' * depth}(x){')' * depth} u on true join k on k.i = u.i"
    rows = spark.createDataFrame([(sql,)], "sql string")
    found = rows.select(R.extract_joins(R.mask(F.col("sql"))).alias("joins")).first().joins
    assert [tuple(j) for j in found] == [("JOIN", "public.k")]


@pytest.mark.parametrize("depth", [1, 3, 8, 20])
def test_columns_do_not_depend_on_depth(spark, depth):
    sql = f"select a, {'f(' * depth}x, y{')' * depth} as v, b from t"
    rows = spark.createDataFrame([(sql,)], "sql string")
    found = rows.select(R.select_columns(R.mask(F.col("sql")), F.lit("SELECT")).alias("c")).first().c
    assert found == ["a", "b"]


def test_file_names_are_decoded_and_suffixes_in_any_case(spark, tmp_path):
    folder = tmp_path / "sub dir"
    folder.mkdir()
    names = ["my report.sql", "a+b.Sql", "100%.SQL", "x#1.sQl"]
    for n in names:
        (folder / n).write_text("select 1")
    found = {r.source for r in files.scan_sql_files(spark, [str(tmp_path)], str(tmp_path)).collect()}
    assert found == {f"sub dir/{n}" for n in names}


def test_a_percent_sign_in_a_file_name_is_no_escape(spark, tmp_path):
    names = ["b%20c.sql", "50%25.sql", "100%.sql"]
    for n in names:
        (tmp_path / n).write_text("select 1")
    assert {r.source for r in files.scan_sql_files(spark, [str(tmp_path)], str(tmp_path)).collect()} == set(names)


def test_empty_jobs_are_dropped(spark, tmp_path):
    (tmp_path / "y.Json").write_text('{"etl_jobs": [{}, {"name": "y", "sources": ["real"]}]}')
    (tmp_path / "z.json").write_text("{}")
    found = files.scan_etl_configs(spark, [str(tmp_path)], str(tmp_path)).collect()
    assert [r.name for r in found] == ["y"]


MORE_SHAPES = {
    "select count(*) from t (nolock)": ["public.t"],
    "select a from t with (nolock), s (updlock, rowlock)": ["public.s", "public.t"],
    "select a from only(t1)": ["public.t1"],
    "select a from only (t1), b": ["public.b", "public.t1"],
    "select 1 from t1 join lateral f(x(y)) on (a=b), t2": ["public.t1", "public.t2"],
    "select 1 from x join y on (x.i=y.i), z": ["public.x", "public.y", "public.z"],
    "select 1 from a join b on f(a.x, b.y) = 1 and (a.z=(b.z)), c left join d on (1=1), e": [f"public.{t}" for t in "abcde"],
    "select 1 from a, unnest(array_agg(x)) u": ["public.a"],
    "select 1 from a, unnest(array_agg(x)) u, b": ["public.a", "public.b"],
    "select distinct on (a) x, y from t": ["public.t"],
    "select distinct on (a) x, y from t join u on (t.a = u.a), v": ["public.t", "public.u", "public.v"],
    "select 1 from (select 1 from p join q on (p.i in (1, 2)), r) s, w": ["public.p", "public.q", "public.r", "public.w"],
    "select a from t) x, u": ["public.t"],
}


def test_tables_behind_conditions_hints_and_functions(spark):
    rows = spark.createDataFrame([(s,) for s in MORE_SHAPES], "sql string")
    found = {r.sql: r.tables for r in rows.select("sql", R.extract_tables(R.mask(F.col("sql"))).alias("tables")).collect()}
    assert found == MORE_SHAPES


def test_work_grows_with_the_length_of_the_text():
    """30 KB with 1,600 calls in less than a tenth of a second; ten times as much in less than twenty times that."""

    def seconds(calls):
        text = "select " + ", ".join(f"coalesce(a{k}, b{k})" for k in range(calls)) + " from t"
        best = []
        for _ in range(3):
            start = time.perf_counter()
            resolved_text(text)
            best.append(time.perf_counter() - start)
        return len(text), min(best)

    (size, short), (_, long) = seconds(1600), seconds(16000)
    assert size > 30_000 and short < 0.1 and long < 20 * short
