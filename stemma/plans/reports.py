"""Report and load jobs on the star schema.

Facts are summed per key before they meet a dimension, so a customer, product or
supplier with a large share of all rows is reduced inside each task and the join
moves one row per key. Money is decimal until the last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.operators import store as ST
from stemma.plans.registry import Inputs, query
from stemma.session import materialize, new_folder

RECENT = "1998-01-01"


def _money(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0)).cast("decimal(12,2)")


def line_revenue() -> Column:
    return F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - _money("l_discount"))


REVENUE = "cast(l_extendedprice as decimal(12,2)) * (1 - cast(coalesce(l_discount, 0) as decimal(12,2)))"


def _double(total: Column) -> Column:
    return F.sum(total).cast("double")


def _orders_per_customer(t: Inputs) -> DataFrame:
    counts = t("orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return (
        t("customer")
        .select("c_custkey", "c_name")
        .join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
        .groupBy("c_name")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("order_count"))
    )


ORDERS_PER_CUSTOMER = """
select c_name, count(o_orderkey) as order_count from {customer} left join {orders} on o_custkey = c_custkey group by c_name
"""


@query("q_orders_by_customer", ORDERS_PER_CUSTOMER + " order by order_count desc, c_name")
def orders_by_customer(t: Inputs) -> DataFrame:
    return _orders_per_customer(t).orderBy(F.desc("order_count"), "c_name")


@query(
    "q_customers_recent_orders",
    """
select c_custkey, c_name, c_mktsegment, o_orderkey, o_orderdate, o_totalprice from {customer} join {orders} on o_custkey = c_custkey
where o_orderdate >= date '1998-01-01' order by o_orderdate desc, c_name, o_orderkey
""",
)
def customers_recent_orders(t: Inputs) -> DataFrame:
    recent = t("orders").where(F.col("o_orderdate") >= F.lit(RECENT).cast("date"))
    return (
        recent.join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "inner")
        .select("c_custkey", "c_name", "c_mktsegment", "o_orderkey", "o_orderdate", "o_totalprice")
        .orderBy(F.desc("o_orderdate"), "c_name", "o_orderkey")
    )


def _sales_per_part(t: Inputs) -> DataFrame:
    return t("lineitem").groupBy("l_partkey").agg(
        F.sum(line_revenue()).alias("revenue"),
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("units"),
    )


@query(
    "q_product_revenue_by_category",
    f"""
select p_type, p_name, sum({REVENUE})::double as line_revenue, sum(cast(l_quantity as decimal(12,2)))::double as units_sold
from {{part}} join {{lineitem}} on l_partkey = p_partkey group by p_type, p_name order by line_revenue desc, p_type, p_name
""",
)
def product_revenue_by_category(t: Inputs) -> DataFrame:
    return (
        _sales_per_part(t)
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "inner")
        .groupBy("p_type", "p_name")
        .agg(_double(F.col("revenue")).alias("line_revenue"), _double(F.col("units")).alias("units_sold"))
        .orderBy(F.desc("line_revenue"), "p_type", "p_name")
    )


@query(
    "q_employee_sales_totals",
    f"""
select s_suppkey, s_name||' '||n_name as employee_name, count(distinct o_orderkey) as order_count, sum({REVENUE})::double as revenue
from {{supplier}} join {{nation}} on n_nationkey = s_nationkey join {{lineitem}} on l_suppkey = s_suppkey join {{orders}} on o_orderkey = l_orderkey
group by s_suppkey, s_name, n_name order by revenue desc nulls last, s_suppkey
""",
)
def employee_sales_totals(t: Inputs) -> DataFrame:
    # One row per (supplier, order) first: counting those rows replaces count distinct.
    per_order = t("lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum(line_revenue()).alias("revenue"))
    per_supplier = (
        per_order.join(t("orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        .groupBy("l_suppkey")
        .agg(F.count(F.lit(1)).alias("order_count"), _double(F.col("revenue")).alias("revenue"))
    )
    return (
        per_supplier.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "inner")
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "inner")
        .select("s_suppkey", F.concat_ws(" ", "s_name", "n_name").alias("employee_name"), "order_count", "revenue")
        .orderBy(F.desc_nulls_last("revenue"), "s_suppkey")
    )


SHIPPED = ("o_orderkey", "l_linenumber", "l_shipdate", "shipper_name", "l_partkey")


@query(
    "q_recent_orders_by_shipper",
    """
select o_orderkey, o_orderdate, l_linenumber, l_shipdate, s_name as shipper_name, l_partkey
from {orders} join {lineitem} on l_orderkey = o_orderkey join {supplier} on s_suppkey = l_suppkey
where l_shipdate is not null order by o_orderdate desc, o_orderkey, l_linenumber, l_shipdate, shipper_name, l_partkey limit 50
""",
)
def recent_orders_by_shipper(t: Inputs) -> DataFrame:
    lines = t("lineitem").where(F.col("l_shipdate").isNotNull())
    return (
        lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "inner")
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "inner")
        .select("o_orderkey", "o_orderdate", "l_linenumber", "l_shipdate", F.col("s_name").alias("shipper_name"), "l_partkey")
        .orderBy(F.desc("o_orderdate"), *SHIPPED)
        .limit(50)
    )


@query(
    "q_customers_with_orders",
    """
select c_custkey, c_name, o_orderkey, o_orderdate from {customer} as c inner join {orders} as o on c_custkey = o_custkey
where o_orderdate >= '1998-01-01' order by o_orderdate desc, o_orderkey
""",
)
def customers_with_orders(t: Inputs) -> DataFrame:
    return (
        t("orders")
        .where(F.col("o_orderdate") >= RECENT)
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "inner")
        .select("c_custkey", "c_name", "o_orderkey", "o_orderdate")
        .orderBy(F.desc("o_orderdate"), "o_orderkey")
    )


@query(
    "q_product_sales",
    "select p_name, sum(cast(l_quantity as decimal(12,2)))::double as total_qty from {part} join {lineitem} on l_partkey = p_partkey group by p_name",
)
def product_sales(t: Inputs) -> DataFrame:
    units = t("lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("units"))
    return (
        units.join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "inner")
        .groupBy("p_name")
        .agg(_double(F.col("units")).alias("total_qty"))
    )


# ---- load jobs ----------------------------------------------------------------


@query("etl_orders_summary", ORDERS_PER_CUSTOMER)
def load_orders_summary(t: Inputs) -> DataFrame:
    return materialize(_orders_per_customer(t), "orders-summary")


@query(
    "etl_order_line_facts",
    """
select o_orderkey, o_custkey, o_orderdate, l_linenumber, l_partkey, p_name, cast(l_quantity as decimal(12,2))::double as quantity,
 cast(l_extendedprice as decimal(12,2))::double as price, cast(least(greatest(coalesce(l_discount, 0), 0), 1) as decimal(12,2))::double as discount
from {orders} join {lineitem} on l_orderkey = o_orderkey join {part} on p_partkey = l_partkey
""",
)
def load_order_line_facts(t: Inputs) -> DataFrame:
    discount = F.least(F.greatest(F.coalesce("l_discount", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))

    def amount(c) -> Column:
        return F.col(c) if isinstance(c, str) else c

    facts = (
        t("lineitem")
        .join(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "inner")
        .join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "inner")
        .select(
            "o_orderkey", "o_custkey", "o_orderdate", "l_linenumber", "l_partkey", "p_name",
            *[
                amount(c).cast("decimal(12,2)").cast("double").alias(name)
                for c, name in (("l_quantity", "quantity"), ("l_extendedprice", "price"), (discount, "discount"))
            ],
        )
    )
    # Append only: earlier rows of the target are never touched by a later load.
    target = new_folder(t.spark, "order-line-fact")
    facts.write.mode("append").parquet(target)
    return t.spark.read.schema(facts.schema).parquet(target)


@query(
    "etl_product_sales_fact",
    f"""
select p_partkey as product_id, coalesce(s.line_revenue, 0.0::double) as line_revenue, coalesce(s.units_sold, 0.0::double) as units_sold
from {{part}} left join (
 select l_partkey, sum({REVENUE})::double as line_revenue, sum(cast(l_quantity as decimal(12,2)))::double as units_sold
 from {{lineitem}} group by l_partkey) s on s.l_partkey = p_partkey
union all
select l_partkey, sum({REVENUE})::double, sum(cast(l_quantity as decimal(12,2)))::double
from {{lineitem}} where l_partkey not in (select p_partkey from {{part}}) group by l_partkey
""",
)
def load_product_sales_fact(t: Inputs) -> DataFrame:
    stored = t("part").select(
        F.col("p_partkey").alias("product_id"), F.lit(0.0).alias("line_revenue"), F.lit(0.0).alias("units_sold")
    )
    new = t("lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(
        _double(line_revenue()).alias("line_revenue"),
        _double(F.col("l_quantity").cast("decimal(12,2)")).alias("units_sold"),
    )
    return materialize(ST.upsert(stored, new, ["product_id"]), "product-sales-fact")


@query(
    "etl_employee_dim",
    """
select s_suppkey as employee_id, case when s_acctbal >= 0 then s_name||' '||n_name else s_name end as full_name,
 case when s_acctbal >= 0 then r_name else 'unknown' end as region
from {supplier} join {nation} on n_nationkey = s_nationkey join {region} on r_regionkey = n_regionkey
""",
)
def load_employee_dim(t: Inputs) -> DataFrame:
    """SCD type 1: active rows overwrite the stored attributes, inactive ones keep them."""
    stored = t("supplier").select(
        F.col("s_suppkey").alias("employee_id"), F.col("s_name").alias("full_name"), F.lit("unknown").alias("region")
    )
    active = (
        t("supplier")
        .where(F.col("s_acctbal") >= 0)
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "inner")
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "inner")
        .select(
            F.col("s_suppkey").alias("employee_id"),
            F.concat_ws(" ", "s_name", "n_name").alias("full_name"),
            F.col("r_name").alias("region"),
        )
    )
    return materialize(ST.upsert(stored, active, ["employee_id"]), "employee-dim")


def scd2(current: DataFrame, incoming: DataFrame, key: str, effective: str) -> DataFrame:
    """SCD type 2: a changed row is closed at ``effective`` and a new one opened.

    ``current`` has the attributes plus valid_from, valid_to, is_current; keys that
    no longer arrive stay open.
    """
    attributes = [c for c in incoming.columns if c != key]
    day = F.lit(effective).cast("date")
    history = current.where(~F.col("is_current"))
    old = current.where("is_current").select(key, F.struct(*attributes).alias("_old"), "valid_from")
    new = incoming.select(key, F.struct(*attributes).alias("_new"))
    never = F.lit(None).cast("date")

    def version(values: str, start: Column, end: Column, open_: bool) -> Column:
        return F.struct(
            *[F.col(f"{values}.{a}").alias(a) for a in attributes],
            start.alias("valid_from"), end.alias("valid_to"), F.lit(open_).alias("is_current"),
        )

    added, gone = F.col("_old").isNull(), F.col("_new").isNull()
    same = gone | F.col("_old").eqNullSafe(F.col("_new"))
    opened = version("_new", day, never, True)
    versions = (
        F.when(added, F.array(opened))
        .when(same, F.array(version("_old", F.col("valid_from"), never, True)))
        .otherwise(F.array(version("_old", F.col("valid_from"), day, False), opened))
    )
    rows = old.join(new, key, "full_outer").select(key, F.inline(versions))
    return rows.unionByName(history.select(*rows.columns))


@query(
    "etl_customer_dim",
    """
with big as (select distinct o_custkey from {orders} where o_totalprice > 450000),
inc as (
 select cast(c_custkey as varchar) as customer_id, c_name as customer_name, case when o_custkey is not null then 'KEY ACCOUNT' else c_mktsegment end as segment
 from {customer} left join big on o_custkey = c_custkey
 union all select 'S'||s_suppkey, s_name, 'PARTNER' from {supplier}),
cur as (select cast(c_custkey as varchar) as customer_id, c_name as customer_name, c_mktsegment as segment from {customer})
select customer_id, customer_name, segment, case when kind = 'new' then '2002-01-01' else '1995-01-01' end as valid_from,
 case when kind = 'closed' then '2002-01-01' end as valid_to, kind <> 'closed' as is_current
from (
 select cur.*, case when inc.segment = cur.segment then 'open' else 'closed' end as kind from cur join inc using (customer_id)
 union all select inc.*, 'new' from inc left join cur using (customer_id) where cur.segment is null or cur.segment <> inc.segment)
""",
)
def load_customer_dim(t: Inputs) -> DataFrame:
    base = t("customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
    )
    current = (
        base.withColumn("valid_from", F.lit("1995-01-01").cast("date"))
        .withColumn("valid_to", F.lit(None).cast("date"))
        .withColumn("is_current", F.lit(True))
    )
    big = t("orders").where(F.col("o_totalprice") > 450000).select(F.col("o_custkey").cast("string").alias("customer_id")).distinct()
    known = base.join(big.withColumn("_big", F.lit(True)), "customer_id", "left")
    incoming = known.select(
        "customer_id", "customer_name",
        F.when(F.col("_big"), F.lit("KEY ACCOUNT")).otherwise(F.col("segment")).alias("segment"),
    ).unionByName(
        t("supplier").select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("customer_id"),
            F.col("s_name").alias("customer_name"), F.lit("PARTNER").alias("segment"),
        )
    )
    dim = materialize(scd2(current, incoming, "customer_id", "2002-01-01"), "customer-dim")
    return dim.withColumn("valid_from", F.col("valid_from").cast("string")).withColumn(
        "valid_to", F.col("valid_to").cast("string")
    )


LINE = ("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query(
    "etl_dedup_order_details",
    f"""
select l_orderkey, l_partkey, {', '.join(LINE)} from (
 select *, row_number() over (partition by l_orderkey, l_partkey order by {', '.join(LINE)}) as rn from {{lineitem}}) where rn = 1
""",
)
def dedup_order_details(t: Inputs) -> DataFrame:
    """First line per (order, product) in the order of all its fields; copies merge before the shuffle."""
    first = F.min(F.struct(*LINE)).alias("_line")
    return t("lineitem").groupBy("l_orderkey", "l_partkey").agg(first).select("l_orderkey", "l_partkey", "_line.*")
