"""Cubes over the driver's tables. ``tables`` gives each table as an attribute."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censora.plans.cube import Cube, Dimension, Link, Measure, Member, check_definition

CENTS = "sum(cast(round({} * 100) AS bigint))"
MEAN = "try_divide(sum(cast(round({0} * 100) AS bigint)), 100 * count({0}))"

REGION = Dimension("region", "r_regionkey", "r_name", "geographic", links=("region",), codes={"0": "00", "1": "01", "2": "02", "3": "03", "4": "04"})
NATION = Dimension("nation", "n_nationkey", "n_name", "geographic", parent="region", links=("nation", "region"))
CUSTOMER_LINKS = {
    "customer": Link(lambda t: t.customer, "o_custkey = c_custkey"),
    "nation": Link(lambda t: t.nation, "c_nationkey = n_nationkey", ("customer",)),
    "region": Link(lambda t: t.region, "n_regionkey = r_regionkey", ("nation",)),
}

SALES = Cube(
    key="sales",
    topic="trade",
    fact=lambda t: t.lineitem,
    links={
        "orders": Link(lambda t: t.orders, "l_orderkey = o_orderkey"),
        "customer": Link(lambda t: t.customer, "o_custkey = c_custkey", ("orders",)),
        "nation": Link(lambda t: t.nation, "c_nationkey = n_nationkey", ("customer",)),
        "region": Link(lambda t: t.region, "n_regionkey = r_regionkey", ("nation",)),
        "part": Link(lambda t: t.part, "l_partkey = p_partkey"),
    },
    measures=(
        Measure("revenue", CENTS.format("l_extendedprice"), "cents"),
        Measure("lines", "count(*)", "lines"),
        Measure("quantity", "sum(cast(l_quantity AS bigint))", "units"),
        Measure("customers", "count(DISTINCT o_custkey)", "customers", "rate"),
        Measure("avg_discount", MEAN.format("l_discount"), "share", "rate", 4),
    ),
    measure_links={"customers": ("orders",)},
    dimensions=(
        Dimension("year", "year(o_orderdate)", kind="temporal", links=("orders",)),
        REGION,
        NATION,
        Dimension("segment", "c_mktsegment", links=("customer",)),
        Dimension("priority", "o_orderpriority", links=("orders",)),
        Dimension("flag", "l_returnflag"),
        Dimension("status", "l_linestatus"),
        Dimension("brand", "p_brand", links=("part",)),
    ),
    time="year",
    cut="o_orderdate",
    default={"measures": ("revenue",), "columns": ("year",)},
)

ORDERS = Cube(
    key="orders",
    topic="trade",
    fact=lambda t: t.orders,
    links=CUSTOMER_LINKS,
    measures=(
        Measure("amount", CENTS.format("o_totalprice"), "cents"),
        Measure("orders", "count(*)", "orders"),
        Measure("avg_amount", MEAN.format("o_totalprice"), "money", "rate", 2),
        Measure("max_amount", "max(o_totalprice)", "money", "rate"),
    ),
    dimensions=(
        Dimension("month", "date_format(o_orderdate, 'yyyy-MM')", kind="temporal", parent="year"),
        Dimension("year", "year(o_orderdate)", kind="temporal"),
        REGION,
        NATION,
        Dimension("segment", "c_mktsegment", links=("customer",)),
        Dimension("priority", "o_orderpriority"),
        Dimension("status", "o_orderstatus"),
    ),
    cut="o_orderdate",
    default={"measures": ("orders",), "columns": ("year",)},
)

CUSTOMERS = Cube(
    key="customers",
    topic="people",
    fact=lambda t: t.customer,
    links={
        "nation": Link(lambda t: t.nation, "c_nationkey = n_nationkey"),
        "region": Link(lambda t: t.region, "n_regionkey = r_regionkey", ("nation",)),
    },
    measures=(
        Measure("customers", "count(*)", "customers"),
        Measure("balance", CENTS.format("c_acctbal"), "cents", "stock"),
        Measure("avg_balance", MEAN.format("c_acctbal"), "money", "rate", 2),
    ),
    dimensions=(
        REGION,
        Dimension("nation", "n_nationkey", "n_name", "geographic", parent="region", links=("nation", "region"),
                  catalogue=lambda t: t.nation.selectExpr("n_nationkey AS id", "n_name AS name")),
        Dimension("segment", "c_mktsegment"),
    ),
    default={"measures": ("customers",), "columns": ("segment",)},
)

SUPPLIERS = Cube(
    key="suppliers",
    topic="people",
    fact=lambda t: t.supplier,
    links={
        "nation": Link(lambda t: t.nation, "s_nationkey = n_nationkey"),
        "region": Link(lambda t: t.region, "n_regionkey = r_regionkey", ("nation",)),
    },
    measures=(Measure("suppliers", "count(*)", "suppliers"), Measure("avg_balance", MEAN.format("s_acctbal"), "money", "rate", 2)),
    dimensions=(REGION, NATION),
    default={"measures": ("suppliers",), "columns": ("nation",)},
)

PARTS = Cube(
    key="parts",
    topic="products",
    fact=lambda t: t.part,
    measures=(
        Measure("parts", "count(*)", "parts"),
        Measure("avg_price", MEAN.format("p_retailprice"), "money", "rate", 2),
        Measure("max_price", "max(p_retailprice)", "money", "rate"),
    ),
    dimensions=(
        Dimension("brand", "p_brand", order="cast(substring(id, 7) AS int)"),
        Dimension("type", "p_type", parent="brand"),
        Dimension("size", "CASE WHEN p_size < 10 THEN '01-09' WHEN p_size < 25 THEN '10-24' ELSE '25+' END"),
    ),
    default={"measures": ("parts",), "columns": ("brand",)},
)


def _wide_lines(t):
    """One row per line, its quantity in the column of its return flag; orders without lines keep one row."""
    quantity = F.col("l_quantity").cast("bigint")
    lines = t.lineitem.select("l_orderkey", *[F.when(F.col("l_returnflag") == f, quantity).alias(f"qty_{f.lower()}") for f in "ANR"])
    return t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")


# Wide table: the quantities by return flag are columns, unfolded on demand.
QUANTITIES = Cube(
    key="quantities",
    topic="trade",
    fact=_wide_lines,
    measures=(
        Measure("quantity", "sum(coalesce(qty_a, 0) + coalesce(qty_n, 0) + coalesce(qty_r, 0))", "units"),
        Measure("orders", "count(DISTINCT o_orderkey)", "orders", "rate"),
    ),
    dimensions=(
        Dimension("year", "year(o_orderdate)", kind="temporal"),
        Dimension("status", "o_orderstatus"),
        Dimension(
            "flag",
            "flag",
            virtual=tuple(Member(f, f"Flag {f}", {"quantity": f"sum(qty_{f.lower()})"}) for f in "ANR"),
        ),
    ),
    cut="o_orderdate",
    default={"measures": ("quantity",), "columns": ("year",)},
)


def _nested_levels(t):
    """Nation totals, region totals and the world as rows of one table: universes that contain one another."""
    nations = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("people"))
    nations = nations.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    regions = nations.groupBy(F.col("n_regionkey")).agg(F.sum("people").alias("people"))
    world = regions.agg(F.sum("people").alias("people"))
    return (
        nations.select(F.lit("nation").alias("level"), F.col("n_name").alias("place"), "people")
        .unionByName(regions.select(F.lit("region").alias("level"), F.col("n_regionkey").cast("string").alias("place"), "people"))
        .unionByName(world.select(F.lit("world").alias("level"), F.lit("all").alias("place"), "people"))
    )


CENSUS = Cube(
    key="census",
    topic="people",
    fact=_nested_levels,
    measures=(Measure("people", "sum(people)", "people"),),
    dimensions=(
        Dimension("level", "level", partition=("place",)),
        Dimension("place", "place", kind="geographic"),
    ),
    default={"measures": ("people",), "columns": ("level",)},
)

ACTIVITY = Cube(
    key="activity",
    topic="pulse",
    fact=lambda t: t.events,
    measures=(
        Measure("events", "count(*)", "events"),
        Measure("users", "count(DISTINCT user_id)", "users", "rate"),
        Measure("value", CENTS.format("value"), "cents"),
    ),
    dimensions=(
        Dimension("day", "to_date(ts)", kind="temporal"),
        Dimension("hour", "hour(ts)", kind="temporal"),
        Dimension("type", "event_type"),
        Dimension("user", "user_id"),
    ),
    required=("type",),
    cut="ts",
    default={"measures": ("events",), "columns": ("hour",), "filters": {"type": ("click",)}},
)


def _monthly_balance(t):
    """Running balance of each segment by month, a stock made from the orders' amounts."""
    flows = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    monthly = flows.groupBy("c_mktsegment", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.expr(CENTS.format("o_totalprice")).alias("flow")
    )
    # One row per segment and month: the running sum is as long as the calendar.
    along = W.partitionBy("c_mktsegment").orderBy("month")
    return monthly.withColumn("stock", F.sum("flow").over(along))


FUNDS = Cube(
    key="funds",
    topic="savings",
    fact=_monthly_balance,
    measures=(
        Measure("stock", "sum(stock)", "cents", "stock"),
        Measure("flow", "sum(flow)", "cents"),
        Measure("largest_flow", "max(flow)", "cents", "rate"),
    ),
    dimensions=(Dimension("month", "month", kind="temporal"), Dimension("segment", "c_mktsegment")),
    time="month",
    cut="month",
    default={"measures": ("stock",), "columns": ("month",)},
    notes=("Stocks are never added over months: without the month the last one counts.",),
)

DOCUMENTS = Cube(
    key="documents",
    topic="texts",
    fact=lambda t: t.documents,
    links={"labels": Link(lambda t: t.labels.withColumnRenamed("doc_id", "label_doc_id"), "doc_id = label_doc_id")},
    measures=(
        Measure("documents", "count(*)", "documents"),
        Measure("characters", "sum(n_chars)", "characters"),
        Measure("labelled", "count(quality)", "documents"),
        Measure("avg_quality", "try_divide(sum(quality), count(quality))", "share", "rate"),
    ),
    measure_links={"labelled": ("labels",), "avg_quality": ("labels",)},
    dimensions=(
        Dimension("lang", "lang"),
        Dimension("source", "source"),
        Dimension("size", "CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END"),
    ),
    default={"measures": ("documents",), "columns": ("lang",)},
)

TURNS = Cube(
    key="turns",
    topic="texts",
    fact=lambda t: t.conversations,
    measures=(
        Measure("turns", "count(*)", "turns"),
        Measure("conversations", "count(DISTINCT conv_id)", "conversations", "rate"),
        Measure("characters", "sum(cast(length(text) AS bigint))", "characters"),
    ),
    dimensions=(Dimension("role", "role"), Dimension("turn", "turn")),
    default={"measures": ("turns",), "columns": ("role",)},
)

CUBES = (SALES, ORDERS, CUSTOMERS, SUPPLIERS, PARTS, QUANTITIES, CENSUS, ACTIVITY, FUNDS, DOCUMENTS, TURNS)

for _cube in CUBES:
    check_definition(_cube)
