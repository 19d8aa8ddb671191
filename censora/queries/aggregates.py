"""Aggregations (E) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from censora.functions.scalars import bucketize, cents
from censora.operators import aggregates as A
from censora.operators import ordering as O
from censora.queries import Tables, query
from censora.queries.scalars import SALARY_EDGES, SALARY_LABELS


@query(
    "e1_group_agg",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(sum(l_quantity) AS BIGINT) / count(*) AS avg_quantity,
              min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2""",
)
def _(t: Tables):
    quantity = F.sum("l_quantity").cast("bigint")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        A.rows().alias("n"),
        quantity.alias("quantity"),
        (quantity / A.rows()).alias("avg_quantity"),
        F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"),
    )


@query(
    "e2_count_distinct",
    "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1",
)
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts")
    )


@query(
    "e3_conditional_pivot",
    """SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 100) END) AS BIGINT) AS f_cents,
              CAST(sum(CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice * 100) END) AS BIGINT) AS o_cents, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p_max
       FROM orders GROUP BY 1""",
)
def _(t: Tables):
    status = F.col("o_orderstatus")
    return t.orders.groupBy("o_orderpriority").agg(
        A.money_sum("o_totalprice", status == "F").alias("f_cents"),
        A.money_sum("o_totalprice", status == "O").alias("o_cents"),
        F.max(F.when(status == "P", F.col("o_totalprice"))).alias("p_max"),
    )


def _weight():
    return F.col("l_quantity").cast("bigint")


@query(
    "e4_weighted_total",
    """SELECT l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS expanded, CAST(sum(round(l_extendedprice * 100) * l_quantity) AS BIGINT) AS weighted_cents FROM lineitem GROUP BY 1""",
)
def _(t: Tables):
    return t.lineitem.groupBy("l_linestatus").agg(
        A.weighted_total(_weight()).alias("expanded"),
        A.weighted_total(cents("l_extendedprice") * _weight()).alias("weighted_cents"),
    )


@query(
    "e5_weighted_mean",
    """SELECT l_linestatus, sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT))::BIGINT / sum(CAST(l_quantity AS BIGINT))::BIGINT AS mean_cents,
              sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT))::BIGINT / sum(CAST(l_quantity AS BIGINT))::BIGINT / 3 AS monthly_cents
       FROM lineitem GROUP BY 1""",
)
def _(t: Tables):
    mean = A.weighted_mean(cents("l_extendedprice"), _weight())
    return t.lineitem.groupBy("l_linestatus").agg(mean.alias("mean_cents"), (mean / 3).alias("monthly_cents"))


@query(
    "e6_domain_mean",
    """SELECT l_returnflag, sum(CASE WHEN l_tax > 0 THEN round(l_tax * 100)::BIGINT * l_quantity::BIGINT END)::BIGINT / sum(CASE WHEN l_tax > 0 THEN l_quantity::BIGINT END)::BIGINT AS mean_tax_pct,
              100 * sum(CASE WHEN l_tax > 0 THEN l_quantity::BIGINT ELSE 0 END)::BIGINT / sum(l_quantity::BIGINT)::BIGINT AS share_taxed FROM lineitem GROUP BY 1""",
)
def _(t: Tables):
    taxed = F.col("l_tax") > 0
    return t.lineitem.groupBy("l_returnflag").agg(
        A.weighted_mean(cents("l_tax"), _weight(), taxed).alias("mean_tax_pct"),
        A.weighted_share(taxed, _weight()).alias("share_taxed"),
    )


@query(
    "e7_share_of_total",
    """SELECT l_returnflag, sum(l_quantity)::BIGINT AS expanded, 100 * sum(l_quantity)::BIGINT / (SELECT sum(l_quantity)::BIGINT FROM lineitem) AS share FROM lineitem GROUP BY 1""",
)
def _(t: Tables):
    totals = t.lineitem.groupBy("l_returnflag").agg(A.weighted_total(_weight()).alias("expanded"))
    return A.share_of_total(totals, "expanded", "share")


def percentile_sql(source: str, group: str, value: str, points: dict[str, float]) -> str:
    """Explicit percentile_cont: position (n−1)·p over sorted values, linear between neighbours."""
    keys = f"{group}, " if group else ""
    over = f"PARTITION BY {group} " if group else ""
    cells = ", ".join(
        f"max(v) FILTER (rn = floor((n - 1) * {p}::DOUBLE)) + (max(v) FILTER (rn = ceil((n - 1) * {p}::DOUBLE)) - max(v) FILTER (rn = floor((n - 1) * {p}::DOUBLE)))"
        f" * ((any_value(n) - 1) * {p}::DOUBLE - floor((any_value(n) - 1) * {p}::DOUBLE)) AS {k}"
        for k, p in points.items()
    )
    tail = f"GROUP BY {group}" if group else ""
    return f"""WITH s AS (SELECT {keys}{value} AS v, row_number() OVER ({over}ORDER BY {value}) - 1 AS rn, count(*) OVER ({over}) AS n FROM {source} WHERE {value} IS NOT NULL)
        SELECT {keys}any_value(n) AS n, {cells} FROM s {tail}"""


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


@query("e8_percentile_cont", percentile_sql("customer", "c_mktsegment", "c_acctbal", QUARTILES))
def _(t: Tables):
    return O.percentiles(t.customer, ["c_mktsegment"], "c_acctbal", QUARTILES)


@query("e8_percentile_cont_lines", percentile_sql("lineitem", "l_returnflag", "l_extendedprice", QUARTILES))
def _(t: Tables):
    return O.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", QUARTILES)


@query("e8_percentile_cont_global", percentile_sql("orders", "", "o_totalprice", QUARTILES))
def _(t: Tables):
    return O.percentiles(t.orders, [], "o_totalprice", QUARTILES)


@query(
    "e9_floor_rank_quantile",
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
       SELECT event_type, any_value(n) AS n, max(value) FILTER (rn = floor((n - 1) * 0.5::DOUBLE)) AS p50, max(value) FILTER (rn = floor((n - 1) * 0.9::DOUBLE)) AS p90 FROM s GROUP BY 1""",
)
def _(t: Tables):
    return O.floor_rank_quantiles(t.events, ["event_type"], "value", {"p50": 0.5, "p90": 0.9})


@query(
    "e10_medians",
    """WITH s AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
       SELECT o_orderpriority, any_value(n) AS n, (max(v) FILTER (rn = (n - 1) // 2) + max(v) FILTER (rn = n // 2)) / 2 AS median, max(v) FILTER (rn = n // 2) AS upper_median FROM s GROUP BY 1""",
)
def _(t: Tables):
    return O.medians(t.orders, ["o_orderpriority"], "o_totalprice")


@query(
    "e11_money_mean",
    "SELECT c_nationkey, sum(round(c_acctbal * 100)::BIGINT)::BIGINT / (100 * count(c_acctbal)) AS mean_balance FROM customer GROUP BY 1",
)
def _(t: Tables):
    return t.customer.groupBy("c_nationkey").agg(A.money_mean("c_acctbal").alias("mean_balance"))


@query("e12_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(A.rows().alias("n")).where("n >= 5")


@query(
    "e13_distribution",
    """SELECT CASE WHEN o_totalprice < 5000 THEN '0-5K' WHEN o_totalprice < 10000 THEN '5K-10K' WHEN o_totalprice < 20000 THEN '10K-20K' WHEN o_totalprice < 30000 THEN '20K-30K'
                   WHEN o_totalprice < 50000 THEN '30K-50K' WHEN o_totalprice < 80000 THEN '50K-80K' WHEN o_totalprice < 120000 THEN '80K-120K' ELSE '120K+' END AS bucket,
              count(*) AS n, min(o_totalprice) AS from_value FROM orders GROUP BY 1 ORDER BY 3""",
)
def _(t: Tables):
    return A.distribution(t.orders, "o_totalprice", SALARY_EDGES, SALARY_LABELS)


AGE_SQL = "CASE WHEN p_size < 18 THEN '<18' WHEN p_size < 26 THEN '18-25' WHEN p_size < 36 THEN '26-35' ELSE '36+' END"
AGE_EDGES, AGE_LABELS = (18, 26, 36), ("<18", "18-25", "26-35", "36+")


@query(
    "e14_gender_gap",
    f"""WITH g AS (SELECT {AGE_SQL} AS bucket, sum(round(p_retailprice * 100)::BIGINT) FILTER (p_partkey % 2 = 0)::BIGINT / (100 * count(*) FILTER (p_partkey % 2 = 0)) AS avg_m,
              sum(round(p_retailprice * 100)::BIGINT) FILTER (p_partkey % 2 = 1)::BIGINT / (100 * count(*) FILTER (p_partkey % 2 = 1)) AS avg_f,
              count(*) FILTER (p_partkey % 2 = 0) AS count_m, count(*) FILTER (p_partkey % 2 = 1) AS count_f FROM part GROUP BY 1)
        SELECT *, CASE WHEN avg_f > 0 THEN (avg_m - avg_f) / avg_f * 100 END AS gap_pct FROM g""",
)
def _(t: Tables):
    bucket = bucketize("p_size", AGE_EDGES, AGE_LABELS).alias("bucket")
    sex = F.col("p_partkey") % 2
    return A.gap_report(t.part, [bucket], "p_retailprice", sex == 0, sex == 1)


@query(
    "e15_distinct_then_expand",
    """WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
       SELECT o_orderpriority, count(*) AS households, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM a JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def _(t: Tables):
    active = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return active.join(t.orders, "o_orderkey").groupBy("o_orderpriority").agg(
        A.rows().alias("households"), A.money_sum("o_totalprice").alias("cents")
    )


@query(
    "e16_two_level",
    "SELECT n AS orders_per_customer, count(*) AS customers, sum(n)::BIGINT AS orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1",
)
def _(t: Tables):
    per_customer = t.orders.groupBy("o_custkey").agg(A.rows().alias("orders_per_customer"))
    return per_customer.groupBy("orders_per_customer").agg(
        A.rows().alias("customers"), F.sum("orders_per_customer").alias("orders")
    )


def wide_quantities(t: Tables):
    """One row per order with its quantity by return flag, the wide table of the cohort and virtual-dimension operators."""
    flags = {f"qty_{flag.lower()}": F.when(F.col("l_returnflag") == flag, F.col("l_quantity").cast("bigint")) for flag in "ANR"}
    return t.lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(*[F.sum(c).alias(k) for k, c in flags.items()])


WIDE_SQL = """wide AS (SELECT l_orderkey AS order_id, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity::BIGINT END)::BIGINT AS qty_a,
     sum(CASE WHEN l_returnflag = 'N' THEN l_quantity::BIGINT END)::BIGINT AS qty_n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT END)::BIGINT AS qty_r FROM lineitem GROUP BY 1)"""


@query(
    "e17_cohort_sums",
    f"""WITH {WIDE_SQL}, j AS (SELECT o_orderstatus, count(order_id) AS with_data, sum(qty_a)::BIGINT AS qty_a, sum(qty_n)::BIGINT AS qty_n, sum(qty_r)::BIGINT AS qty_r
             FROM orders LEFT JOIN wide ON order_id = o_orderkey GROUP BY 1)
        SELECT o_orderstatus, with_data, cohort, total FROM j UNPIVOT INCLUDE NULLS (total FOR cohort IN (qty_a, qty_n, qty_r))""",
)
def _(t: Tables):
    joined = t.orders.join(wide_quantities(t).withColumnRenamed("order_id", "o_orderkey"), "o_orderkey", "left")
    return A.cohort_sums(joined, ["qty_a", "qty_n", "qty_r"], ["o_orderstatus"])


@query(
    "e18_catalogue_summary",
    "SELECT count(*) AS rows, count(DISTINCT o_custkey) AS series, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders",
)
def _(t: Tables):
    return t.orders.agg(
        A.rows().alias("rows"),
        F.count_distinct("o_custkey").alias("series"),
        F.min("o_orderdate").alias("first"),
        F.max("o_orderdate").alias("last"),
    )


MONTHLY_SQL = """fine AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1, 2, 3)"""


def monthly_rollup(t: Tables):
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    return A.preaggregate(t.orders, ["o_custkey", month, "o_orderstatus"], {"cents": cents("o_totalprice")})


@query(
    "e19_preaggregate",
    f"""WITH {MONTHLY_SQL} SELECT o_custkey, month, o_orderstatus, n, cents, (SELECT sum(n)::BIGINT FROM fine) = (SELECT count(*) FROM orders) AS complete FROM fine""",
)
def _(t: Tables):
    fine = monthly_rollup(t)
    proof = fine.agg(F.sum("n").alias("n")).scalar() == t.orders.agg(A.rows().alias("n")).scalar()
    return fine.withColumn("complete", proof)


@query(
    "e20_coarser_rollup",
    f"""WITH {MONTHLY_SQL}, l AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY month DESC, o_orderstatus DESC) AS rn FROM fine)
        SELECT f.o_custkey, sum(n)::BIGINT AS n, sum(cents)::BIGINT AS cents, any_value(l.o_orderstatus) AS last_status FROM fine f JOIN l ON l.o_custkey = f.o_custkey AND l.rn = 1 GROUP BY 1""",
)
def _(t: Tables):
    return A.coarsen(monthly_rollup(t), ["o_custkey"], ["n", "cents"], {"last_status": "o_orderstatus"}, "month")


@query(
    "e21_error_stats",
    """WITH e AS (SELECT event_type, CAST(hour(ts - INTERVAL 6 HOUR) AS INTEGER) AS local_hour, ((value - json_extract_string(props, '$.k')::INTEGER) / 1000)::DECIMAL(18, 6) AS e FROM events)
       SELECT event_type, local_hour, count(*) AS n, sum(abs(e))::DOUBLE / count(*) AS mae, sum(e)::DOUBLE / count(*) AS bias FROM e GROUP BY 1, 2""",
)
def _(t: Tables):
    # Thousandths: errors far below a hundredth count in full.
    error = (F.col("value") - F.get_json_object("props", "$.k").cast("int")) / 1000
    local_hour = F.hour(F.col("ts") - F.expr("INTERVAL 6 HOURS")).alias("local_hour")
    return A.error_stats(t.events, ["event_type", local_hour], error)


@query(
    "e23_snapshot_stats",
    """WITH s AS (SELECT c_nationkey, max(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) AS fee FROM customer WHERE c_custkey % 9 <> 0 GROUP BY 1),
            n AS (SELECT n_nationkey, CASE WHEN n_nationkey % 6 <> 0 THEN fee END AS fee FROM nation LEFT JOIN s ON c_nationkey = n_nationkey)
       SELECT count(*) AS members, count(fee) AS reporting, count(*) FILTER (fee IS NULL) AS silent, min(fee) AS low, max(fee) AS high, sum(round(fee * 100)::BIGINT)::BIGINT / (100 * count(fee)) AS mean FROM n""",
)
def _(t: Tables):
    building = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))
    fees = t.customer.where("c_custkey % 9 <> 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max(building).alias("fee"))
    snapshot = t.nation.join(fees, "n_nationkey", "left").withColumn("fee", F.when(F.col("n_nationkey") % 6 != 0, F.col("fee")))
    return snapshot.agg(
        A.rows().alias("members"),
        F.count("fee").alias("reporting"),
        A.count_where(F.col("fee").isNull()).alias("silent"),
        F.min("fee").alias("low"),
        F.max("fee").alias("high"),
        A.money_mean("fee").alias("mean"),
    )


@query(
    "e24_identity_check",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total,
                     sum(CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 40 <> 0 THEN round(o_totalprice * 100)::BIGINT END)::BIGINT AS parts FROM orders GROUP BY 1)
       SELECT month, total, parts, total - parts AS delta, CASE WHEN total > 0 THEN 100 * (total - parts) / total ELSE 0 END AS delta_pct, abs(total - parts) <= 0.05 AS closes FROM m""",
)
def _(t: Tables):
    kept = (F.col("o_orderstatus") != "P") | (F.col("o_orderkey") % 40 != 0)
    months = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        A.money_sum("o_totalprice").alias("total"), A.money_sum("o_totalprice", kept).alias("parts")
    )
    return months.withColumns(A.closing(F.col("parts"), F.col("total")))


@query(
    "e25_side_by_side",
    """WITH s AS (SELECT c_mktsegment, count(*)::DOUBLE AS customers, min(c_acctbal) AS low, max(c_acctbal) AS high, sum(round(c_acctbal * 100)::BIGINT)::BIGINT / (100 * count(*)) AS mean
                  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1),
            l AS (SELECT * FROM s UNPIVOT INCLUDE NULLS (value FOR measure IN (customers, low, high, mean)))
       SELECT measure, max(value) FILTER (c_mktsegment = 'BUILDING') AS first, max(value) FILTER (c_mktsegment = 'MACHINERY') AS second FROM l GROUP BY 1""",
)
def _(t: Tables):
    measures = {
        "customers": A.rows(),
        "low": F.min("c_acctbal"),
        "high": F.max("c_acctbal"),
        "mean": A.money_mean("c_acctbal"),
    }
    return A.side_by_side(t.customer, "c_mktsegment", ("BUILDING", "MACHINERY"), measures)


@query(
    "e26_series_coverage",
    """WITH s AS (SELECT o_custkey, min(strftime(o_orderdate, '%Y-%m')) AS first, max(strftime(o_orderdate, '%Y-%m')) AS last, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS points FROM orders GROUP BY 1)
       SELECT *, CAST((left(last, 4)::BIGINT - left(first, 4)::BIGINT) * 12 + right(last, 2)::BIGINT - right(first, 2)::BIGINT + 1 - points AS BIGINT) AS gaps FROM s""",
)
def _(t: Tables):
    months = t.orders.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))

    def number(month):
        return F.substring(month, 1, 4).cast("bigint") * 12 + F.substring(month, 6, 2).cast("bigint")

    return A.coverage(months, ["o_custkey"], "month", number(F.col("last")) - number(F.col("first")) + 1)
