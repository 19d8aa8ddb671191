"""Order, limits and pages (G) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from censora.operators import paging as P
from censora.queries import Tables, query

NULLABLE_SQL = "base AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS balance FROM customer)"


def nullable(t: Tables):
    balance = F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("balance")
    return t.customer.select("c_custkey", "c_mktsegment", balance)


@query(
    "g1_nulls_last_order",
    f"WITH {NULLABLE_SQL} SELECT c_custkey, balance, row_number() OVER (ORDER BY balance DESC NULLS LAST, c_custkey) AS position FROM base",
)
def _(t: Tables):
    return P.positioned(nullable(t), P.ordered("balance", True, ["c_custkey"])).select("c_custkey", "balance", "position")


@query(
    "g2_postgres_null_order",
    f"WITH {NULLABLE_SQL} SELECT c_custkey, balance, row_number() OVER (ORDER BY balance DESC NULLS FIRST, c_custkey) AS position FROM base",
)
def _(t: Tables):
    order = [P.postgres_order("balance", True), P.postgres_order("c_custkey", False)]
    return P.positioned(nullable(t), order).select("c_custkey", "balance", "position")


@query(
    "g3_truncation_flag",
    """SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS position, (SELECT count(DISTINCT o_custkey) FROM orders) > 100 AS truncated
       FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 100""",
)
def _(t: Tables):
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return P.truncated(counts, P.ordered("n", True, ["o_custkey"]), 100)


@query("g4_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t: Tables):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query(
    "g5_offset_page",
    """SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total, ceil((SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') / 10)::BIGINT AS pages
       FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name, c_custkey LIMIT 10 OFFSET 10""",
)
def _(t: Tables):
    kept = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return P.offset_page(kept, [F.col("c_name"), F.col("c_custkey")], 2, 10)


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "g6_cursor_page",
    """WITH k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4),
            a AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM k WHERE (l_orderkey, l_linenumber, l_partkey, l_suppkey) > (800, 3, 1000, 5)),
            p AS (SELECT * FROM a WHERE rn <= 1000)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n, rn AS position, (SELECT count(*) FROM a) > 1000 AS has_next,
              CASE WHEN (SELECT count(*) FROM a) > 1000 THEN (SELECT rtrim(replace(replace(to_base64(encode('[' || l_orderkey || ',' || l_linenumber || ',' || l_partkey || ',' || l_suppkey || ']')), '+', '-'), '/', '_'), '=') FROM p WHERE rn = 1000) END AS next_cursor FROM p""",
)
def _(t: Tables):
    unique = t.lineitem.groupBy(*LINE_KEY).agg(F.count(F.lit(1)).alias("n"))
    return P.cursor_page(unique, LINE_KEY, 1000, P.encode_cursor([800, 3, 1000, 5]))


@query(
    "g6_cursor_page_text_key",
    """WITH k AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN '"' ELSE '' END || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '\\"é' ELSE '' END AS label, c_custkey AS id FROM customer),
            a AS (SELECT *, row_number() OVER (ORDER BY label, id) AS position FROM k WHERE (label, id) > ('BUILDING\\"é', 4)), p AS (SELECT * FROM a WHERE position <= 100)
       SELECT label, id, position, (SELECT count(*) FROM a) > 100 AS has_next, CASE WHEN (SELECT count(*) FROM a) > 100 THEN (SELECT rtrim(replace(replace(to_base64(encode(
         '["' || replace(replace(label, '\\', '\\\\'), '"', '\\"') || '",' || id || ']')), '+', '-'), '/', '_'), '=') FROM p WHERE position = 100) END AS next_cursor FROM p""",
)
def _(t: Tables):
    key = F.col("c_custkey")
    label = F.concat(F.when(key % 3 == 0, '"').otherwise(""), "c_mktsegment", F.when(key % 2 == 0, '\\"é').otherwise(""))
    return P.cursor_page(t.customer.select(label.alias("label"), key.alias("id")), ["label", "id"], 100, P.encode_cursor(['BUILDING\\"é', 4]))


@query("g7_id_cursor", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 100")
def _(t: Tables):
    return P.id_page(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 700, 100)


@query(
    "g8_member_order",
    """SELECT p_size AS id, count(*) AS n, row_number() OVER (ORDER BY CASE WHEN p_size % 10 = 9 THEN 1 ELSE 0 END, p_size) AS position FROM part GROUP BY 1""",
)
def _(t: Tables):
    members = t.part.groupBy(F.col("p_size").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    ladder = F.when(F.col("id") % 10 == 9, 1).otherwise(0)
    return P.truncated(members, [ladder, F.col("id").cast("int")]).select("id", "n", "position")


@query("g9_exact_count", "SELECT count(*) AS total FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'N'")
def _(t: Tables):
    return t.lineitem.where("l_quantity between 10 and 20 and l_returnflag = 'N'").agg(F.count(F.lit(1)).alias("total"))
