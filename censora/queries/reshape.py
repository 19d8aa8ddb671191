"""Set operations, reshaping and deduplication (H) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from censora.operators import aggregates as A
from censora.operators import reshape as R
from censora.functions.scalars import cents
from censora.queries import Tables, query
from censora.queries.aggregates import WIDE_SQL, wide_quantities


@query(
    "h1_union_of_labels",
    """SELECT 'low' AS label, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders WHERE o_totalprice < 100000
       UNION ALL SELECT 'mid', count(*), sum(round(o_totalprice * 100)::BIGINT)::BIGINT FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 300000
       UNION ALL SELECT 'high', count(*), sum(round(o_totalprice * 100)::BIGINT)::BIGINT FROM orders WHERE o_totalprice >= 300000""",
)
def _(t: Tables):
    # Disjoint labels are one grouping, not one scan per label.
    label = F.when(F.col("o_totalprice") < 100_000, "low").when(F.col("o_totalprice") < 300_000, "mid").otherwise("high")
    return t.orders.groupBy(label.alias("label")).agg(A.rows().alias("n"), A.money_sum("o_totalprice").alias("cents"))


@query(
    "h2_union_of_grains",
    """SELECT 'nation' AS grain, n_name AS place, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 2
       UNION ALL SELECT 'region', r_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 2""",
)
def _(t: Tables):
    by_key = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(A.rows().alias("n"))
    nations = by_key.join(t.nation, "n_nationkey")
    regions = nations.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sum("n").alias("n"))
    fine = nations.select(F.lit("nation").alias("grain"), F.col("n_name").alias("place"), "n")
    return fine.unionByName(regions.select(F.lit("region").alias("grain"), F.col("r_name").alias("place"), "n"))


@query("h3_distinct_members", "SELECT DISTINCT year(o_orderdate)::INTEGER AS year, o_orderpriority FROM orders")
def _(t: Tables):
    return t.orders.select(F.year("o_orderdate").alias("year"), "o_orderpriority").distinct()


@query(
    "h4_unfold_virtual",
    f"""WITH {WIDE_SQL} SELECT order_id, flag, quantity FROM (SELECT order_id, qty_a AS "A", qty_n AS "N", qty_r AS "R" FROM wide) UNPIVOT INCLUDE NULLS (quantity FOR flag IN ("A", "N", "R"))""",
)
def _(t: Tables):
    return R.unfold(wide_quantities(t), ["order_id"], {"A": "qty_a", "N": "qty_n", "R": "qty_r"}, "flag", "quantity")


@query(
    "h5_fold_members",
    f"WITH {WIDE_SQL} SELECT count(*) AS orders, (sum(qty_a) + sum(qty_r))::BIGINT AS quantity FROM wide",
)
def _(t: Tables):
    return wide_quantities(t).agg(A.rows().alias("orders"), (F.sum("qty_a") + F.sum("qty_r")).alias("quantity"))


@query(
    "h6_nested_series",
    """WITH d AS (SELECT o_orderpriority AS series, o_orderdate::DATE AS day, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1, 2)
       SELECT series, year(day)::INTEGER AS year, string_agg(strftime(day, '%Y-%m-%d') || '=' || cents, ';' ORDER BY day) AS points FROM d GROUP BY 1, 2""",
)
def _(t: Tables):
    days = t.orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(
        F.sum(cents("o_totalprice")).alias("cents")
    )
    nested = R.nested_series(days, ["series"], "day", "cents", F.year("day"))
    text = F.transform("points", lambda p: F.concat_ws("=", p["day"].cast("string"), p["cents"].cast("string")))
    return nested.select("series", F.col("chunk").alias("year"), F.array_join(text, ";").alias("points"))


CELLS_SQL = """m AS (SELECT o_orderstatus AS sheet, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS mo, left(o_orderpriority, 1)::INTEGER AS p, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4)"""


def cells(t: Tables):
    """Sheets as a publisher would lay them out: year only in January's row, month, then one column per priority."""
    counts = t.orders.groupBy(
        F.col("o_orderstatus").alias("sheet"),
        F.year("o_orderdate").alias("y"),
        F.month("o_orderdate").alias("mo"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("p"),
    ).agg(F.count(F.lit(1)).alias("n"))
    row = (F.col("y") - 1990) * 12 + F.col("mo")
    values = counts.select("sheet", row.alias("row"), (F.col("p") + 1).alias("col"), F.col("n").cast("string").alias("value"))
    lines = counts.select("sheet", "y", "mo", row.alias("row")).distinct()
    years = lines.select("sheet", "row", F.lit(0).alias("col"), F.when(F.col("mo") == 1, F.col("y").cast("string")).alias("value"))
    months = lines.select("sheet", "row", F.lit(1).alias("col"), F.col("mo").cast("string").alias("value"))
    titles = lines.select("sheet").distinct().select("sheet", F.lit(0).alias("row"), F.explode(F.sequence(F.lit(2), F.lit(6))).alias("col"))
    titles = titles.withColumn("value", F.concat(F.lit("priority "), (F.col("col") - 1).cast("string")))
    return values.unionByName(years).unionByName(months).unionByName(titles)


@query(
    "h7_sheet_to_long",
    f"""WITH {CELLS_SQL}, l AS (SELECT sheet, y, mo, max(CASE WHEN mo = 1 THEN y END) OVER (PARTITION BY sheet ORDER BY y, mo ROWS UNBOUNDED PRECEDING) AS d1 FROM (SELECT DISTINCT sheet, y, mo FROM m))
        SELECT m.sheet, (m.y - 1990) * 12 + m.mo AS row, d1::VARCHAR AS d1, m.mo::VARCHAR AS d2, 'priority ' || p AS "column", n::VARCHAR AS text, n::DOUBLE AS value, p + 1 AS place
        FROM m JOIN l ON l.sheet = m.sheet AND l.y = m.y AND l.mo = m.mo""",
)
def _(t: Tables):
    return R.sheet_to_long(cells(t), 0, [0, 1])


@query(
    "h7_numbers_lost",
    f"WITH {CELLS_SQL} SELECT sheet, count(*) AS read, count(*) AS kept, 0::BIGINT AS lost FROM m GROUP BY 1",
)
def _(t: Tables):
    sheet = cells(t)
    return R.numbers_lost(sheet, R.sheet_to_long(sheet, 0, [0, 1]), 0, [0, 1])


@query(
    "h8_dedup_keep_first",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    first, _repeats = R.keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    return first


@query(
    "h8_repeats_log",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn > 1""",
)
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    _first, repeats = R.keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    return repeats


@query(
    "h9_dedup_across_files",
    """WITH f AS (SELECT 1 AS file, year(o_orderdate)::INTEGER AS edition, o_custkey AS id, o_orderkey FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 2, year(o_orderdate)::INTEGER, o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F')
       SELECT edition, id, file, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY edition, id ORDER BY file, o_orderkey) AS rn FROM f) WHERE rn = 1""",
)
def _(t: Tables):
    def file(number, kept):
        return kept.select(
            F.lit(number).alias("file"), F.year("o_orderdate").alias("edition"), F.col("o_custkey").alias("id"), "o_orderkey"
        )

    both = file(1, t.orders.where("o_orderstatus <> 'P'")).unionByName(file(2, t.orders.where("o_orderstatus <> 'F'")))
    first, _repeats = R.keep_first(both, ["edition", "id"], ["file", "o_orderkey"])
    return first


@query(
    "h10_latest_version",
    """WITH e AS (SELECT o_custkey AS object, o_orderdate AS stamp, o_orderkey AS entry, o_orderstatus AS sha FROM orders),
            x AS (SELECT object, max(stamp) AS stamp, count(*) AS versions FROM e GROUP BY 1)
       SELECT object, stamp, max(entry) AS entry, arg_max(sha, entry) AS sha, any_value(versions) AS versions, count(DISTINCT sha) > 1 AS clash FROM e JOIN x USING (object, stamp) GROUP BY 1, 2""",
)
def _(t: Tables):
    manifest = t.orders.select(
        F.col("o_custkey").alias("object"),
        F.col("o_orderdate").alias("stamp"),
        F.col("o_orderkey").alias("entry"),
        F.col("o_orderstatus").alias("sha"),
    )
    return R.latest_version(manifest, ["object"], "stamp", ["sha"])


CANDIDATES = (
    ["l_orderkey", "l_linenumber"],
    ["l_orderkey", "l_linenumber", "l_partkey"],
    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"],
)


def _key_sql(place: int, columns: list[str]) -> str:
    names = ", ".join(columns)
    return f"""SELECT {place} AS place, '{",".join(columns)}' AS key, sum(c)::BIGINT AS rows, count(*) AS groups, max(c) AS largest FROM (SELECT count(*) AS c FROM lineitem GROUP BY {names})"""


@query(
    "h11_choose_key",
    f"""WITH k AS ({" UNION ALL ".join(_key_sql(i, c) for i, c in enumerate(CANDIDATES, 1))})
        SELECT *, rows = groups AS is_unique, coalesce(place = (SELECT min(place) FROM k WHERE rows = groups), false) AS chosen FROM k""",
)
def _(t: Tables):
    return R.choose_key(t.lineitem, CANDIDATES)


@query(
    "h12_project_to_schema",
    """SELECT lpad(c_custkey::VARCHAR, 9, '0') AS id, lpad(c_nationkey::VARCHAR, 2, '0') AS ent, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS stage,
              '{"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS extras_json FROM customer""",
)
def _(t: Tables):
    return R.project_to_schema(
        t.customer,
        {"id": "string", "ent": "string", "balance": "double", "stage": "string"},
        {"id": ["c_custkey"], "ent": ["cve_ent", "c_nationkey"], "balance": ["c_acctbal"]},
        {"id": 9, "ent": 2},
    )


@query(
    "h13_width_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min(length({c}))::INTEGER AS shortest, max(length({c}))::INTEGER AS longest, coalesce(bool_or(starts_with({c}, '0')), false) AS leading_zero FROM part"
        for c in ("p_name", "p_brand", "p_type")
    ),
)
def _(t: Tables):
    return R.width_profile(t.part, ["p_name", "p_brand", "p_type"])
