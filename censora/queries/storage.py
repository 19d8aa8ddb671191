"""Sources, scans and sinks (A): the driver's tables go through files in the shared folder and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from censora.functions.scalars import zero_pad
from censora.queries import Tables, query
from censora.queries.aggregates import MONTHLY_SQL, monthly_rollup
from censora.session import shared_dir
from censora.sources import readers as R
from censora.sources import tables as S
from censora.sources import typing as Y

MICRO_SQL = """micro AS (SELECT o_orderkey AS con, o_custkey AS person, o_totalprice AS income, year(o_orderdate)::VARCHAR AS periodo, lpad((o_custkey % 8 + 1)::VARCHAR, 2, '0') AS ent FROM orders)"""


def microdata(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("con"),
        F.col("o_custkey").alias("person"),
        F.col("o_totalprice").alias("income"),
        F.year("o_orderdate").cast("string").alias("periodo"),
        zero_pad(F.col("o_custkey") % 8 + 1, 2).alias("ent"),
    )


@query("a1_scan_partition", f"WITH {MICRO_SQL} SELECT * FROM micro WHERE periodo = '1997' AND ent = '08' AND con >= 100")
def _(t: Tables):
    rows, path = microdata(t), shared_dir(t.spark, "microdata")
    S.write_partitioned(rows, path, ["periodo", "ent"], ["con"])
    return R.scan_partitions(t.spark, path, rows.schema, periodo="1997", ent="08").where("con >= 100")


@query(
    "a3_read_csv_text",
    """SELECT c_custkey::VARCHAR AS c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN ', Ñandú "é"' WHEN c_custkey % 3 = 1 THEN chr(10) || ' "ü", ' || chr(10) ELSE ' ü' END || '.' AS c_name, lpad(c_nationkey::VARCHAR, 2, '0') AS c_nationkey FROM customer""",
)
def _(t: Tables):
    path = shared_dir(t.spark, "csv")
    # A third of the files holds cells with quoted line breaks.
    key = F.col("c_custkey")
    suffix = F.when(key % 2 == 0, ', Ñandú "é"').when(key % 3 == 1, '\n "ü", \n').otherwise(" ü")
    rows = t.customer.select(
        F.col("c_custkey").cast("string").alias("c_custkey"),
        F.concat("c_name", suffix, F.lit(".")).alias("c_name"),
        zero_pad("c_nationkey", 2).alias("c_nationkey"),
        (F.col("c_custkey") % 3).alias("third"),
    )
    for name, encoding, kept in (("utf8", "UTF-8", "third = 0"), ("broken", "UTF-8", "third = 1"), ("latin", "ISO-8859-1", "third = 2")):
        writer = rows.where(kept).drop("third").write.option("header", True).option("escape", '"')
        writer.option("encoding", encoding).csv(f"{path}/{name}")
    return R.read_csv_text(t.spark, [f"{path}/{name}/*.csv" for name in ("utf8", "broken", "latin")])


@query(
    "a4_read_json_lines",
    "SELECT 'orders/' || o_orderkey AS object, o_custkey AS rows, o_orderstatus AS sha FROM orders",
)
def _(t: Tables):
    path = shared_dir(t.spark, "manifest")
    rows = t.orders.select(
        F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("object"),
        F.col("o_custkey").alias("rows"),
        F.col("o_orderstatus").alias("sha"),
    )
    rows.write.json(path)
    return R.read_json_lines(t.spark, path, "object string, rows long, sha string")


def as_text(t: Tables):
    """Orders as a file would carry them: everything text, blanks for missing, a code with leading zeros, a marked column."""
    key = F.col("o_orderkey")
    return t.orders.select(
        key.cast("string").alias("id"),
        zero_pad(F.col("o_custkey") % 32 + 1, 2).alias("ent"),
        F.when(key % 9 == 0, " ").otherwise((F.col("o_custkey") - 500).cast("string")).alias("balance"),
        F.col("o_totalprice").cast("string").alias("amount"),
        F.when(key % 100 == 0, "*").otherwise(F.col("o_custkey").cast("string")).alias("marked"),
        F.lit("").alias("blank"),
    )


@query(
    "a5_strict_types",
    """SELECT o_orderkey AS id, lpad((o_custkey % 32 + 1)::VARCHAR, 2, '0') AS ent, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey - 500 END AS balance, o_totalprice AS amount, CASE WHEN o_orderkey % 100 = 0 THEN '*' ELSE o_custkey::VARCHAR END AS marked, NULL::VARCHAR AS blank FROM orders""",
)
def _(t: Tables):
    return Y.strict_types(as_text(t))


@query(
    "a5_decide_types",
    """SELECT * FROM (VALUES ('id', 'bigint'), ('ent', 'string'), ('balance', 'bigint'), ('amount', 'double'), ('marked', 'string'), ('blank', 'string')) v("column", type)""",
)
def _(t: Tables):
    return Y.decide_types(as_text(t))


@query("a6_write_partitioned", f"WITH {MICRO_SQL} SELECT periodo, ent, count(*) AS rows FROM micro GROUP BY 1, 2")
def _(t: Tables):
    return S.write_partitioned(microdata(t), shared_dir(t.spark, "microdata"), ["periodo", "ent"], ["con"])


@query(
    "a7_export_formats",
    """SELECT f.format, p_partkey AS id, p_name AS name, p_retailprice AS price FROM part, (SELECT unnest(['csv', 'json', 'parquet']) AS format) f""",
)
def _(t: Tables):
    path = shared_dir(t.spark, "export")
    rows = t.part.select("p_partkey", "p_name", "p_retailprice")
    titles = {"p_partkey": "id", "p_name": "name", "p_retailprice": "price"}
    for form in ("csv", "json", "parquet"):
        S.export(rows, f"{path}/{form}", form, titles)
    schema = "id long, name string, price double"
    back = {
        "csv": t.spark.read.schema(schema).option("header", True).csv(f"{path}/csv"),
        "json": t.spark.read.schema(schema).json(f"{path}/json"),
        "parquet": t.spark.read.schema(schema).parquet(f"{path}/parquet"),
    }
    frames = [df.withColumn("format", F.lit(form)) for form, df in back.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "a9_union_headers",
    """SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS status, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority ELSE '' END AS priority FROM orders""",
)
def _(t: Tables):
    path, key = shared_dir(t.spark, "editions"), F.col("o_orderkey")
    first = t.orders.where(key % 2 == 0).select(key.alias("ID"), F.col("o_orderstatus").alias("Status"))
    second = t.orders.where(key % 2 == 1).select(F.col("o_orderpriority").alias("PRIORITY"), key.alias("id"))
    first.write.option("header", True).csv(f"{path}/a")
    second.write.option("header", True).csv(f"{path}/b")
    return R.read_csv_text(t.spark, [f"{path}/a/*.csv", f"{path}/b/*.csv"])


@query(
    "a10_upsert",
    """SELECT o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, max(o_orderdate) AS stamp FROM orders GROUP BY 1""",
)
def _(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("last_order"), F.col("o_orderdate").alias("stamp"))
    old, new = rows.where("last_order % 2 = 0"), rows.where("last_order % 2 = 1")
    return S.upsert(old, new, ["id"], ["stamp", "last_order"])


@query(
    "a11_insert_ignore",
    """WITH o AS (SELECT o_custkey AS id, min(o_orderkey) AS first_order FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), n AS (SELECT o_custkey AS id, min(o_orderkey) AS first_order FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
       SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)""",
)
def _(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first_order"), "o_orderstatus")
    stored = rows.where("o_orderstatus = 'P'").groupBy("id").agg(F.min("first_order").alias("first_order"))
    arrived = rows.where("o_orderstatus <> 'P'").drop("o_orderstatus")
    return S.insert_ignore(stored, arrived, ["id"], ["first_order"])


@query(
    "a12_reload_slice",
    "SELECT edition, count(*) AS rows, max(o_orderkey) AS last, CASE edition WHEN 1996 THEN 'complete' WHEN 1997 THEN 'loaded' END AS outcome FROM (SELECT *, year(o_orderdate)::INTEGER AS edition FROM orders) WHERE edition IN (1996, 1997) GROUP BY 1",
)
def _(t: Tables):
    path = shared_dir(t.spark, "slices")
    rows = t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("edition"))
    # The store holds 1996 whole and 1997 in part.
    partial = rows.where("edition = 1996 or (edition = 1997 and o_orderkey % 2 = 0)")
    partial.write.partitionBy("edition").parquet(path)
    outcomes = {year: S.reload_slice(rows, path, "edition", year) for year in (1996, 1997)}
    stored = t.spark.read.schema(rows.schema).parquet(path)
    told = F.when(F.col("edition") == 1996, outcomes[1996]).otherwise(outcomes[1997])
    counts = stored.groupBy("edition").agg(F.count(F.lit(1)).alias("rows"), F.max("o_orderkey").alias("last"))
    return counts.withColumn("outcome", told)


@query("a13_retention", "SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY GROUP BY 1")
def _(t: Tables):
    kept = S.retain(t.events, "ts", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 10)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))


@query("a14_summary_table", f"WITH {MONTHLY_SQL} SELECT * FROM fine")
def _(t: Tables):
    return S.materialise_summary(monthly_rollup(t), shared_dir(t.spark, "summary"))


def _inventory_sql(table: str, columns: dict[str, str], cut: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", count(*) AS rows, {cut}::VARCHAR AS cut, '{c}' AS "column", '{kind}' AS type, count(*) FILTER ({c} IS NULL) AS nulls FROM {table}"""
        for c, kind in columns.items()
    )


@query(
    "a15_table_inventory",
    " UNION ALL ".join(
        [
            _inventory_sql("nation", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, "NULL"),
            _inventory_sql("labels", {"doc_id": "bigint", "quality": "int", "toxic": "int"}, "NULL"),
            _inventory_sql(
                "events",
                {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
                "max(ts)",
            ),
        ]
    ),
)
def _(t: Tables):
    return S.inventory({"nation": t.nation, "labels": t.labels, "events": t.events}, {"events": "ts"})
