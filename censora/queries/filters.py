"""Filters, predicates and search (C) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from censora.functions import geo, text
from censora.functions import scalars as S
from censora.operators import filters as P
from censora.queries import Tables, query


def _count(df, *by, name="n"):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


@query("c1_in_filter", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def _(t: Tables):
    return _count(t.lineitem.where(P.in_filter("l_returnflag", ["A", "R"])), "l_returnflag")


@query(
    "c2_optional_filters",
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 GROUP BY 1",
)
def _(t: Tables):
    wanted = {"o_orderstatus": "F", "o_orderpriority": None, "o_custkey": None}
    return _count(t.orders.where(P.optional_equals(wanted) & P.between("o_totalprice", 1000)), "o_orderpriority")


@query(
    "c3_range_filter",
    """SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1999-06-30' GROUP BY 1""",
)
def _(t: Tables):
    kept = t.orders.where(
        F.col("o_orderdate").between(F.lit("1996-02-01").cast("timestamp_ntz"), F.lit("1999-06-30").cast("timestamp_ntz"))
    )
    return _count(kept, F.date_format("o_orderdate", "yyyy-MM").alias("period"))


@query(
    "c4_prefix_or_exact",
    """SELECT p_brand, count(*) AS n FROM part WHERE p_brand LIKE 'Brand#1%' GROUP BY 1
       UNION ALL SELECT p_brand, count(*) FROM part WHERE p_brand = 'Brand#22' GROUP BY 1""",
)
def _(t: Tables):
    prefixed = t.part.where(P.prefix_or_exact("p_brand", "Brand#1", 8))
    exact = t.part.where(P.prefix_or_exact("p_brand", "Brand#22", 8))
    return _count(prefixed, "p_brand").unionByName(_count(exact, "p_brand"))


@query(
    "c5_contains_ci",
    """SELECT p_name, p_type, count(*) AS n FROM part WHERE p_name ILIKE '%BOL%' OR p_type ILIKE '%BOL%' GROUP BY 1, 2""",
)
def _(t: Tables):
    return _count(t.part.where(text.contains_ci("BOL", "p_name", "p_type")), "p_name", "p_type")


# A small thesaurus in the vocabulary of the test tables: term of the reader → terms of the texts.
THESAURUS = {"screw": ["bolt", "gear"], "disc": ["ring"], "grand": ["large"], "grand disc": ["washer"]}


@query(
    "c6_synonym_search",
    """SELECT p_name, CAST(CASE WHEN strip_accents(lower(p_name)) LIKE '%grand disc%' THEN 0 ELSE 1 END AS INTEGER) AS synonym_only, count(*) AS n
       FROM part WHERE regexp_matches(strip_accents(lower(p_name)), 'grand disc|ring|large|washer') GROUP BY 1, 2""",
)
def _(t: Tables):
    return _count(text.synonym_search(t.part, "p_name", "Gránd  Disc", THESAURUS), "p_name", "synonym_only")


@query(
    "c6_synonym_search_documents",
    """SELECT lang, CAST(CASE WHEN strip_accents(lower(text)) LIKE '%nation%' THEN 0 ELSE 1 END AS INTEGER) AS synonym_only, count(*) AS n
       FROM documents WHERE regexp_matches(strip_accents(lower(text)), 'nation|eaux|cion') GROUP BY 1, 2""",
)
def _(t: Tables):
    thesaurus = {"nation": ["eaux", "cion"]}
    return _count(text.synonym_search(t.documents, "text", "Natión", thesaurus), "lang", "synonym_only")


CENSUS_SQL = """census AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN '00' ELSE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS ent,
    CASE WHEN c_custkey % 10 = 0 THEN '000' ELSE lpad(CAST(c_custkey % 400 AS VARCHAR), 3, '0') END AS mun,
    CASE WHEN c_custkey % 7 = 0 THEN '9998' WHEN c_custkey % 5 = 0 THEN '0000' ELSE lpad(CAST(c_custkey % 9000 AS VARCHAR), 4, '0') END AS loc FROM customer)"""


def census(t: Tables):
    key = F.col("c_custkey")
    return t.customer.select(
        key,
        F.when(key % 50 == 0, "00").otherwise(S.zero_pad("c_nationkey", 2)).alias("ent"),
        F.when(key % 10 == 0, "000").otherwise(S.zero_pad(key % 400, 3)).alias("mun"),
        F.when(key % 7 == 0, "9998").when(key % 5 == 0, "0000").otherwise(S.zero_pad(key % 9000, 4)).alias("loc"),
    )


@query(
    "c7_level_predicate",
    f"""WITH {CENSUS_SQL} SELECT CASE WHEN loc IN ('9998', '9999') THEN 'small_places' WHEN ent = '00' THEN 'nation'
        WHEN mun = '000' THEN 'state' WHEN loc = '0000' THEN 'municipality' ELSE 'locality' END AS level, count(*) AS n FROM census GROUP BY 1""",
)
def _(t: Tables):
    return _count(census(t), P.census_level("ent", "mun", "loc").alias("level"))


@query(
    "c8_exclude_totals",
    f"WITH {CENSUS_SQL} SELECT ent, count(*) AS n FROM census WHERE ent <> '00' AND mun <> '000' AND loc NOT IN ('0000', '9998', '9999') GROUP BY 1",
)
def _(t: Tables):
    return _count(census(t).where(P.census_level("ent", "mun", "loc") == "locality"), "ent")


@query(
    "c11_plausibility_clean",
    """WITH m AS (SELECT p_partkey, CASE WHEN p_size > 48 THEN NULL ELSE (30 + p_size * 2)::DOUBLE END AS kg, (1.1::DOUBLE + (p_partkey % 110) / 100.0::DOUBLE) AS height,
                    p_type = 'PROMO' AS pregnant, p_size % 9 AS weight FROM part)
       SELECT CASE WHEN kg / (height * height) < 18.5 THEN 'underweight' WHEN kg / (height * height) < 25 THEN 'normal'
              WHEN kg / (height * height) < 30 THEN 'overweight' ELSE 'obese' END AS class, count(*) AS n, CAST(sum(weight) AS BIGINT) AS persons
       FROM m WHERE height BETWEEN 1.3::DOUBLE AND 2.0::DOUBLE AND kg / (height * height) BETWEEN 10 AND 58 AND NOT pregnant AND weight > 0 GROUP BY 1""",
)
def _(t: Tables):
    raw_kg = F.when(F.col("p_size") > 48, 222.222).otherwise((F.col("p_size") * 2 + 30).cast("double"))
    body = t.part.select(
        P.measured(raw_kg).alias("kg"),
        (F.lit(1.1) + (F.col("p_partkey") % 110) / F.lit(100.0)).alias("height"),
        (F.col("p_type") == "PROMO").alias("pregnant"),
        (F.col("p_size") % 9).alias("weight"),
    ).withColumn("bmi", S.bmi("kg", "height"))
    kept = body.where(P.plausible_body(F.col("height"), F.col("bmi"), F.col("pregnant"), F.col("weight")))
    return kept.groupBy(S.bmi_class("bmi").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").cast("bigint").alias("persons")
    )


@query(
    "c12_range_clean",
    """WITH d AS (SELECT event_type, value / 8 - 3 AS high, (event_id % 70) - 12.0::DOUBLE AS low FROM events)
       SELECT event_type, count(*) AS rows, count(*) FILTER (high < low) AS crossed,
              CAST(sum(CASE WHEN high >= low THEN CAST(high NOT BETWEEN -30 AND 55 AS INTEGER) + CAST(low NOT BETWEEN -30 AND 55 AS INTEGER) ELSE 0 END) AS BIGINT) AS out_of_range,
              count(*) FILTER (high >= low AND high BETWEEN -30 AND 55) AS kept_high, count(*) FILTER (high >= low AND low BETWEEN -30 AND 55) AS kept_low
       FROM d GROUP BY 1""",
)
def _(t: Tables):
    days = t.events.select(
        "event_type",
        (F.col("value") / 8 - 3).alias("high"),
        ((F.col("event_id") % 70) - F.lit(12.0)).alias("low"),
    )
    cleaned = P.clean_extremes(days, "high", "low")
    return cleaned.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.array_contains("dropped", "crossed")).alias("crossed"),
        F.sum(F.size(F.filter("dropped", lambda d: d == "out_of_range"))).alias("out_of_range"),
        F.count("high").alias("kept_high"),
        F.count("low").alias("kept_low"),
    )


@query(
    "c13_current_alerts",
    """WITH a AS (SELECT 'A' || CAST(event_id AS VARCHAR) AS identifier, CASE WHEN event_type = 'error' THEN 'Cancel' ELSE 'Alert' END AS message,
                   ts AS starts, ts + to_milliseconds(CAST(floor(value * 200) AS BIGINT) * 1000) AS expires,
                   CASE WHEN event_id % 3 = 0 THEN 'a' || CAST(event_id + 1 AS VARCHAR) ELSE '' END AS ref FROM events)
       SELECT identifier, starts FROM a WHERE message <> 'Cancel' AND expires > TIMESTAMP '2024-01-15 12:00:00'
          AND starts <= TIMESTAMP '2024-01-15 18:00:00' AND lower(identifier) NOT IN (SELECT ref FROM a WHERE ref <> '')""",
)
def _(t: Tables):
    event = F.col("event_id").cast("string")
    start = F.col("ts").cast("timestamp")
    life = F.make_dt_interval(secs=F.floor(F.col("value") * 200).cast("decimal(18,6)"))
    alerts = t.events.select(
        F.concat(F.lit("A"), event).alias("identifier"),
        F.when(F.col("event_type") == "error", "Cancel").otherwise("Alert").alias("message"),
        start.alias("starts"),
        (start + life).alias("expires"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x,a"), (F.col("event_id") + 1).cast("string"), F.lit(",y")))
        .otherwise("")
        .alias("references"),
    )
    live = P.current_alerts(alerts, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return live.select("identifier", F.col("starts").cast("timestamp_ntz").alias("starts"))


L_SHAPE = [(-110.0, 16.0), (-95.0, 16.0), (-95.0, 22.0), (-102.0, 22.0), (-102.0, 30.0), (-110.0, 30.0)]


@query(
    "c14_point_in_polygon",
    """WITH p AS (SELECT s_suppkey, 14.005::DOUBLE + (s_suppkey * 37 % 1900) / 100.0::DOUBLE AS lat, -117.995::DOUBLE + (s_suppkey * 53 % 3200) / 100.0::DOUBLE AS lon FROM supplier)
       SELECT s_suppkey, (lon > -110 AND lon < -95 AND lat > 16 AND lat < 22) OR (lon > -110 AND lon < -102 AND lat > 16 AND lat < 30) AS inside FROM p""",
)
def _(t: Tables):
    lat = F.lit(14.005) + (F.col("s_suppkey") * 37 % 1900) / F.lit(100.0)
    lon = F.lit(-117.995) + (F.col("s_suppkey") * 53 % 3200) / F.lit(100.0)
    return t.supplier.select("s_suppkey", geo.point_in_ring(lon, lat, geo.ring_of(L_SHAPE)).alias("inside"))
