"""Scalar functions (B) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from censora.functions import scalars as S
from censora.functions import geo, text
from censora.queries import Tables, query


@query(
    "b1_round_half_even",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CAST(format('{:.2f}', l_extendedprice * (1 - l_discount)) AS DOUBLE) AS net_2,
              CAST(format('{:.0f}', l_extendedprice * 0.5) AS DOUBLE) AS half_0
       FROM lineitem""",
)
def _(t: Tables):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        S.round_half_even(net, 2).alias("net_2"),
        S.round_half_even(F.col("l_extendedprice") * 0.5, 0).alias("half_0"),
    )


@query(
    "b2_round_half_up",
    """SELECT event_id, floor(value * 10 + 0.5 + 1e-9) / 10 AS value_1, floor(value * 1 + 0.5 + 1e-9) / 1 AS value_0
       FROM events""",
)
def _(t: Tables):
    return t.events.select(
        "event_id", S.round_half_up("value", 1).alias("value_1"), S.round_half_up("value", 0).alias("value_0")
    )


@query(
    "b3_zero_pad_code",
    """SELECT s_suppkey, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS state_code,
              CASE WHEN length(CAST(s_suppkey AS VARCHAR)) >= 2 THEN CAST(s_suppkey AS VARCHAR)
                   ELSE lpad(CAST(s_suppkey AS VARCHAR), 2, '0') END AS supplier_code
       FROM supplier""",
)
def _(t: Tables):
    return t.supplier.select(
        "s_suppkey",
        S.zero_pad("s_nationkey", 2).alias("state_code"),
        S.zero_pad("s_suppkey", 2).alias("supplier_code"),
    )


@query(
    "b4_code_prefix",
    """SELECT substr(o_orderpriority, 1, 1) AS sector, substr(o_orderpriority, 1, 3) AS subsector, count(*) AS orders
       FROM orders GROUP BY 1, 2""",
)
def _(t: Tables):
    keyed = t.orders.select(
        S.code_prefix("o_orderpriority", 1).alias("sector"), S.code_prefix("o_orderpriority", 3).alias("subsector")
    )
    return keyed.groupBy("sector", "subsector").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "b5_concat_key",
    """SELECT concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS line_key,
              count(*) AS copies
       FROM lineitem GROUP BY 1""",
)
def _(t: Tables):
    return (
        t.lineitem.select(S.concat_key("l_orderkey", "l_linenumber").alias("line_key"))
        .groupBy("line_key")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


# DuckDB's strip_accents drops every diacritic, so the check holds for all letters of the documents.
@query(
    "b6_strip_accents",
    r"""SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')) AS folded FROM documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", text.strip_accents("text").alias("folded"))


@query(
    "b7_slugify",
    """SELECT p_partkey, trim(regexp_replace(strip_accents(lower(p_name || ' (' || p_type || ')')), '[^a-z0-9]+', '-', 'g'), '-') AS slug
       FROM part""",
)
def _(t: Tables):
    return t.part.select("p_partkey", text.slugify(F.format_string("%s (%s)", "p_name", "p_type")).alias("slug"))


SALARY_EDGES = (5_000, 10_000, 20_000, 30_000, 50_000, 80_000, 120_000)
SALARY_LABELS = ("0-5K", "5K-10K", "10K-20K", "20K-30K", "30K-50K", "50K-80K", "80K-120K", "120K+")


@query(
    "b8_bucketize",
    """SELECT CASE WHEN o_totalprice < 5000 THEN '0-5K' WHEN o_totalprice < 10000 THEN '5K-10K'
                   WHEN o_totalprice < 20000 THEN '10K-20K' WHEN o_totalprice < 30000 THEN '20K-30K'
                   WHEN o_totalprice < 50000 THEN '30K-50K' WHEN o_totalprice < 80000 THEN '50K-80K'
                   WHEN o_totalprice < 120000 THEN '80K-120K' ELSE '120K+' END AS bucket,
              count(*) AS orders
       FROM orders GROUP BY 1""",
)
def _(t: Tables):
    bucket = S.bucketize("o_totalprice", SALARY_EDGES, SALARY_LABELS).alias("bucket")
    return t.orders.groupBy(bucket).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "b9_recode",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'NE' END AS status, count(*) AS orders
       FROM orders GROUP BY 1""",
)
def _(t: Tables):
    status = S.recode("o_orderstatus", {"F": "finished", "O": "open"}, "NE").alias("status")
    return t.orders.groupBy(status).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "b10_normalize_year",
    """WITH y AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 99 ELSE CAST(year(o_orderdate) AS INTEGER) % 100 END AS yy,
                         CAST(year(o_orderdate) AS INTEGER) AS reference FROM orders)
       SELECT o_orderkey, CAST(CASE WHEN yy IN (99, 999, 9999) THEN NULL WHEN yy >= 85 OR yy > reference % 100 THEN 1900 + yy
              WHEN yy < 100 THEN 2000 + yy ELSE yy END AS INTEGER) AS year FROM y""",
)
def _(t: Tables):
    two_digits = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 11 == 0, 99).otherwise(F.year("o_orderdate") % 100).alias("yy"),
        F.year("o_orderdate").alias("reference"),
    )
    return two_digits.select("o_orderkey", S.normalize_year("yy", "reference").alias("year"))


@query(
    "b12_completed_years",
    """SELECT o_orderkey, CAST(year(DATE '2024-03-15') - year(o_orderdate)
              - CASE WHEN '03-15' < strftime(o_orderdate, '%m-%d') THEN 1 ELSE 0 END AS INTEGER) AS years
       FROM orders""",
)
def _(t: Tables):
    as_of = F.lit("2024-03-15").cast("date")
    return t.orders.select("o_orderkey", S.completed_years("o_orderdate", as_of).alias("years"))


@query(
    "b13_civil_date",
    """SELECT CAST(ts - INTERVAL 6 HOUR AS DATE) AS civil_date, count(*) AS events,
              CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 6 HOUR AS starts_utc,
              CAST(CAST(ts - INTERVAL 6 HOUR AS DATE) AS TIMESTAMP) + INTERVAL 30 HOUR AS ends_utc
       FROM events GROUP BY 1""",
)
def _(t: Tables):
    days = t.events.groupBy(S.civil_date("ts").alias("civil_date")).agg(F.count(F.lit(1)).alias("events"))
    return days.select(
        "civil_date",
        "events",
        S.civil_day_start("civil_date").cast("timestamp_ntz").alias("starts_utc"),
        S.civil_day_start(F.date_add("civil_date", 1)).cast("timestamp_ntz").alias("ends_utc"),
    )


@query(
    "b14_floor_minute",
    """SELECT event_id, date_trunc('minute', ts) AS minute, CAST(hour(ts - INTERVAL 6 HOUR) AS INTEGER) AS local_hour,
              CAST(month(ts - INTERVAL 6 HOUR) AS INTEGER) AS local_month FROM events""",
)
def _(t: Tables):
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "-06:00")
    return t.events.select(
        "event_id",
        S.floor_minute("ts").cast("timestamp_ntz").alias("minute"),
        F.hour(local).alias("local_hour"),
        F.month(local).alias("local_month"),
    )


@query(
    "b15_parse_period",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || 'T' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
              CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderdate + INTERVAL 13 HOUR + INTERVAL 5 MINUTE AS stamp
       FROM orders""",
)
def _(t: Tables):
    published = t.orders.select(
        "o_orderkey",
        F.concat(F.year("o_orderdate").cast("string"), F.lit("/0"), F.quarter("o_orderdate").cast("string")).alias("q"),
        F.date_format("o_orderdate", "yyyy-MM").alias("m"),
        F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" 1:05:00 p. m.")).alias("s"),
    )
    return published.select(
        "o_orderkey",
        S.parse_quarter("q").alias("quarter"),
        S.parse_month("m").alias("month"),
        S.parse_local_stamp("s").alias("stamp"),
    )


@query(
    "b16_trim_decimal_text",
    """WITH v AS (SELECT o_orderkey, CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18, 4)) AS VARCHAR) AS raw FROM orders)
       SELECT o_orderkey, rtrim(rtrim(raw, '0'), '.') AS trimmed FROM v""",
)
def _(t: Tables):
    raw = F.round("o_totalprice", 2).cast("decimal(18,4)").cast("string")
    return t.orders.select("o_orderkey", S.trim_decimal_text(raw).alias("trimmed"))


@query(
    "b17_safe_ratio",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / nullif(l_tax * 100, 0) AS ratio,
              CASE WHEN l_tax > 0 THEN (l_discount - l_tax) / l_tax * 100 END AS gap_pct
       FROM lineitem""",
)
def _(t: Tables):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        S.safe_ratio("l_extendedprice", F.col("l_tax") * 100).alias("ratio"),
        S.pct_change("l_discount", "l_tax").alias("gap_pct"),
    )


@query(
    "b18_bmi",
    """WITH b AS (SELECT p_partkey, (40 + p_size) / ((1.3 + (p_partkey % 70) / 100.0::DOUBLE) * (1.3 + (p_partkey % 70) / 100.0::DOUBLE)) AS bmi FROM part)
       SELECT p_partkey, bmi, CASE WHEN bmi < 18.5 THEN 'underweight' WHEN bmi < 25 THEN 'normal'
              WHEN bmi < 30 THEN 'overweight' ELSE 'obese' END AS class FROM b""",
)
def _(t: Tables):
    height = F.lit(1.3) + (F.col("p_partkey") % 70) / F.lit(100.0)
    index = S.bmi((F.col("p_size") + 40).cast("double"), height)
    return t.part.select("p_partkey", index.alias("bmi"), S.bmi_class(index).alias("class"))


@query(
    "b19_relative_humidity",
    """WITH r AS (SELECT event_id, value / 12 AS temp, value / 12 - 4 AS dew FROM events)
       SELECT event_id, floor(100 * exp(17.62 * dew / (243.12 + dew) - 17.62 * temp / (243.12 + temp)) * 100 + 0.5) / 100 AS humidity
       FROM r""",
)
def _(t: Tables):
    temp = F.col("value") / 12
    humidity = S.relative_humidity(temp, temp - 4)
    return t.events.select("event_id", (F.floor(humidity * 100 + 0.5).cast("double") / 100).alias("humidity"))




@query(
    "b20_haversine",
    """WITH p AS (SELECT c_custkey, 14 + (c_custkey * 37 % 1900) / 100.0::DOUBLE AS lat, -118 + (c_custkey * 53 % 3200) / 100.0::DOUBLE AS lon FROM customer)
       SELECT c_custkey, floor(2 * 6371000 * asin(sqrt(power(sin(radians(lat - 19.4326) / 2), 2)
              + cos(radians(19.4326)) * cos(radians(lat)) * power(sin(radians(lon - -99.1332) / 2), 2))) * 10 + 0.5) / 10 AS distance_m
       FROM p""",
)
def _(t: Tables):
    lat = F.lit(14) + (F.col("c_custkey") * 37 % 1900) / F.lit(100.0)
    lon = F.lit(-118) + (F.col("c_custkey") * 53 % 3200) / F.lit(100.0)
    return t.customer.select("c_custkey", geo.haversine_m(lat, lon, 19.4326, -99.1332).alias("distance_m"))


@query(
    "b21_json_field",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              '{"user_id":' || CAST(user_id AS VARCHAR) || ',"event_type":"' || event_type || '"}' AS leftovers
       FROM events""",
)
def _(t: Tables):
    return t.events.select(
        "event_id",
        S.json_field("props", "k", "int").alias("k"),
        S.leftovers_json(["user_id", "event_type"]).alias("leftovers"),
    )


@query(
    "b22_percentile_rank_grid",
    """WITH g AS (SELECT list(3.0 + i * i * 1.2 ORDER BY i) AS grid FROM range(21) r(i)),
            h AS (SELECT event_id, value, i, 3.0 + i * i * 1.2 AS low, 3.0 + (i + 1) * (i + 1) * 1.2 AS high
                  FROM events CROSS JOIN range(20) r(i)),
            f AS (SELECT event_id, any_value(value) AS value, min(i) FILTER (value >= low AND value <= high) AS i FROM h GROUP BY event_id)
       SELECT event_id, CASE WHEN value <= 3.0 THEN 0.0::DOUBLE WHEN value >= 3.0 + 400 * 1.2 THEN 100.0::DOUBLE
              ELSE i * 5 + (value - (3.0 + i * i * 1.2)) / ((3.0 + (i + 1) * (i + 1) * 1.2) - (3.0 + i * i * 1.2)) * 5 END AS rank
       FROM f""".replace("3.0", "3.0::DOUBLE").replace("1.2", "1.2::DOUBLE"),
)
def _(t: Tables):
    grid = F.array(*[F.lit(3.0) + F.lit(i * i) * F.lit(1.2) for i in range(21)])
    return t.events.select("event_id", S.percentile_rank_from_grid(grid, "value").alias("rank"))


@query(
    "b23_select_columns",
    """SELECT l_orderkey, l_linenumber, l_quantity,
              '{"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus || '"}' AS extras
       FROM lineitem""",
)
def _(t: Tables):
    extras = S.leftovers_json(["l_returnflag", "l_linestatus"]).alias("extras")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", extras)


SEGMENT_CODES = {"AUTOMOBILE": "01", "BUILDING": "02", "FURNITURE": "03", "HOUSEHOLD": "04"}


@query(
    "b24_map_code",
    """SELECT c_mktsegment AS segment, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '01' WHEN 'BUILDING' THEN '02'
              WHEN 'FURNITURE' THEN '03' WHEN 'HOUSEHOLD' THEN '04' END AS segment_code, count(*) AS customers
       FROM customer GROUP BY 1""",
)
def _(t: Tables):
    counts = t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("customers"))
    return counts.select("segment", S.map_code("segment", SEGMENT_CODES).alias("segment_code"), "customers")


@query(
    "b25_stage_of",
    """WITH q AS (SELECT CAST(year(o_orderdate) + 20 AS VARCHAR) || 'T' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter FROM orders)
       SELECT quarter, CASE WHEN quarter <= '2020T1' THEN 'clasica' ELSE 'enoe_n' END AS stage, count(*) AS n FROM q GROUP BY 1, 2""",
)
def _(t: Tables):
    quarter = F.concat((F.year("o_orderdate") + 20).cast("string"), F.lit("T"), F.quarter("o_orderdate").cast("string"))
    counts = t.orders.groupBy(quarter.alias("quarter")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("quarter", S.stage_of("quarter").alias("stage"), "n")


@query(
    "b26_clean_number_text",
    r"""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'NC' WHEN o_orderkey % 17 = 0 THEN '*'
                     ELSE format('{:,.2f}', o_totalprice) END AS raw FROM orders)
       SELECT o_orderkey, CASE WHEN raw IN ('NC', '*') THEN NULL ELSE CAST(replace(raw, ',', '') AS DOUBLE) END AS value,
              CASE WHEN raw IN ('NC', '*') THEN raw END AS flag FROM v""",
)
def _(t: Tables):
    raw = (
        F.when(F.col("o_orderkey") % 13 == 0, "NC")
        .when(F.col("o_orderkey") % 17 == 0, "*")
        .otherwise(F.format_number("o_totalprice", 2))
    )
    return t.orders.select("o_orderkey", S.clean_number_text(raw).alias("value"), S.number_flag(raw).alias("flag"))


@query(
    "b27_level_from_key",
    """WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '00' WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_nationkey AS VARCHAR), 2, '0')
                    ELSE lpad(CAST(c_custkey % 90000 AS VARCHAR), 5, '0') END AS key, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS deep FROM customer)
       SELECT c_custkey, CASE WHEN key = '00' THEN 'nation' WHEN length(key) = 2 THEN 'state' WHEN length(key) = 4 THEN 'country'
              WHEN length(key) = 5 THEN 'municipality' ELSE 'other' END AS level,
              CAST(CASE WHEN deep <> '' THEN 2 ELSE 1 END AS INTEGER) AS depth, CASE WHEN deep <> '' THEN deep ELSE key END AS code FROM k""",
)
def _(t: Tables):
    key = (
        F.when(F.col("c_custkey") % 10 == 0, "00")
        .when(F.col("c_custkey") % 3 == 0, S.zero_pad("c_nationkey", 2))
        .otherwise(S.zero_pad(F.col("c_custkey") % 90000, 5))
    )
    deep = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment"))
    depth, code = S.deepest_code(key, deep)
    return t.customer.select("c_custkey", S.level_from_key(key).alias("level"), depth.alias("depth"), code.alias("code"))
