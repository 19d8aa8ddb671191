"""Joins (D) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from censora.functions.scalars import cents
from censora.operators import joins as J
from censora.operators.ordering import order_statistics, with_previous
from censora.queries import Tables, query


@query(
    "d1_star_inner",
    """SELECT n_name, r_name, count(*) AS customers, CAST(sum(round(c_acctbal * 100)) AS BIGINT) AS balance_cents
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def _(t: Tables):
    per_nation = t.customer.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(cents("c_acctbal")).alias("balance_cents")
    )
    named = J.with_catalogue(per_nation, t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "inner")
    placed = J.with_catalogue(named, t.region, F.col("n_regionkey") == F.col("r_regionkey"), "inner")
    return placed.select("n_name", "r_name", "customers", "balance_cents")


@query(
    "d2_left_keeps_unknown",
    """SELECT coalesce(n_name, 'unknown') AS nation, count(*) AS customers FROM customer
       LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 7) n ON c_nationkey = n_nationkey GROUP BY 1""",
)
def _(t: Tables):
    known = t.nation.where("n_nationkey <> 7")
    counts = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    named = J.with_catalogue(counts, known, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy(F.coalesce("n_name", F.lit("unknown")).alias("nation")).agg(F.sum("customers").alias("customers"))


@query(
    "d3_absent_members",
    """SELECT c_custkey, count(o_orderkey) AS orders, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents FROM customer
       LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1""",
)
def _(t: Tables):
    open_orders = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("o_orderkey").alias("orders"), F.sum(cents("o_totalprice")).alias("cents")
    )
    joined = J.all_members(t.customer.select("c_custkey"), open_orders, ["c_custkey"], F.lit(True))
    return joined.select("c_custkey", F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"), "cents")


@query(
    "d4_composite_key",
    """WITH a AS (SELECT l_orderkey, l_linenumber, count(*) AS parts FROM lineitem GROUP BY 1, 2),
            b AS (SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
       SELECT l_orderkey, l_linenumber, parts, quantity FROM a JOIN b USING (l_orderkey, l_linenumber)""",
)
def _(t: Tables):
    keys = ["l_orderkey", "l_linenumber"]
    parts = t.lineitem.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"))
    returned = t.lineitem.where("l_returnflag = 'R'").groupBy(*keys).agg(F.sum("l_quantity").cast("bigint").alias("quantity"))
    return parts.join(returned, keys)


@query(
    "d5_has_any",
    """SELECT c_mktsegment, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '3-MEDIUM' AND o_orderstatus = 'F') AS INTEGER) AS victim,
              count(*) AS n FROM customer GROUP BY 1, 2""",
)
def _(t: Tables):
    offences = t.orders.where("o_orderpriority <> '3-MEDIUM' and o_orderstatus = 'F'")
    offences = offences.select(F.col("o_custkey").alias("c_custkey"))
    flagged = J.flag_has_any(t.customer, offences, ["c_custkey"], "victim")
    return flagged.groupBy("c_mktsegment", "victim").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d6_new_keys",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')",
)
def _(t: Tables):
    seen = t.orders.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return J.only_new(t.customer.select("c_custkey"), seen.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(
    "d7_single_row_lookups",
    """SELECT c_custkey, r_name, s_name, c_acctbal FROM customer, (SELECT r_name FROM region WHERE r_regionkey = 2) r,
              (SELECT s_name FROM supplier WHERE s_suppkey = 3) s WHERE c_nationkey = 3""",
)
def _(t: Tables):
    # Two look-ups of one row each, read as scalars.
    region = t.region.where("r_regionkey = 2").select("r_name").scalar()
    supplier = t.supplier.where("s_suppkey = 3").select("s_name").scalar()
    chosen = t.customer.where("c_nationkey = 3")
    return chosen.select("c_custkey", region.alias("r_name"), supplier.alias("s_name"), "c_acctbal")


@query(
    "d8_correlated_scalar",
    """SELECT c_custkey, c_name, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest_order FROM customer""",
)
def _(t: Tables):
    largest = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("largest_order"))
    return t.customer.select("c_custkey", "c_name").join(largest, "c_custkey", "left")


@query(
    "d9_vertical_split",
    """SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part""",
)
def _(t: Tables):
    first = t.part.select("p_partkey", "p_name", "p_brand")
    second = t.part.select("p_partkey", "p_type", "p_size", "p_retailprice")
    return first.join(second, "p_partkey")


@query(
    "d10_latest_per_key",
    """SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(t: Tables):
    rows = t.events.select("user_id", "event_id", "ts", "event_type")
    return J.latest_per_key(rows, ["user_id"], ["ts", "event_id"])


@query(
    "d11_asof_nearest",
    """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
            r AS (SELECT user_id, ts AS vts, value FROM events WHERE event_type = 'view'),
            j AS (SELECT l.event_id, l.user_id, l.ts, r.vts, r.value, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.vts)), r.vts, r.value) AS rn
                  FROM l JOIN r ON l.user_id = r.user_id AND abs(epoch_us(l.ts) - epoch_us(r.vts)) <= 2400000000)
       SELECT l.event_id, l.user_id, l.ts, j.value, j.vts AS matched_at, abs(epoch_us(l.ts) - epoch_us(j.vts)) / 1000000 AS distance_s
       FROM l LEFT JOIN j ON j.event_id = l.event_id AND j.rn = 1""",
)
def _(t: Tables):
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("vts"), "value")
    near = J.nearest_within(purchases, views, ["user_id"], "ts", "vts", ["value"], 40 * 60)
    return near.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn(
        "matched_at", F.col("matched_at").cast("timestamp_ntz")
    )


@query(
    "d12_previous_row",
    """SELECT event_id, user_id, lag(ts) OVER w AS prev_ts, lag(value) OVER w AS prev_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(t: Tables):
    rows = t.events.select("event_id", "user_id", "ts", "value")
    out = with_previous(rows, ["user_id"], ["ts", "event_id"], F.date_trunc("minute", "ts"), ["ts", "value"])
    return out.select("event_id", "user_id", "prev_ts", "prev_value")


def decile_bands(df, value):
    """Lowest and highest value of each tenth of the rows (the first n % 10 tenths hold one row more)."""

    def start(n, d):  # 0-based rank of the first row of tenth d (0..10)
        return F.floor(n / 10) * d + F.least(n % 10, F.lit(d))

    ranks = {}
    for d in range(10):
        ranks[f"low_{d}"] = lambda n, d=d: start(n, d)
        ranks[f"high_{d}"] = lambda n, d=d: start(n, d + 1) - 1
    wide = order_statistics(df, [], value, ranks)
    bands = [F.struct(F.lit(d + 1).alias("band"), F.col(f"low_{d}").alias("lower"), F.col(f"high_{d}").alias("upper")) for d in range(10)]
    return wide.select(F.explode(F.array(*bands)).alias("b")).select("b.*")


@query(
    "d13_band_join",
    """WITH b AS (SELECT d AS band, min(o_totalprice) AS lower, max(o_totalprice) AS upper FROM (SELECT o_totalprice, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS d FROM orders) GROUP BY 1),
            c AS (SELECT c_custkey, c_acctbal * 60 AS income FROM customer)
       SELECT c_custkey, CAST(coalesce((SELECT min(band) FROM b WHERE lower <= income AND income <= upper),
              CASE WHEN income > (SELECT max(upper) FROM b) THEN 10 WHEN income < (SELECT min(lower) FROM b) THEN 1 END) AS INTEGER) AS decile FROM c""",
)
def _(t: Tables):
    bands = decile_bands(t.orders, "o_totalprice")
    return J.with_band(t.customer, F.col("c_acctbal") * 60, bands, "decile").select("c_custkey", "decile")


CLASS_LOG_SQL = """log AS (SELECT user_id % 4 AS datum, ts AS since, event_id, CASE WHEN value < 20 THEN 'DPM' WHEN value < 30 THEN 'DPS' ELSE 'out' END AS class FROM events)"""


@query(
    "d14_interval_overlap",
    f"""WITH {CLASS_LOG_SQL},
             spans AS (SELECT datum, class, since, coalesce(lead(since) OVER (PARTITION BY datum ORDER BY since, event_id), TIMESTAMP '9999-12-31') AS until FROM log),
             days AS (SELECT DISTINCT datum, CAST(ts - INTERVAL 6 HOUR AS DATE) AS day FROM events, (SELECT DISTINCT datum FROM log))
        SELECT datum, day, EXISTS (SELECT 1 FROM spans s WHERE s.datum = d.datum AND s.class IN ('DPM', 'DPS')
               AND s.since < CAST(d.day AS TIMESTAMP) + INTERVAL 30 HOUR AND s.until > CAST(d.day AS TIMESTAMP) + INTERVAL 6 HOUR) AS in_class FROM days d""",
)
def _(t: Tables):
    log = t.events.select(
        (F.col("user_id") % 4).alias("datum"),
        F.struct("ts", "event_id").alias("since"),
        F.when(F.col("value") < 20, "DPM").when(F.col("value") < 30, "DPS").otherwise("out").alias("class"),
    )
    civil = F.to_date(F.col("since.ts") - F.expr("INTERVAL 6 HOURS"))
    day = F.to_date(F.col("ts") - F.expr("INTERVAL 6 HOURS")).alias("day")
    days = t.events.select(day).distinct()
    # Four data × the calendar: both sides are bounded by the number of days.
    requests = days.withColumn("datum", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(4)])))
    return J.in_class_on_days(log, requests, ["datum"], "since", "class", ["DPM", "DPS"], civil)


@query(
    "d15_forecast_error_rows",
    """WITH h AS (SELECT event_type AS station, date_trunc('hour', ts) AS hour, CAST(sum(round(value * 100)) AS BIGINT) AS cents, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT m.station, m.hour, m.cents / (100 * m.n) AS measured, f.cents / (100 * f.n) AS forecast, f.cents / (100 * f.n) - m.cents / (100 * m.n) AS error
       FROM h m JOIN h f ON f.station = m.station AND f.hour = m.hour - INTERVAL 24 HOUR""",
)
def _(t: Tables):
    hourly = t.events.groupBy(F.col("event_type").alias("station"), F.date_trunc("hour", "ts").alias("hour")).agg(
        (F.sum(cents("value")) / (F.count(F.lit(1)) * 100)).alias("measured")
    )
    shifted = hourly.select("station", (F.col("hour") + F.expr("INTERVAL 24 HOURS")).alias("hour"), F.col("measured").alias("forecast"))
    joined = hourly.join(shifted, ["station", "hour"]).withColumn("error", F.col("forecast") - F.col("measured"))
    return joined.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def sites(df, key):
    """Positions made from keys, inside the country's box."""
    return df.select(
        F.col(key).alias("id"),
        (F.lit(14) + (F.col(key) * 37 % 1900) / F.lit(100.0)).alias("lat"),
        (F.lit(-118) + (F.col(key) * 53 % 3200) / F.lit(100.0)).alias("lon"),
    )


def _place(key, table, alias):
    return f"""{alias} AS (SELECT {key} AS id, 14 + (({key}) * 37 % 1900) / 100.0::DOUBLE AS lat, -118 + (({key}) * 53 % 3200) / 100.0::DOUBLE AS lon FROM {table})"""


def _distance(lat, lon, lat0, lon0):
    return f"""floor(2 * 6371000 * asin(sqrt(power(sin(radians({lat} - {lat0}) / 2), 2) + cos(radians({lat0})) * cos(radians({lat})) * power(sin(radians({lon} - {lon0}) / 2), 2))) * 10 + 0.5) / 10"""


@query(
    "d16_radius_search",
    f"""WITH {_place("l_partkey + l_orderkey * 7", "lineitem", "p")}, d AS (SELECT id, lat, lon, {_distance("lat", "lon", "19.43", "-99.13")} AS distance_m FROM p),
             k AS (SELECT * FROM d WHERE distance_m <= 150000)
        SELECT id, lat, lon, distance_m, (SELECT count(*) FROM k) AS total FROM k ORDER BY distance_m, id LIMIT 50""",
)
def _(t: Tables):
    spots = t.lineitem.select((F.col("l_partkey") + F.col("l_orderkey") * 7).alias("id"))
    return J.radius_search(sites(spots, "id"), 19.43, -99.13, 150_000, 50)


@query(
    "d17_sites_near",
    f"""WITH {_place("s_suppkey", "supplier", "s")}, {_place("n_nationkey", "nation", "c")},
             d AS (SELECT c.id AS centre, s.id AS site, {_distance("s.lat", "s.lon", "c.lat", "c.lon")} AS distance_m FROM s, c)
        SELECT centre, site, distance_m FROM d WHERE distance_m <= 400000""",
)
def _(t: Tables):
    centres = sites(t.nation, "n_nationkey").toDF("centre", "clat", "clon")
    near = J.sites_near(centres, sites(t.supplier, "s_suppkey").withColumnRenamed("id", "site"), 400_000)
    return near.select("centre", "site", "distance_m")


@query(
    "d18_resolve_names",
    """SELECT n_nationkey AS code, count(*) AS customers FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_nationkey = 5 THEN 6 WHEN c_nationkey = 9 THEN NULL ELSE c_nationkey END GROUP BY 1""",
)
def _(t: Tables):
    spelled = t.customer.select(
        F.when(F.col("c_nationkey") == 5, "Old Náme")
        .when(F.col("c_nationkey") == 9, "nowhere")
        .otherwise(F.concat(F.lit("Nátion_"), F.col("c_nationkey").cast("string")))
        .alias("spelled")
    )
    resolved = J.resolve_names(spelled, "spelled", t.nation, "n_nationkey", "n_name", {"old name": "nation_6"})
    return resolved.groupBy(F.col("n_nationkey").alias("code")).agg(F.count(F.lit(1)).alias("customers"))


@query(
    "d19_full_reconciliation",
    """WITH a AS (SELECT c_nationkey AS geo, count(*) AS calculated FROM customer WHERE c_nationkey <> 3 GROUP BY 1),
            b AS (SELECT s_nationkey AS geo, count(*) AS official FROM supplier WHERE s_nationkey <> 4 GROUP BY 1)
       SELECT geo, calculated, official, calculated - official AS delta FROM a FULL JOIN b USING (geo)""",
)
def _(t: Tables):
    calculated = t.customer.where("c_nationkey <> 3").groupBy(F.col("c_nationkey").alias("geo")).agg(F.count(F.lit(1)).alias("calculated"))
    official = t.supplier.where("s_nationkey <> 4").groupBy(F.col("s_nationkey").alias("geo")).agg(F.count(F.lit(1)).alias("official"))
    return calculated.join(official, "geo", "full_outer").withColumn("delta", F.col("calculated") - F.col("official"))


CAVEATS = (
    {"code": "domain-15-plus", "since": "1995T1", "until": "1996T2", "tags": ("1-URGENT", "2-HIGH")},
    {"code": "frame-change", "since": "1998T3", "until": "1999T4"},
    {"code": "gap", "since": "1999T2", "until": "1999T2"},
)


@query(
    "d20_annotate_rules",
    """WITH q AS (SELECT CAST(year(o_orderdate) AS VARCHAR) || 'T' || CAST(quarter(o_orderdate) AS VARCHAR) AS period, o_orderpriority AS indicator, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT period, indicator, n, concat_ws(',', CASE WHEN period BETWEEN '1995T1' AND '1996T2' AND indicator IN ('1-URGENT', '2-HIGH') THEN 'domain-15-plus' END,
              CASE WHEN period BETWEEN '1998T3' AND '1999T4' THEN 'frame-change' END, CASE WHEN period = '1999T2' THEN 'gap' END) AS caveats FROM q""",
)
def _(t: Tables):
    period = F.concat(F.year("o_orderdate").cast("string"), F.lit("T"), F.quarter("o_orderdate").cast("string"))
    counts = t.orders.groupBy(period.alias("period"), F.col("o_orderpriority").alias("indicator")).agg(F.count(F.lit(1)).alias("n"))
    noted = J.annotate(counts, CAVEATS, F.col("period"), F.col("period"), F.col("indicator"))
    return noted.withColumn("caveats", F.concat_ws(",", "caveats"))


@query(
    "d21_pick_station",
    f"""WITH {_place("s_suppkey", "supplier", "s")}, {_place("n_nationkey", "nation", "c")},
             d AS (SELECT c.id AS centre, s.id AS site, {_distance("s.lat", "s.lon", "c.lat", "c.lon")} AS distance_m, s.id % 5 <> 0 AS fresh, s.id % 7 <> 0 AS measures, s.id % 3 = 0 AS particulates FROM s, c),
             k AS (SELECT * FROM d WHERE distance_m <= 400000 AND fresh AND measures),
             m AS (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY distance_m > 250000, distance_m, site) AS rn FROM k),
             e AS (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY distance_m, site) AS rn FROM k WHERE particulates AND distance_m <= 250000)
        SELECT centre, CAST(1 AS INTEGER) AS pick, site, distance_m, particulates FROM m WHERE rn = 1
        UNION ALL SELECT e.centre, CAST(2 AS INTEGER), e.site, e.distance_m, e.particulates FROM e JOIN m ON m.centre = e.centre AND m.rn = 1 WHERE e.rn = 1 AND NOT m.particulates""",
)
def _(t: Tables):
    centres = sites(t.nation, "n_nationkey").toDF("centre", "clat", "clon")
    near = J.sites_near(centres, sites(t.supplier, "s_suppkey").withColumnRenamed("id", "site"), 400_000)
    pairs = near.select(
        "centre",
        "site",
        "distance_m",
        (F.col("site") % 5 != 0).alias("fresh"),
        (F.col("site") % 7 != 0).alias("measures"),
        (F.col("site") % 3 == 0).alias("particulates"),
    )
    return J.pick_station(pairs, 250_000)


@query(
    "d22_covering_polygons",
    """WITH p AS (SELECT c_custkey AS point, 14.005::DOUBLE + (c_custkey * 37 % 1900) / 100.0::DOUBLE AS lat, -117.995::DOUBLE + (c_custkey * 53 % 3200) / 100.0::DOUBLE AS lon FROM customer),
            a AS (SELECT s_suppkey AS polygon, 14 + (s_suppkey * 37 % 1900) / 100.0::DOUBLE AS y, -118 + (s_suppkey * 53 % 3200) / 100.0::DOUBLE AS x FROM supplier)
       SELECT point, polygon FROM p JOIN a ON lon > x AND lon < x + 2 AND lat > y AND lat < y + 1.5""",
)
def _(t: Tables):
    points = t.customer.select(
        F.col("c_custkey").alias("point"),
        (F.lit(14.005) + (F.col("c_custkey") * 37 % 1900) / F.lit(100.0)).alias("lat"),
        (F.lit(-117.995) + (F.col("c_custkey") * 53 % 3200) / F.lit(100.0)).alias("lon"),
    )
    corner = sites(t.supplier, "s_suppkey")

    def at(dx, dy):
        return F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))

    rings = corner.select(F.col("id").alias("polygon"), F.array(at(0, 0), at(2, 0), at(2, 1.5), at(0, 1.5)).alias("ring"))
    return J.covering_polygons(points, rings).select("point", "polygon")
