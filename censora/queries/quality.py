"""Verification and data quality (K) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from censora.functions.scalars import cents, zero_pad
from censora.operators import quality as Q
from censora.operators.calendar import slots
from censora.plans import climate, pulse
from censora.queries import Tables, query
from censora.queries import derive as D
from censora.queries.pulse import EV_SQL, summaries
from censora.queries.windows import STEPS_SQL, WITNESS_SQL, witness_pairs

MEANS_SQL = """calc AS (SELECT c_nationkey AS geo, sum(round(c_acctbal * 100)::BIGINT)::BIGINT / (100 * count(*)) AS value FROM customer WHERE c_nationkey <> 4 GROUP BY 1),
     pub AS (SELECT c_nationkey AS geo, format('{:.1f}', sum(round(c_acctbal * 100)::BIGINT)::BIGINT / (100 * count(*)) + CASE WHEN c_nationkey % 6 = 1 THEN 0.2 ELSE 0 END) AS published FROM customer WHERE c_nationkey <> 9 GROUP BY 1),
     rec AS (SELECT geo, value, published, published::DOUBLE AS official, value - published::DOUBLE AS delta, 100 * (value - published::DOUBLE) / published::DOUBLE AS delta_pct,
         CASE WHEN published IS NULL THEN 'only_calculated' WHEN value IS NULL THEN 'only_official' WHEN abs(value - published::DOUBLE) <= 0.05 + 1e-9 THEN 'equal' ELSE 'different' END AS status FROM calc FULL JOIN pub USING (geo))"""


def reconciliation(t: Tables):
    mean = F.sum(cents("c_acctbal")) / (F.count(F.lit(1)) * 100)
    means = t.customer.groupBy(F.col("c_nationkey").alias("geo")).agg(mean.alias("value"))
    shifted = F.col("value") + F.when(F.col("geo") % 6 == 1, 0.2).otherwise(0.0)
    official = means.where("geo <> 9").select("geo", F.format_string("%.1f", shifted).alias("published"))
    return Q.reconcile(means.where("geo <> 4"), official, ["geo"], Q.published_tolerance(F.col("published")))


@query("k1_reconcile", f"WITH {MEANS_SQL} SELECT * FROM rec")
def _(t: Tables):
    return reconciliation(t)


@query(
    "k1_reconcile_summary",
    f"""WITH {MEANS_SQL} SELECT count(*) FILTER (status = 'equal') AS equal, count(*) FILTER (status = 'different') AS different, count(*) FILTER (status = 'only_calculated') AS only_calculated,
            count(*) FILTER (status = 'only_official') AS only_official, max(abs(delta)) AS worst_delta FROM rec""",
)
def _(t: Tables):
    return Q.reconcile_summary(reconciliation(t))


def _profile_sql(where: str) -> str:
    return f"""SELECT '*' AS "column", 'count' AS metric, count(*)::VARCHAR AS value FROM orders {where} UNION ALL SELECT 'o_orderkey', 'sum', sum(o_orderkey::DECIMAL(28, 4))::VARCHAR FROM orders {where}
        UNION ALL SELECT 'o_custkey', 'sum', sum(o_custkey::DECIMAL(28, 4))::VARCHAR FROM orders {where} UNION ALL SELECT 'o_orderstatus', 'distinct', count(DISTINCT o_orderstatus)::VARCHAR FROM orders {where}
        UNION ALL SELECT 'o_totalprice', 'sum', sum(o_totalprice::DECIMAL(28, 4))::VARCHAR FROM orders {where} UNION ALL SELECT 'o_orderdate', 'range', min(o_orderdate)::VARCHAR || '|' || max(o_orderdate)::VARCHAR FROM orders {where}
        UNION ALL SELECT 'o_orderpriority', 'distinct', count(DISTINCT o_orderpriority)::VARCHAR FROM orders {where}"""


@query("k2_fidelity_profile", _profile_sql(""))
def _(t: Tables):
    return Q.fidelity_profile(t.orders)


@query(
    "k2_compare_profiles",
    f"""WITH a AS ({_profile_sql("")}), b AS ({_profile_sql("WHERE o_orderstatus <> 'P'")}) SELECT a."column", a.metric, a.value AS old, b.value AS new, a.value = b.value AS same FROM a JOIN b ON a."column" = b."column" AND a.metric = b.metric""",
)
def _(t: Tables):
    return Q.compare_profiles(Q.fidelity_profile(t.orders), Q.fidelity_profile(t.orders.where("o_orderstatus <> 'P'")))


@query(
    "k3_sum_check",
    """WITH p AS (SELECT sum(n)::BIGINT AS parts FROM (SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)), w AS (SELECT count(*) AS whole FROM orders)
       SELECT parts, whole, parts - whole AS delta, abs(parts - whole) <= 0 AS adds_up FROM p, w""",
)
def _(t: Tables):
    states = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return Q.sum_check(states, F.sum("n"), t.orders, F.count(F.lit(1)))


@query(
    "k4_bounds_check",
    """WITH c AS (SELECT c_mktsegment AS scope, sum(round(c_acctbal * 100)::BIGINT)::BIGINT / (100 * count(*)) AS value FROM customer GROUP BY 1),
            b AS (SELECT c_mktsegment AS scope, 4500.0::DOUBLE + length(c_mktsegment) AS official, 0.02::DOUBLE AS tolerance FROM customer GROUP BY 1)
       SELECT scope, official, tolerance, value, (value - official) / official * 100 AS delta_pct, abs((value - official) / official) <= tolerance AS passing FROM b LEFT JOIN c USING (scope)""",
)
def _(t: Tables):
    segments = t.customer.groupBy(F.col("c_mktsegment").alias("scope"))
    calculated = segments.agg((F.sum(cents("c_acctbal")) / (F.count(F.lit(1)) * 100)).alias("value"))
    bounds = calculated.select("scope", (F.lit(4500.0) + F.length("scope")).alias("official"), F.lit(0.02).alias("tolerance"))
    return Q.bounds_check(calculated, bounds, ["scope"])


@query(
    "k5_store_reconcile",
    """WITH r AS (SELECT DISTINCT o_custkey AS object, o_custkey % 97 AS bytes FROM orders WHERE o_orderstatus = 'P'), l AS (SELECT c_custkey AS object, CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE c_custkey % 97 END AS size FROM customer WHERE c_custkey % 5 <> 0)
       SELECT object, bytes, size, CASE WHEN size IS NULL THEN 'missing' WHEN bytes IS NULL THEN 'unreferenced' ELSE 'size_differs' END AS finding FROM r FULL JOIN l USING (object) WHERE size IS NULL OR bytes IS NULL OR bytes <> size""",
)
def _(t: Tables):
    referenced = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("object")).distinct()
    referenced = referenced.withColumn("bytes", F.col("object") % 97)
    listing = t.customer.where("c_custkey % 5 <> 0").select(
        F.col("c_custkey").alias("object"), F.when(F.col("c_custkey") % 13 == 0, 1).otherwise(F.col("c_custkey") % 97).alias("size")
    )
    return Q.store_reconcile(referenced, listing)


@query(
    "k6_row_compare",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 50 <> 7), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 30 = 1 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
              o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 0.00001 WHEN o_orderkey % 7 = 0 THEN 0.01 ELSE 0 END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 40 <> 3),
            j AS (SELECT o.o_orderkey AS a, n.o_orderkey AS b, o.o_orderstatus AS s1, n.o_orderstatus AS s2, o.o_totalprice AS t1, n.o_totalprice AS t2, o.o_orderpriority AS p1, n.o_orderpriority AS p2 FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey),
            c AS (SELECT count(*) FILTER (b IS NULL) AS only_old, count(*) FILTER (a IS NULL) AS only_new, count(*) FILTER (a = b AND s1 IS DISTINCT FROM s2) AS o_orderstatus, count(*) FILTER (a = b AND t1 IS DISTINCT FROM t2 AND NOT abs(t1 - t2) < 0.0001) AS o_totalprice,
                  count(*) FILTER (a = b AND p1 IS DISTINCT FROM p2) AS o_orderpriority FROM j)
       SELECT "column", differences FROM c UNPIVOT (differences FOR "column" IN (only_old, only_new, o_orderstatus, o_totalprice, o_orderpriority))""",
)
def _(t: Tables):
    key = F.col("o_orderkey")
    old = t.orders.where(key % 50 != 7)
    drift = F.when(key % 3 == 0, 0.00001).when(key % 7 == 0, 0.01).otherwise(0.0)
    new = t.orders.where(key % 40 != 3).select(
        "o_orderkey",
        F.when(key % 30 != 1, F.col("o_orderstatus")).alias("o_orderstatus"),
        (F.col("o_totalprice") + drift).alias("o_totalprice"),
        "o_orderpriority",
    )
    return Q.row_compare(old, new, ["o_orderkey"], ["o_orderstatus", "o_totalprice", "o_orderpriority"], {"o_totalprice": 1e-4})


REPORTED_SQL = """rep AS (SELECT event_id, event_type AS system, 'd' || (user_id % 5) AS datum, date_trunc('minute', ts) AS minute, CASE WHEN event_id % 11 = 0 THEN 0 ELSE (event_id % 4)::INTEGER END AS refreshes, ts AS first,
         ts + to_milliseconds((event_id % 90) * 1000) AS last, ((event_id % 90) * 1000 // greatest(event_id % 3, 1))::BIGINT AS max_gap_ms, event_id % 6 - 1 AS observations, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS events,
         CASE WHEN event_id % 10 = 0 THEN 200 END AS src, CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS deliveries, CASE WHEN event_id % 14 = 0 THEN 300 END AS dlv, ts + to_milliseconds((value * 1000)::BIGINT * 300) AS received, epoch_us(ts) // 21600000000 AS report FROM events),
     known AS (SELECT DISTINCT event_type AS system, 'd' || (user_id % 4) AS datum, CASE WHEN event_type = 'purchase' THEN 'push' ELSE 'poll' END AS via FROM events),
     r AS (SELECT rep.*, via, minute + INTERVAL 1 MINUTE AS fin, (epoch_us(last) // 1000 - epoch_us(first) // 1000) AS span FROM rep LEFT JOIN known USING (system, datum))"""


def reported(t: Tables):
    """Minute summaries as systems might report them, some of them inconsistent."""
    event, at = F.col("event_id"), F.col("ts").cast("timestamp")
    step = event % 90
    return t.events.select(
        "event_id",
        F.col("event_type").alias("system"),
        F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("datum"),
        F.date_trunc("minute", at).alias("minute"),
        F.when(event % 11 == 0, 0).otherwise((event % 4).cast("int")).alias("refreshes"),
        at.alias("first"),
        (at + F.make_dt_interval(secs=step)).alias("last"),
        F.floor(step * 1000 / F.greatest(event % 3, F.lit(1))).alias("max_gap_ms"),
        (event % 6 - 1).alias("observations"),
        F.when(event % 5 == 0, 1).otherwise(0).alias("events"),
        F.when(event % 10 == 0, 200).alias("source_latency_max_ms"),
        F.when(event % 7 == 0, 2).otherwise(0).alias("deliveries"),
        F.when(event % 14 == 0, 300).alias("delivery_latency_max_ms"),
        F.timestamp_micros(F.unix_micros(at) + F.round(F.col("value") * 1000).cast("bigint") * 300_000).alias("received"),
    )


def known_data(t: Tables, modulus: int = 4):
    rows = t.events.select(
        F.col("event_type").alias("system"), F.concat(F.lit("d"), (F.col("user_id") % modulus).cast("string")).alias("datum")
    ).distinct()
    return rows.withColumn("via", F.when(F.col("system") == "purchase", "push").otherwise("poll"))


@query(
    "k7_intake_rules",
    f"""WITH {REPORTED_SQL} SELECT event_id, concat_ws(',', CASE WHEN via IS NULL THEN 'unknown-datum' END, CASE WHEN received > fin + INTERVAL 24 HOUR THEN 'too-old' END, CASE WHEN times > 1 THEN 'minute-repeated' END,
            CASE WHEN last >= fin THEN 'last-outside-minute' END, CASE WHEN observations < 0 THEN 'negative-count' END, CASE WHEN refreshes = 0 AND deliveries = 0 THEN 'empty-summary' END, CASE WHEN refreshes = 0 AND via <> 'push' THEN 'no-refresh-outside-delivery' END,
            CASE WHEN refreshes = 1 AND span <> 0 THEN 'single-with-span' END, CASE WHEN refreshes <= 1 AND max_gap_ms <> 0 THEN 'gap-without-pair' END, CASE WHEN refreshes > 1 AND max_gap_ms > span THEN 'gap-exceeds-span' END,
            CASE WHEN refreshes > 1 AND max_gap_ms * (refreshes - 1) < span THEN 'gap-below-mean' END, CASE WHEN events > 0 AND src IS NULL THEN 'events-without-latency' END, CASE WHEN deliveries > 0 AND dlv IS NULL THEN 'deliveries-without-latency' END) AS faults
        FROM (SELECT *, count(*) OVER (PARTITION BY system, report, datum, minute) AS times FROM r)""",
)
def _(t: Tables):
    # A report is a quarter of a day of a system, so some of them name a minute of a datum twice.
    rows = reported(t).withColumn("report", F.floor(F.unix_seconds("first") / 21_600))
    checked = pulse.intake_rules(rows, known_data(t))
    return checked.select("event_id", F.concat_ws(",", "faults").alias("faults"))


MARKS_SQL = f"""{STEPS_SQL}, {D.RECORDS_SQL}, mk AS (SELECT s.station, s.instant, concat_ws(',', CASE WHEN temp_c IS NULL THEN 'sin-temperatura' END, CASE WHEN temp_c NOT BETWEEN record_low AND record_high THEN 'fuera-de-record' END,
         CASE WHEN dew_c > temp_c + 0.5 THEN 'rocio-mayor' WHEN abs(100 * exp(17.62 * dew_c / (243.12 + dew_c) - 17.62 * temp_c / (243.12 + temp_c)) - humidity_pct) > 8 THEN 'humedad-incongruente' END,
         CASE WHEN humidity_pct NOT BETWEEN 1 AND 100 THEN 'humedad-fuera-de-rango' END, CASE WHEN pressure_hpa NOT BETWEEN 870 AND 1085 THEN 'presion-fuera-de-rango' END, CASE WHEN wind_ms NOT BETWEEN 0 AND 75 THEN 'viento-fuera-de-rango' END,
         CASE WHEN wind_dir NOT BETWEEN 0 AND 360 THEN 'direccion-fuera-de-rango' END, nullif(step_marks, '')) AS marks FROM steps s LEFT JOIN records r ON r.station = s.station AND r.month = month(s.instant - INTERVAL 6 HOUR))"""


@query("k8_observation_marks", f"WITH {MARKS_SQL} SELECT * FROM mk")
def _(t: Tables):
    rows = climate.observation_marks(D.readings(t), D.records(t))
    return rows.select("station", "instant", F.concat_ws(",", "marks").alias("marks"))


@query("k9_witness_check", f"WITH {WITNESS_SQL} SELECT station, instant, diff, typical, tolerance, abs(diff - typical) > tolerance AS differs FROM wit")
def _(t: Tables):
    return climate.witness_check(witness_pairs(t)).drop("compared")


COMPLETE_SQL = f"""{D.READINGS_SQL}, span AS (SELECT min(instant) AS lo, max(instant) AS hi FROM readings), cal AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM span),
     slots AS (SELECT s.station, c.hour, hour(c.hour - INTERVAL 6 HOUR) AS local_hour, r.station IS NOT NULL AS arrived, coalesce(r.k % 10 = 0, false) AS marked, r.delay_min, c.hour IN (SELECT instant FROM readings WHERE k % 7 <> 0) OR r.station IS NOT NULL AS watched
         FROM (SELECT DISTINCT station FROM readings) s CROSS JOIN cal c LEFT JOIN readings r ON r.station = s.station AND r.instant = c.hour),
     w AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY hour) - row_number() OVER (PARTITION BY station, arrived ORDER BY hour) AS run FROM slots WHERE watched),
     rl AS (SELECT station, arrived, run, count(*) AS len, max(hour) AS last FROM w GROUP BY 1, 2, 3), st AS (SELECT station, max(CASE WHEN arrived THEN 0 ELSE len END) AS worst_run, arg_max(CASE WHEN arrived THEN 0 ELSE len END, last) AS current_run FROM rl GROUP BY 1),
     dl AS (SELECT station, delay_min AS v, row_number() OVER (PARTITION BY station ORDER BY delay_min) - 1 AS rn, count(*) OVER (PARTITION BY station) AS n FROM w WHERE delay_min IS NOT NULL),
     md AS (SELECT station, (max(v) FILTER (rn = (n - 1) // 2) + max(v) FILTER (rn = n // 2)) / 2 AS median_delay_min FROM dl GROUP BY 1)"""


@query(
    "k10_completeness",
    f"""WITH {COMPLETE_SQL}, c AS (SELECT station, count(*) FILTER (watched) AS watched, count(*) FILTER (watched AND arrived) AS arrived, count(*) FILTER (marked) AS marked, count(*) FILTER (watched AND NOT arrived) AS missing, max(CASE WHEN arrived THEN hour END) AS last_reading,
             count(*) FILTER (watched AND local_hour < 6) AS watched_00, count(*) FILTER (watched AND local_hour BETWEEN 6 AND 11) AS watched_06, count(*) FILTER (watched AND local_hour BETWEEN 12 AND 17) AS watched_12, count(*) FILTER (watched AND local_hour >= 18) AS watched_18,
             100 * count(*) FILTER (arrived AND delay_min > 20) / count(*) FILTER (arrived AND delay_min IS NOT NULL) AS second_batch_pct, count(*) FILTER (watched AND NOT arrived AND local_hour < 6) AS missing_00, count(*) FILTER (watched AND NOT arrived AND local_hour BETWEEN 6 AND 11) AS missing_06, count(*) FILTER (watched AND NOT arrived AND local_hour BETWEEN 12 AND 17) AS missing_12,
             count(*) FILTER (watched AND NOT arrived AND local_hour >= 18) AS missing_18, string_agg(CASE WHEN NOT watched THEN '·' WHEN marked THEN 'M' WHEN arrived THEN 'L' ELSE 'F' END, '' ORDER BY hour) AS strip FROM slots GROUP BY 1)
        SELECT c.*, 100 * missing_00 / watched_00 AS missing_00_pct, 100 * missing_06 / watched_06 AS missing_06_pct, 100 * missing_12 / watched_12 AS missing_12_pct, 100 * missing_18 / watched_18 AS missing_18_pct,
               worst_run, current_run, median_delay_min, 100 * arrived / watched AS arrived_pct FROM c JOIN st USING (station) LEFT JOIN md USING (station)""",
)
def _(t: Tables):
    return climate.completeness(watched_hours(t)).withColumn("last_reading", F.col("last_reading").cast("timestamp_ntz"))


def watched_hours(t: Tables):
    rows = D.readings(t).withColumn("hour", F.col("instant").cast("timestamp"))
    span = rows.agg(F.struct(F.min("hour").alias("lo"), F.max("hour").alias("hi")).alias("s")).scalar()
    grid = rows.select("station").distinct().withColumn("hour", slots(span["lo"], span["hi"], "1 HOUR"))
    batches = rows.where("k % 7 <> 0").select("hour").distinct().withColumn("batch", F.lit(True))
    joined = grid.join(rows.select("station", "hour", "k", "delay_min"), ["station", "hour"], "left").join(batches, "hour", "left")
    arrived = F.col("k").isNotNull()
    return joined.select(
        "station",
        "hour",
        F.hour(F.from_utc_timestamp("hour", "-06:00")).alias("local_hour"),
        (F.coalesce("batch", F.lit(False)) | arrived).alias("watched"),
        arrived.alias("arrived"),
        F.coalesce(F.col("k") % 10 == 0, F.lit(False)).alias("marked"),
        "delay_min",
    )


@query(
    "k10_national_completeness",
    f"""WITH {COMPLETE_SQL}, h AS (SELECT hour, count(*) AS w, count(*) FILTER (arrived) AS a FROM slots WHERE watched GROUP BY 1)
        SELECT sum(w)::BIGINT AS watched, sum(a)::BIGINT AS arrived, count(*) AS hours, count(*) FILTER (w = a) AS complete_hours, 100 * sum(a)::BIGINT / sum(w)::BIGINT AS arrived_pct FROM h""",
)
def _(t: Tables):
    return climate.national_completeness(watched_hours(t))


@query(
    "k11_pulse_audit",
    """WITH a AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1), b AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1)
       SELECT CASE WHEN b.n IS NULL THEN 'only_log' WHEN a.n IS NULL THEN 'only_pulse' WHEN a.n = b.n THEN 'equal' ELSE 'different' END AS verdict, count(*) AS minutes FROM a FULL JOIN b USING (minute) GROUP BY 1""",
)
def _(t: Tables):
    def log(df):
        return df.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("n"))

    return pulse.audit(log(t.events.where("event_type <> 'error'")), log(t.events.where("event_type <> 'click'")), ["n"])


@query(
    "k11_punctual_share",
    f"WITH {EV_SQL} SELECT system, count(*) AS minutes, count(*) FILTER (on_time = 1) AS punctual, 100 * count(*) FILTER (on_time = 1) / count(*) AS punctual_pct FROM summ GROUP BY 1",
)
def _(t: Tables):
    return pulse.punctual_share(summaries(t))


@query(
    "k12_key_and_domain",
    """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS copies, sum(CASE WHEN l_suppkey % 40 + 1 > 32 THEN 1 ELSE 0 END) AS bad FROM lineitem GROUP BY 1, 2)
       SELECT sum(copies)::BIGINT AS rows, count(*) AS keys, max(copies) AS most_copies, 0::BIGINT AS null_keys, sum(bad)::BIGINT AS bad_ent FROM k""",
)
def _(t: Tables):
    rows = t.lineitem.withColumn("ent", zero_pad(F.col("l_suppkey") % 40 + 1, 2))
    return Q.key_check(rows, ["l_orderkey", "l_linenumber"], {"ent": Q.STATE_CODE})


@query(
    "k13_seen_versus_reported",
    """WITH s AS (SELECT user_id, CASE WHEN user_id % 7 > 1 THEN max(ts) END AS last, CASE WHEN user_id % 7 = 0 THEN 0 WHEN user_id % 7 > 1 THEN count(*) END AS n FROM events WHERE event_type <> 'error' GROUP BY 1), r AS (SELECT user_id, max(ts) AS last, count(*) AS n FROM events WHERE event_id % 9 <> 0 AND user_id % 14 <> 0 GROUP BY 1)
       SELECT user_id, s.last AS seen_last, s.n AS seen_n, r.last AS reported_last, r.n AS reported_n, greatest(2, ceil(0.2::DOUBLE * greatest(s.n, coalesce(r.n, 0))))::BIGINT AS margin,
              CASE WHEN s.n IS NULL THEN 'sin-respuesta' WHEN s.last IS NULL AND s.n = 0 THEN CASE WHEN r.n IS NULL THEN 'coincide' ELSE 'no-coincide' END
                   WHEN coalesce(abs(epoch_us(s.last) // 1000 - epoch_us(r.last) // 1000) <= 300000 AND abs(s.n - coalesce(r.n, 0)) <= greatest(2, ceil(0.2::DOUBLE * greatest(s.n, coalesce(r.n, 0)))), false) THEN 'coincide' ELSE 'no-coincide' END AS result FROM s LEFT JOIN r USING (user_id)""",
)
def _(t: Tables):
    def face(df):
        return df.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last"), F.count(F.lit(1)).alias("n"))

    # Some faces say that they saw nothing, some do not answer at all.
    part = F.col("user_id") % 7
    seen = face(t.events.where("event_type <> 'error'"))
    seen = seen.withColumn("last", F.when(part > 1, F.col("last"))).withColumn("n", F.when(part == 0, 0).when(part > 1, F.col("n")))
    rows = pulse.seen_versus_reported(seen, face(t.events.where("event_id % 9 <> 0 and user_id % 14 <> 0")), ["user_id"])
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("seen_last", "reported_last")})


@query(
    "k14_review_states",
    """WITH v AS (SELECT o_custkey AS id, o_orderkey, o_orderdate, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
       SELECT c_custkey AS id, c_mktsegment AS dataset, CASE WHEN o_orderkey IS NULL THEN 'pendiente' WHEN o_orderstatus = 'F' THEN 'aceptada' WHEN o_orderstatus = 'O' THEN 'rechazada' ELSE 'en-revision' END AS state, o_orderdate AS reviewed_at FROM customer LEFT JOIN v ON id = c_custkey AND rn = 1""",
)
def _(t: Tables):
    reports = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("dataset"))
    state = F.when(F.col("o_orderstatus") == "F", "aceptada").when(F.col("o_orderstatus") == "O", "rechazada").otherwise("en-revision")
    reviews = t.orders.select(F.col("o_custkey").alias("id"), state.alias("state"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    states = Q.review_states(reports, reviews)
    return states.withColumn("reviewed_at", F.col("reviewed_at.o_orderdate"))


@query(
    "k15_constraint_check",
    """WITH k AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
       SELECT 'primary_key' AS "constraint", count(*) FILTER (c > 1) AS rows FROM k UNION ALL SELECT 'order_exists', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
       UNION ALL SELECT 'discount_is_share', count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.09)) FROM lineitem UNION ALL SELECT 'price_not_negative', count(*) FILTER (NOT l_extendedprice >= 0) FROM lineitem UNION ALL SELECT 'first_of_month', count(*) FILTER (NOT day(l_shipdate) = 1) FROM lineitem""",
)
def _(t: Tables):
    return Q.constraint_check(
        t.lineitem,
        ["l_orderkey", "l_linenumber"],
        {"order_exists": ("l_orderkey", t.orders.where("o_orderstatus <> 'P'"), "o_orderkey")},
        {
            "discount_is_share": F.col("l_discount").between(0, 0.09),
            "price_not_negative": F.col("l_extendedprice") >= 0,
            "first_of_month": F.dayofmonth("l_shipdate") == 1,
        },
    )


@query(
    "k16_cell_compare",
    """WITH p AS (SELECT o_orderkey, o_totalprice AS a, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey::DOUBLE END AS b FROM orders), q AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 0.0005 WHEN o_orderkey % 11 = 0 THEN 0.01 ELSE 0 END AS a, o_custkey::DOUBLE AS b FROM orders WHERE o_orderkey % 100 <> 1),
            j AS (SELECT p.a AS pa, p.b AS pb, q.o_orderkey IS NOT NULL AS here, q.a AS qa, q.b AS qb FROM p LEFT JOIN q USING (o_orderkey))
       SELECT 'a' AS variable, count(*) AS cells, count(*) FILTER (NOT here) AS missing, count(*) FILTER (here AND ((pa IS NULL) <> (qa IS NULL) OR abs(pa - qa) > 0.0006 + 1e-9 * abs(qa))) AS different FROM j
       UNION ALL SELECT 'b', count(*), count(*) FILTER (NOT here), count(*) FILTER (here AND ((pb IS NULL) <> (qb IS NULL) OR abs(pb - qb) > 0.0006 + 1e-9 * abs(qb))) FROM j""",
)
def _(t: Tables):
    key = F.col("o_orderkey")
    published = t.orders.select(
        key, F.col("o_totalprice").alias("a"), F.when(key % 9 != 0, F.col("o_custkey").cast("double")).alias("b")
    )
    drift = F.when(key % 10 == 0, 0.0005).when(key % 11 == 0, 0.01).otherwise(0.0)
    built = t.orders.where(key % 100 != 1).select(
        key, (F.col("o_totalprice") + drift).alias("a"), F.col("o_custkey").cast("double").alias("b")
    )
    return Q.cell_compare(published, built, ["o_orderkey"], ["a", "b"])
