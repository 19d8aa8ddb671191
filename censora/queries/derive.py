"""Feeds derived from the driver's tables, in Spark and (as CTEs) in SQL: hourly readings, air hours, daily extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censora.functions.scalars import cents, json_field, round_half_up
from censora.operators.calendar import hour_number
from censora.queries import Tables

READINGS_SQL = """hours AS (SELECT event_type AS station, date_trunc('hour', ts) AS instant, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS c,
         sum(json_extract_string(props, '$.k')::INTEGER)::BIGINT AS k FROM events GROUP BY 1, 2),
     warm AS (SELECT *, CASE WHEN k % 29 <> 0 THEN floor(c / (n * 800) * 10 + 0.5 + 1e-9) / 10 END AS temp_c FROM hours),
     readings AS (SELECT station, instant, temp_c, temp_c - (k % 12) / 2 + 1 AS dew_c, (k % 104)::DOUBLE AS humidity_pct, (1000 + k % 90)::DOUBLE AS pressure_hpa,
         (k % 80)::DOUBLE AS wind_ms, (k * 7 % 365)::DOUBLE AS wind_dir, (k % 50) / 2 AS delay_min, k FROM warm)"""


def readings(t: Tables) -> DataFrame:
    hours = t.events.groupBy(F.col("event_type").alias("station"), F.date_trunc("hour", "ts").alias("instant")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cents("value")).alias("c"),
        F.sum(json_field("props", "k", "int")).alias("k"),
    )
    k = F.col("k")
    temp = F.when(k % 29 != 0, round_half_up(F.col("c") / (F.col("n") * 800), 1))
    return hours.withColumn("temp_c", temp).select(
        "station",
        F.col("instant").cast("timestamp_ntz").alias("instant"),
        "temp_c",
        (F.col("temp_c") - (k % 12) / 2 + 1).alias("dew_c"),
        (k % 104).cast("double").alias("humidity_pct"),
        (k % 90 + 1000).cast("double").alias("pressure_hpa"),
        (k % 80).cast("double").alias("wind_ms"),
        (k * 7 % 365).cast("double").alias("wind_dir"),
        ((k % 50) / 2).alias("delay_min"),
        "k",
    )


RECORDS_SQL = """records AS (SELECT event_type AS station, m.month, 2.0::DOUBLE AS record_low, (8 + length(event_type))::DOUBLE AS record_high
         FROM (SELECT DISTINCT event_type FROM events), (SELECT i::INTEGER AS month FROM range(1, 13) r(i)) m)"""


def records(t: Tables) -> DataFrame:
    stations = t.events.select(F.col("event_type").alias("station")).distinct()
    return stations.select(
        "station",
        F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"),
        F.lit(2.0).alias("record_low"),
        (F.length("station") + 8).cast("double").alias("record_high"),
    )


AIR_SQL = """air AS (SELECT user_id % 3 AS station, CASE event_type WHEN 'error' THEN 'PM2.5' WHEN 'click' THEN 'PM10' WHEN 'view' THEN 'O3' WHEN 'signup' THEN 'NO2' ELSE 'CO' END AS pollutant,
         (epoch_us(ts) // 3600000000)::BIGINT AS hour, sum(round(value * 100)::BIGINT)::BIGINT AS c, count(*) AS n FROM events GROUP BY 1, 2, 3),
     air_hours AS (SELECT station, pollutant, hour, CASE WHEN pollutant IN ('O3', 'NO2') THEN c / (n * 100000) WHEN pollutant = 'CO' THEN c / (n * 1000) ELSE c / (n * 100) END AS value FROM air)"""


def air_hours(t: Tables) -> DataFrame:
    event = F.col("event_type")
    pollutant = (
        F.when(event == "error", "PM2.5").when(event == "click", "PM10").when(event == "view", "O3").when(event == "signup", "NO2")
    ).otherwise("CO")
    hourly = t.events.groupBy(
        (F.col("user_id") % 3).alias("station"), pollutant.alias("pollutant"), hour_number("ts").alias("hour")
    ).agg(F.sum(cents("value")).alias("c"), F.count(F.lit(1)).alias("n"))
    scale = F.when(F.col("pollutant").isin("O3", "NO2"), 100_000).when(F.col("pollutant") == "CO", 1_000).otherwise(100)
    return hourly.select("station", "pollutant", "hour", (F.col("c") / (F.col("n") * scale)).alias("value"))


DAILY_SQL = """daily AS (SELECT o_orderpriority AS station, o_orderdate::DATE AS day, floor(max(o_totalprice) / 12500 * 10 + 0.5 + 1e-9) / 10 AS tmax,
         CASE WHEN dayofyear(o_orderdate) % 17 <> 0 THEN floor(min(o_totalprice) / 25000 * 10 + 0.5 + 1e-9) / 10 - 5 END AS tmin FROM orders GROUP BY 1, 2, dayofyear(o_orderdate))"""


def daily(t: Tables) -> DataFrame:
    days = t.orders.groupBy(F.col("o_orderpriority").alias("station"), F.to_date("o_orderdate").alias("day")).agg(
        F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low")
    )
    return days.select(
        "station",
        "day",
        round_half_up(F.col("high") / 12500, 1).alias("tmax"),
        F.when(F.dayofyear("day") % 17 != 0, round_half_up(F.col("low") / 25000, 1) - 5).alias("tmin"),
    )
