"""Staging, trip and weather join, and the daily aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.functions.scalars import month_start, to_int
from mendwell.session import broadcast_if_small

# Pickup column names used by different vintages, preferred first.
PICKUP_ALIASES = ["tpep_pickup_datetime", "pickup_datetime"]

SILVER_WEATHER = [
    "temp_max_c",
    "temp_min_c",
    "temp_mean_c",
    "precipitation_mm",
    "snowfall_cm",
    "wind_speed_max_kmh",
]
GOLD_WEATHER = ["temp_max_c", "temp_min_c", "precipitation_mm", "snowfall_cm"]
GRAIN = ["pickup_date", "pickup_zone_id"]


def stage_trips(bronze: DataFrame) -> DataFrame:
    """Typed trips whose pickup falls into the month they were ingested for."""
    raw = bronze.filter(F.col("tpep_pickup_datetime").isNotNull() & F.col("tpep_dropoff_datetime").isNotNull())
    typed = raw.select(
        F.col("tpep_pickup_datetime").cast("timestamp_ntz").alias("pickup_ts"),
        F.col("tpep_dropoff_datetime").cast("timestamp_ntz").alias("dropoff_ts"),
        to_int(F.col("VendorID")).alias("vendor_id"),
        to_int(F.col("passenger_count")).alias("passenger_count"),
        F.col("trip_distance").cast("double").alias("trip_distance"),
        to_int(F.col("PULocationID")).alias("pickup_zone_id"),
        to_int(F.col("DOLocationID")).alias("dropoff_zone_id"),
        to_int(F.col("payment_type")).alias("payment_type"),
        *[F.col(c).cast("double").alias(c) for c in ("fare_amount", "tip_amount", "total_amount")],
        F.col("year").cast("int").alias("ingest_year"),
        F.col("month").cast("int").alias("ingest_month"),
    )
    # Dates on both sides: date_trunc would give a timestamp in the session zone.
    ingest_month = F.make_date("ingest_year", "ingest_month", F.lit(1))
    return typed.filter(month_start(F.col("pickup_ts")) == ingest_month)


def stage_weather(bronze: DataFrame) -> DataFrame:
    # Source and staged column names.
    renames = {
        "temperature_2m_max": "temp_max_c",
        "temperature_2m_min": "temp_min_c",
        "temperature_2m_mean": "temp_mean_c",
        "precipitation_sum": "precipitation_mm",
        "rain_sum": "rain_mm",
        "snowfall_sum": "snowfall_cm",
        "wind_speed_10m_max": "wind_speed_max_kmh",
        "wind_gusts_10m_max": "wind_gust_max_kmh",
    }
    values = [F.col(old).cast("double").alias(new) for old, new in renames.items()]
    return bronze.select(F.col("date").cast("date").alias("weather_date"), *values)


def dim_zones(seed: DataFrame) -> DataFrame:
    return seed.select(
        F.col("LocationID").cast("int").alias("zone_id"),
        F.col("Borough").cast("string").alias("borough"),
        F.col("Zone").cast("string").alias("zone_name"),
        F.col("service_zone").cast("string").alias("service_zone"),
    )


def trips_weather(trips: DataFrame, weather: DataFrame) -> DataFrame:
    """Every trip with the weather of its pickup date, nulls where there is none.

    One row per calendar day is small, but that is checked before it is sent to
    every executor.
    """
    daily = broadcast_if_small(weather.select("weather_date", *SILVER_WEATHER))
    dated = trips.withColumn("pickup_date", F.to_date("pickup_ts"))
    return dated.join(daily, dated.pickup_date == daily.weather_date, "left").drop("weather_date")


def _trip_measures() -> list[Column]:
    return [
        F.count("*").alias("trip_count"),
        F.sum("passenger_count").cast("bigint").alias("passengers"),
        F.avg("trip_distance").alias("avg_distance"),
        F.avg("total_amount").alias("avg_fare"),
        F.avg(F.when(F.col("tip_amount") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("tip_rate"),
    ]


def trips_daily(silver: DataFrame) -> DataFrame:
    """Daily trips per pickup zone, from the joined trip table."""
    return silver.groupBy(*GRAIN).agg(*_trip_measures(), *[F.max(c).alias(c) for c in GOLD_WEATHER])


def trips_daily_from_staging(trips: DataFrame, weather: DataFrame) -> DataFrame:
    """The same daily table, aggregating the trips before weather is attached.

    Weather depends on the date alone, so only one row per date and zone has to
    meet it and trip rows are never joined. Should a date have several weather
    rows, the join would repeat its trips: counts and sums are multiplied by
    that number, averages and maxima do not change.
    """
    dated = trips.withColumn("pickup_date", F.to_date("pickup_ts"))
    daily = dated.groupBy(*GRAIN).agg(*_trip_measures())
    per_date = weather.groupBy(F.col("weather_date").alias("pickup_date")).agg(
        F.count("*").alias("copies"), *[F.max(c).alias(c) for c in GOLD_WEATHER]
    )
    copies = F.coalesce(F.col("copies"), F.lit(1))
    return daily.join(per_date, "pickup_date", "left").select(
        *GRAIN,
        (F.col("trip_count") * copies).alias("trip_count"),
        (F.col("passengers") * copies).alias("passengers"),
        "avg_distance",
        "avg_fare",
        "tip_rate",
        *GOLD_WEATHER,
    )


def first_present(columns: list[str], candidates: list[str]) -> str:
    for name in candidates:
        if name in columns:
            return name
    raise ValueError(f"none of {candidates} in {columns}")


def resolve_alias(vintages: list[DataFrame], candidates: list[str], name: str) -> DataFrame:
    """Union vintages that spell a column differently into one column ``name``.

    Each vintage uses its first present candidate; a vintage without any fails.
    """
    united = None
    for df in vintages:
        renamed = df.withColumn(name, F.col(first_present(df.columns, candidates)))
        renamed = renamed.drop(*[c for c in candidates if c != name])
        united = renamed if united is None else united.unionByName(renamed, allowMissingColumns=True)
    return united


def interim_trips_weather(vintages: list[DataFrame], weather: DataFrame) -> DataFrame:
    """Leniently typed trips of several vintages with all weather columns of their day."""
    trips = resolve_alias(vintages, PICKUP_ALIASES, "pickup_ts")
    clean = trips.withColumn("pickup_ts", F.col("pickup_ts").try_cast("timestamp_ntz"))
    clean = clean.filter(F.col("pickup_ts").isNotNull()).withColumn("pickup_date", F.to_date("pickup_ts"))
    daily = broadcast_if_small(weather)
    return clean.join(daily, clean.pickup_date == daily.date, "left").drop("date")
