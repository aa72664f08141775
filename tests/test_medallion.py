from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from mendwell.functions.scalars import to_int
from mendwell.operators import medallion

TRIPS = (
    "tpep_pickup_datetime TIMESTAMP_NTZ, tpep_dropoff_datetime TIMESTAMP_NTZ, VendorID BIGINT, passenger_count DOUBLE,"
    "trip_distance DOUBLE, PULocationID BIGINT, DOLocationID BIGINT, payment_type BIGINT, fare_amount DOUBLE,"
    "tip_amount DOUBLE, total_amount DOUBLE, year INT, month INT"
)
WEATHER = (
    "date DATE, temperature_2m_max DOUBLE, temperature_2m_min DOUBLE, temperature_2m_mean DOUBLE,"
    "precipitation_sum DOUBLE, rain_sum DOUBLE, snowfall_sum DOUBLE, wind_speed_10m_max DOUBLE,"
    "wind_gusts_10m_max DOUBLE"
)


def trip(pickup, *, zone=1, passengers=1.0, distance=2.0, tip=1.0, total=10.0, dropoff=True, month=1):
    end = datetime(2024, 1, 31) if dropoff else None
    return (pickup, end, 1, passengers, distance, zone, 2, 1, 8.0, tip, total, 2024, month)


@pytest.fixture
def bronze(spark):
    rows = [
        trip(datetime(2024, 1, 1, 10), passengers=1.5),
        trip(datetime(2024, 1, 1, 11), passengers=2.5, tip=None),
        trip(datetime(2024, 1, 1, 12), zone=None, passengers=None, tip=0.0),
        trip(datetime(2024, 1, 2, 12), total=20.0),
        trip(datetime(2070, 1, 1)),  # right month, wrong year
        trip(datetime(2024, 2, 1)),  # wrong month
        trip(None),
        trip(datetime(2024, 1, 3), dropoff=False),
    ]
    return spark.createDataFrame(rows, TRIPS)


@pytest.fixture
def weather(spark):
    return medallion.stage_weather(spark.createDataFrame([(date(2024, 1, 1), 5.0, 1.0, 3.0, 0.5, 0.0, 0.0, 9.0, 12.0)], WEATHER))


def test_staging_guards(bronze):
    staged = medallion.stage_trips(bronze)
    assert len(staged.columns) == 13
    assert staged.count() == 4


def test_integer_cast_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(1.5,), (2.5,), (-1.7,), (None,)], "x DOUBLE")
    assert [r.x for r in df.select(to_int(F.col("x")).alias("x")).collect()] == [2, 2, -2, None]


def test_trips_weather_keeps_every_trip(bronze, weather):
    joined = medallion.trips_weather(medallion.stage_trips(bronze), weather)
    assert len(joined.columns) == 20
    by_day = {r.pickup_ts: r.temp_max_c for r in joined.collect()}
    assert by_day[datetime(2024, 1, 1, 10)] == 5.0
    assert by_day[datetime(2024, 1, 2, 12)] is None


def test_daily_rules(bronze, weather):
    silver = medallion.trips_weather(medallion.stage_trips(bronze), weather)
    rows = {(r.pickup_date, r.pickup_zone_id): r for r in medallion.trips_daily(silver).collect()}
    first = rows[date(2024, 1, 1), 1]
    assert (first.trip_count, first.passengers, first.tip_rate) == (2, 4, 0.5)  # a null tip is no tip
    unknown = rows[date(2024, 1, 1), None]  # a null zone is a group
    assert (unknown.trip_count, unknown.passengers, unknown.tip_rate) == (1, None, 0.0)
    assert rows[date(2024, 1, 2), 1].temp_max_c is None


def test_early_aggregation_gives_the_same_table(bronze, weather):
    trips = medallion.stage_trips(bronze)
    # A date with two weather rows repeats its trips in the join.
    for w in (weather, weather.unionByName(weather.withColumn("temp_max_c", F.lit(7.0)))):
        late = medallion.trips_daily(medallion.trips_weather(trips, w))
        early = medallion.trips_daily_from_staging(trips, w)
        assert sorted(map(str, late.collect())) == sorted(map(str, early.collect()))


def test_interim_join_of_vintages(spark):
    new = spark.createDataFrame(
        [("2024-01-01 10:00:00", 10.5), ("2024-01-02 11:30:00", 12.0), ("not a date", 1.0)],
        "tpep_pickup_datetime STRING, fare_amount DOUBLE",
    )
    old = spark.createDataFrame([("2024-01-02 12:00:00",)], "pickup_datetime STRING")
    weather = spark.createDataFrame(
        [(date(2024, 1, 1), 5.0), (date(2024, 1, 2), 7.0)], "date DATE, temperature_2m_max DOUBLE"
    )
    joined = medallion.interim_trips_weather([new, old], weather)
    rows = {r.pickup_ts: (r.fare_amount, r.temperature_2m_max) for r in joined.collect()}
    assert rows == {
        datetime(2024, 1, 1, 10): (10.5, 5.0),
        datetime(2024, 1, 2, 11, 30): (12.0, 7.0),
        datetime(2024, 1, 2, 12): (None, 7.0),
    }
    assert "date" not in joined.columns


def test_alias_needs_a_candidate(spark):
    with pytest.raises(ValueError):
        medallion.resolve_alias([spark.range(1)], medallion.PICKUP_ALIASES, "pickup_ts")


def test_staging_pushes_filters_and_prunes_columns(spark, plan, tmp_path, bronze):
    bronze.write.parquet(str(tmp_path / "t"))
    staged = medallion.stage_trips(spark.read.parquet(str(tmp_path / "t")))
    text = plan(staged.groupBy("pickup_zone_id").count())
    assert "IsNotNull(tpep_pickup_datetime)" in text
    assert "fare_amount" not in text


def test_weather_join_is_broadcast(plan, bronze, weather):
    text = plan(medallion.trips_weather(medallion.stage_trips(bronze), weather))
    assert "BroadcastHashJoin" in text and "LeftOuter" in text
