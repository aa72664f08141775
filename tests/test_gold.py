from __future__ import annotations

import os
from datetime import date, datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mendwell.operators import faults, gold, medallion, quality
from mendwell.sources import files

TRIPS = (
    "tpep_pickup_datetime TIMESTAMP_NTZ, tpep_dropoff_datetime TIMESTAMP_NTZ, VendorID LONG, passenger_count DOUBLE, trip_distance DOUBLE, PULocationID LONG, "
    "DOLocationID LONG, payment_type LONG, fare_amount DOUBLE, tip_amount DOUBLE, total_amount DOUBLE, year INT, month INT"
)
WEATHER = "date DATE, " + ", ".join(
    f"{c} DOUBLE" for c in ("temperature_2m_max", "temperature_2m_min", "temperature_2m_mean", "precipitation_sum", "rain_sum", "snowfall_sum", "wind_speed_10m_max", "wind_gusts_10m_max")
) + ", year INT, month INT"


def trips(spark, months, n=20):
    rows = []
    for m in months:
        for k in range(n):
            # One trip of a month falls into the month after: the month guard drops it.
            at = datetime(2024, m, 1 + k) if k else datetime(2024, m + 1, 1)
            rows.append((at, at + timedelta(hours=1), k, 1.5, 2.0, k % 3, 1, 1, 10.0 + k, float(k % 2), 12.0, 2024, m))
    return spark.createDataFrame(rows, TRIPS)


def weather(spark, months):
    rows = [(date(2024, m, d), *[float(m * d + j) for j in range(8)], 2024, m) for m in months for d in range(1, 29)]
    return spark.createDataFrame(rows, WEATHER)


@pytest.fixture
def layout(spark, tmp_path):
    roots = [str(tmp_path / n) for n in ("trips", "weather", "gold")]
    return gold.Layout(*roots, trips(spark, []).schema, weather(spark, []).schema)


def plain(df):
    return sorted(map(str, df.drop("year", "month").collect()))


def whole(spark, layout):
    return medallion.trips_daily_from_staging(
        medallion.stage_trips(files.scan_partitions(spark, layout.trips, layout.trips_schema)), medallion.stage_weather(files.scan_partitions(spark, layout.weather, layout.weather_schema))
    )


def built(spark, layout):
    return sorted(tuple(r) for r in gold.build_gold(spark, layout).collect())


def read(spark, layout):
    return spark.read.parquet(layout.gold)


def test_only_changed_months_are_built_and_read(spark, layout):
    files.write_partitions(trips(spark, [1, 2, 3, 4]), layout.trips, gold.KEYS)
    files.write_partitions(weather(spark, [1, 2, 3, 4]), layout.weather, gold.KEYS)
    assert built(spark, layout) == [(2024, m) for m in (1, 2, 3, 4)]
    assert plain(read(spark, layout)) == plain(whole(spark, layout))
    assert built(spark, layout) == []
    # Month 2 has new trips, month 3 other weather, month 5 is new.
    files.write_partitions(trips(spark, [2], 25), layout.trips, gold.KEYS, replace=True)
    files.write_partitions(weather(spark, [3]).withColumn("temperature_2m_max", F.lit(99.0)), layout.weather, gold.KEYS, replace=True)
    files.write_partitions(trips(spark, [5]), layout.trips, gold.KEYS)
    expected = plain(whole(spark, layout))
    # Files of other months that can't be read, though their listing looks the same.
    spoilt = [p for m in (1, 4) for p in Path(layout.trips, "year=2024", f"month={m}").glob("*.parquet")]
    kept = {p: (p.read_bytes(), p.stat()) for p in spoilt}
    for path, (content, stat) in kept.items():
        path.write_bytes(b"x" * len(content))
        os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert built(spark, layout) == [(2024, 2), (2024, 3), (2024, 5)]
    assert plain(read(spark, layout)) == expected


def test_months_that_are_gone_or_left_without_trips(spark, layout):
    files.write_partitions(trips(spark, [1, 2]), layout.trips, gold.KEYS)
    files.write_partitions(weather(spark, [1]), layout.weather, gold.KEYS)
    gold.build_gold(spark, layout)
    # Month 1 keeps only a trip that the guard drops, month 2 vanishes.
    files.write_partitions(trips(spark, [1], 1), layout.trips, gold.KEYS, replace=True)
    for p in Path(layout.trips, "year=2024", "month=2").glob("*"):
        p.unlink()
    assert built(spark, layout) == [(2024, 1), (2024, 2)]
    assert not list(Path(layout.gold).glob("year=*/month=*"))


def test_partition_filters_reach_both_scans(spark, layout, plan):
    files.write_partitions(trips(spark, [1, 2, 3]), layout.trips, gold.KEYS)
    files.write_partitions(weather(spark, [1, 2, 3]), layout.weather, gold.KEYS)
    months = files.stored(spark.createDataFrame([(2024, 2)], "year INT, month INT"), "months")
    text = plan(gold.gold_of_months(spark, layout, months))
    assert text.count("dynamicpruning") >= 2


def test_counts_from_footers_read_no_data(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    rows = trips(spark, [1, 2]).withColumn("tip_amount", F.when(F.col("VendorID") > 4, F.col("tip_amount")))
    files.write_partitions(rows, root, gold.KEYS)
    columns = [c for c in rows.columns if c not in gold.KEYS]

    def expected(df):
        return sorted((r.year, r.month, c, r.n, r[c]) for r in df.groupBy("year", "month").agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).collect() for c in columns)

    def found():
        return sorted(map(tuple, quality.counts_from_footers(spark, root, rows.schema, gold.KEYS).select("year", "month", "column", "rows", "nulls").collect()))

    df = quality.counts_from_footers(spark, root, rows.schema, gold.KEYS)
    assert root not in df._jdf.queryExecution().executedPlan().toString()
    assert found() == expected(rows)
    # One more file, without statistics: it is read, the others aren't.
    more = trips(spark, [2], 7)
    table = pa.Table.from_pylist([r.asDict() for r in more.drop(*gold.KEYS).collect()], schema=pq.read_schema(next(Path(root).rglob("*.parquet"))))
    pq.write_table(table, f"{root}/year=2024/month=2/bare file+1.parquet", write_statistics=False)
    assert found() == expected(rows.unionByName(more))


def test_ordinals_of_a_filtered_scan_are_those_of_the_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    trips(spark, [1, 2], 25).repartition(6).write.partitionBy(*gold.KEYS).parquet(root)
    scan = spark.read.parquet(root)

    def numbers(df, **kw):
        return {(r.month, r.VendorID): r.ordinal for r in faults.file_ordinals(df, gold.KEYS, **kw).collect()}

    every = numbers(scan, root=root)
    assert every == numbers(scan) and sorted(v for (m, _), v in every.items() if m == 1) == list(range(25))
    part = numbers(scan.filter("VendorID % 4 = 1"), root=root)
    assert part == {k: v for k, v in every.items() if k[1] % 4 == 1}
