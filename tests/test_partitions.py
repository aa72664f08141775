from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from mendwell.functions import scalars
from mendwell.operators import drift, partitions


def test_calendar_stops_before_the_last_completed_month(spark):
    bounds = spark.createDataFrame([("a", date(2024, 1, 1), date(2024, 5, 15)), ("b", date(2024, 5, 1), date(2024, 5, 15))],
                                   "asset STRING, start DATE, now DATE")
    keys = [(r.asset, r.partition_key) for r in partitions.partition_calendar(bounds).collect()]
    assert keys == [("a", "2024-01-01"), ("a", "2024-02-01"), ("a", "2024-03-01")]
    whole = partitions.partition_calendar(bounds, end_offset=0)
    assert whole.filter("asset = 'a'").count() == 4


def test_next_month_rolls_over_the_year(spark):
    df = spark.createDataFrame([(date(2024, 12, 1),), (date(2024, 3, 1),)], "d DATE")
    months = [r.n for r in df.select(scalars.next_month(F.col("d")).alias("n")).collect()]
    assert months == [date(2025, 1, 1), date(2024, 4, 1)]


def test_next_partition_waits_for_upstream(spark):
    landed = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 3, 1)), ("b", date(2024, 4, 1))], "asset STRING, partition_date DATE")
    due = partitions.next_partition(landed, date(2024, 4, 2), ["asset"])
    assert [(r.asset, r.candidate) for r in due.collect()] == [("a", date(2024, 4, 1))]
    assert partitions.next_partition(landed, date(2024, 4, 1), ["asset"]).count() == 0


def test_profile_ignores_bad_times_and_missing_columns(spark):
    df = spark.createDataFrame([(1, "2024-01-02 00:00:00"), (1, "junk"), (2, None)], "month INT, pickup_datetime STRING")
    rows = {r.month: r for r in partitions.partition_profile(df, ["month"], ["tpep_pickup_datetime", "pickup_datetime"]).collect()}
    assert (rows[1].rows, rows[1].pickup_min) == (2, datetime(2024, 1, 2))
    assert (rows[2].rows, rows[2].pickup_max) == (1, None)
    bare = partitions.partition_profile(df.drop("pickup_datetime"), ["month"], ["pickup_datetime"])
    assert {r.pickup_min for r in bare.collect()} == {None}


def files(spark, rows):
    return spark.createDataFrame(rows, "dataset STRING, month INT, path STRING, columns ARRAY<STRUCT<name: STRING, dtype: STRING>>")


def test_fingerprint_depends_on_order_and_types(spark):
    a, b, c = [("x", "int"), ("y", "string")], [("y", "string"), ("x", "int")], [("x", "long"), ("y", "string")]
    rows = files(spark, [("d", 1, "1", a), ("d", 2, "2", a), ("d", 3, "3", b), ("d", 4, "4", c)])
    prints = [r.schema_fingerprint for r in drift.schema_fingerprint(rows).orderBy("path").collect()]
    assert prints[0] == prints[1] and len(set(prints)) == 3
    assert all(len(p) == 16 for p in prints)


def test_drift_reports_changes_once(spark):
    old, new = [("VendorID", "int"), ("fare", "double")], [("vendor", "int"), ("fare", "double")]
    rows = files(spark, [("d", 1, "1", old), ("d", 2, "2", new), ("d", 3, "3", new), ("d", 3, "4", old), ("d", 4, "6", old), ("d", 4, "7", new), ("e", 1, "5", new)])
    found = {(r.dataset, r.month): r for r in drift.schema_drift(rows, "dataset", "month").collect()}
    assert [found["d", m].changed for m in (1, 2, 3, 4)] == [False, True, True, False]
    assert found["d", 2].added == ["vendor:int"] and found["d", 2].removed == ["VendorID:int"]
    # Any file counts, not only the first.
    assert found["d", 3].n_schemas == 2
    assert found["d", 3].added == ["VendorID:int"] and found["d", 3].removed == ["vendor:int"]
    assert found["d", 4].added == found["d", 4].removed == []
    assert not found["e", 1].changed


def test_scalars(spark):
    df = spark.createDataFrame(
        [("2024-02-01",), ("2024-01-15",), ("2025-03-31",), ("garbage",), (None,)], "key STRING"
    )
    slipped = [r.s for r in df.select(scalars.previous_partition_key(F.col("key")).alias("s")).collect()]
    assert slipped == ["2024-01-01", "2023-12-01", "2025-02-01", None, None]
    one = spark.range(1)

    def value(column):
        return one.select(column.alias("v")).first().v

    assert value(scalars.quarantine_path(F.lit("bronze/tlc/x.parquet"))) == "bronze/_quarantine/tlc/x.parquet"
    assert value(scalars.quarantine_path(F.lit("other/x.parquet"))) == "bronze/_quarantine/other/x.parquet"
    assert value(scalars.bare_name(F.lit("a/b.c"))) == "c"
    assert value(scalars.hive_path("bronze/tlc", F.lit(date(2024, 2, 1)))) == "bronze/tlc/year=2024/month=02/"
    assert value(scalars.tail(F.array(F.lit(1), F.lit(2), F.lit(3)), 2)) == [2, 3]
    assert value(scalars.tail(F.array(F.lit(1)), 10)) == [1]
    assert value(scalars.month_end(F.lit(date(2024, 2, 10)))) == date(2024, 2, 29)
    assert value(scalars.padded(F.lit("abc"), 5)) == "abc  "
    assert value(scalars.padded(F.lit("abcdef"), 5)) == "abcdef"
    assert value(scalars.sorted_json({"b": F.lit(1), "a": F.lit(None).cast("int")})) == '{"a":null,"b":1}'


def test_code_fences(spark):
    texts = ['```json\n{"a": 1}\n```', '```\n{"a": 1}```', ' {"a": 1}\n', "```{}```"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    out = [r.s for r in df.select(scalars.strip_code_fence(F.col("t")).alias("s")).collect()]
    assert out == ['{"a": 1}', '{"a": 1}', '{"a": 1}', ""]
