from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from mendwell.plans.catalog import QUERIES
from mendwell.session import broadcast_if_small, work_dir
from mendwell.sources import files, footers, landing, weather_json

ROWS = "id INT, year INT, month INT"


def test_schema_gate_stops_a_renamed_column(spark, tmp_path):
    root = str(tmp_path / "bronze")
    good = spark.createDataFrame([(1, 2024, 1), (2, 2024, 2)], ROWS)
    files.write_partitions(good, root, landing.KEYS)
    assert files.scan_partitions(spark, root, good.schema).count() == 2
    renamed = spark.createDataFrame([(3, 2024, 3)], ROWS).withColumnRenamed("id", "new_id")
    files.write_partitions(renamed, root, landing.KEYS)
    with pytest.raises(files.SchemaGateError):
        files.scan_partitions(spark, root, good.schema)
    # Without the gate the column silently reads as null.
    assert files.scan_partitions(spark, root, good.schema, gate=False).filter("id is null").count() == 1


def test_partition_argument_prunes(spark, tmp_path, plan):
    root = str(tmp_path / "bronze")
    df = spark.createDataFrame([(1, 2024, 1), (2, 2024, 2)], ROWS)
    files.write_partitions(df, root, landing.KEYS)
    scan = files.scan_partitions(spark, root, df.schema, partitions=[(2024, 2)])
    assert [r.id for r in scan.collect()] == [2]
    assert "PartitionFilters: [" in plan(scan) and "PartitionFilters: []" not in plan(scan)


def test_landing_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "bronze")
    first = spark.createDataFrame([(1, 2024, 1), (2, 2024, 1)], ROWS)
    both = first.unionByName(spark.createDataFrame([(3, 2024, 2)], ROWS))
    assert [r.status for r in landing.land(first, root).collect()] == ["landed"]
    assert [r.status for r in landing.land(first, root).collect()] == ["skipped"]
    assert spark.read.parquet(root).count() == 2
    before = landing.landed_partitions(spark, root)
    known = spark.createDataFrame(before.collect(), before.schema)
    report = {r.month: (r.status, r.rows) for r in landing.land(both, root, known).collect()}
    assert report == {1: ("skipped", 2), 2: ("landed", 1)}
    assert spark.read.parquet(root).count() == 3


def test_named_partitions_are_replaced(spark, tmp_path):
    root = str(tmp_path / "bronze")
    landing.land(spark.createDataFrame([(1, 2024, 1), (2, 2024, 2)], ROWS), root)
    again = spark.createDataFrame([(9, 2024, 1), (8, 2024, 2), (7, 2024, 3)], ROWS)
    named = spark.createDataFrame([(2024, 2)], "year INT, month INT")
    report = {r.month: r.status for r in landing.land(again, root, forced=named).collect()}
    assert report == {1: "skipped", 2: "landed", 3: "landed"}
    assert sorted(r.id for r in spark.read.parquet(root).collect()) == [1, 7, 8]


def test_forced_landing_replaces_only_its_partitions(spark, tmp_path):
    root = str(tmp_path / "bronze")
    landing.land(spark.createDataFrame([(1, 2024, 1), (2, 2024, 2)], ROWS), root)
    known = spark.createDataFrame([(2024, 1), (2024, 2)], "year INT, month INT")
    landing.land(spark.createDataFrame([(9, 2024, 1)], ROWS), root, known, force=True)
    assert sorted(r.id for r in spark.read.parquet(root).collect()) == [2, 9]


def test_latest_partition(spark):
    landed = spark.createDataFrame([(2023, 12), (2024, 2), (2024, 1)], "year INT, month INT")
    assert tuple(landing.latest_partition(landed).first()) == (2024, 2)


def test_hidden_quarantine_is_not_scanned(spark, tmp_path):
    df = spark.createDataFrame([(1, 2024, 1)], ROWS)
    files.write_partitions(df, str(tmp_path / "bronze"), landing.KEYS)
    files.write_partitions(df, str(tmp_path / "bronze" / "_quarantine"), landing.KEYS)
    assert footers.list_files(spark, str(tmp_path / "bronze")).count() == 1
    assert footers.list_files(spark, str(tmp_path / "bronze" / "_quarantine")).count() == 1


def test_seed_csv(spark, tmp_path):
    (tmp_path / "zones.csv").write_text("LocationID,Borough,Zone,service_zone\n1,EWR,Newark Airport,EWR\n")
    assert tuple(files.read_seed(spark, str(tmp_path / "zones.csv")).first()) == (1, "EWR", "Newark Airport", "EWR")


def payload(**daily):
    return json.dumps({"daily": daily})


@pytest.fixture
def payloads(spark):
    rows = [
        ("good", payload(time=["2024-01-03", "2024-01-01", "2024-01-02"], temperature_2m_max=[1.0, None, 3.0], rain_sum=[])),
        ("no time", payload(temperature_2m_max=[1.0])),
        ("no daily", "{}"),
        ("ragged", payload(time=["2024-01-01"], rain_sum=[1.0, 2.0])),
        ("bad day", payload(time=["2024-13-01"])),
        ("broken", "{bad"),
        ("empty", payload(time=[])),
    ]
    return weather_json.parse_payloads(spark.createDataFrame(rows, "name STRING, payload STRING"))


def test_payload_rows(payloads):
    rows = weather_json.payload_rows(payloads, ["name"])
    assert rows.columns == ["name", "date", *weather_json.DAILY_VARS]
    found = {r.date: (r.temperature_2m_max, r.rain_sum, r.snowfall_sum) for r in rows.collect()}
    assert found == {
        date(2024, 1, 1): (None, None, None),
        date(2024, 1, 2): (3.0, None, None),
        date(2024, 1, 3): (1.0, None, None),
    }


def test_payload_rejects(payloads):
    rejected = {r.name: r.reject_reason for r in weather_json.rejected_payloads(payloads).collect()}
    assert rejected == {
        "no time": "missing daily.time",
        "no daily": "missing daily.time",
        "ragged": "columns differ in length",
        "bad day": "unparseable date",
        "broken": "malformed payload",
    }


def test_payload_bounds_are_positional(payloads):
    bounds = {r.name: (r.days, r.date_min, r.date_max) for r in weather_json.payload_bounds(payloads, ["name"]).collect()}
    assert bounds == {"good": (3, "2024-01-03", "2024-01-02"), "empty": (0, "", "")}


def test_reports_round_trip(spark, tmp_path):
    root = str(tmp_path / "reports")
    reports = spark.createDataFrame([("a", date(2024, 1, 1), '{"x": 1}')], "incident_id STRING, report_date DATE, report STRING")
    files.write_reports(reports, root)
    assert [tuple(r) for r in files.read_reports(spark, root).collect()] == [("a", '{"x": 1}')]


def test_broadcast_only_within_the_bound(spark, plan):
    big, small = spark.range(1000), spark.range(10).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        within = big.join(broadcast_if_small(small, 70), F.col("id") == F.col("k"))
        beyond = big.join(broadcast_if_small(small, 69), F.col("id") == F.col("k"))
        assert "BroadcastHashJoin" in plan(within)
        assert "SortMergeJoin" in plan(beyond)
        assert within.count() == beyond.count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_work_dir_uses_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark, "x").startswith(base)
    assert work_dir(spark, "x") != work_dir(spark, "x")


def test_fingerprint_of_tables_kept_as_folders(spark, tmp_path):
    spark.range(20).repartition(4).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(5).selectExpr("id", "id AS more").coalesce(1).write.parquet(str(tmp_path / "mixed.parquet"))
    spark.range(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "mixed.parquet"))
    rows = QUERIES["schema_fingerprint"](spark, str(tmp_path)).collect()
    assert sorted((r.file_name, r.n_columns) for r in rows) == [("many.parquet", 1), ("mixed.parquet", 1), ("mixed.parquet", 2)]
