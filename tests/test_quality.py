from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mendwell.operators import drift, faults, quality
from mendwell.plans import catalog

NOW = datetime(2024, 1, 10)


@pytest.fixture
def rows(spark):
    data = [
        (1, "a", 10.0, datetime(2024, 1, 1)),
        (2, "b", 500.0, datetime(2024, 1, 11)),  # exactly the slack
        (2, None, 501.0, datetime(2024, 1, 11, 0, 0, 1)),
        (None, "z", None, None),
        (None, "a", -1.0, None),
    ]
    return spark.createDataFrame(data, "id INT, kind STRING, fare DOUBLE, at TIMESTAMP_NTZ")


def test_row_conditions(rows):
    def count(condition):
        return rows.filter(condition).count()

    assert count(quality.is_missing("id")) == 2
    assert count(quality.not_accepted("kind", ["a", "b"])) == 1  # null passes
    assert count(quality.not_between("fare", 0, 500)) == 2  # bounds and null pass
    assert count(quality.not_between("fare", 0, 500, strictly=True)) == 3
    assert count(quality.not_between("fare", 0, None, F.col("kind") == "z")) == 0
    assert count(quality.in_future("at", NOW, 24)) == 1


def test_duplicates_ignore_nulls(rows):
    assert [tuple(r) for r in quality.duplicates(rows, ["id"]).collect()] == [(2, 2)]
    assert quality.duplicates(rows, ["id", "kind"]).count() == 0


def test_orphans_ignore_nulls(spark, rows):
    parent = spark.createDataFrame([(1,), (None,)], "key INT")
    assert [r.id for r in quality.orphans(rows, "id", parent, "key").collect()] == [2, 2]


def test_row_count_tolerance(spark):
    df = spark.range(90)
    assert quality.row_count_outside(df, 100).count() == 0  # exactly 10 % off
    assert quality.row_count_outside(df, 101).count() == 1
    assert quality.row_count_outside(df, 80).count() == 1


def test_partition_counts_follow_the_previous_ones(spark):
    sizes = {1: 100, 2: 100, 3: 5, 4: 100}
    df = spark.createDataFrame([("d", p) for p, n in sizes.items() for _ in range(n)], "ds STRING, p INT")
    found = quality.partition_counts_outside(df, ["ds"], "p", 3, 10)
    assert sorted(r.p for r in found.collect()) == [3, 4]


def test_suite_counts_all_row_checks_in_one_pass(spark, rows, plan):
    checks = [
        quality.RowCheck("id_present", "t", quality.is_missing("id")),
        quality.RowCheck("fare_range", "t", quality.not_between("fare", 0, 500), "warn"),
        quality.NonEmptyCheck("not_empty", "t"),
        quality.NonEmptyCheck("not_empty", "none"),
        quality.TableCheck("id_unique", "t", lambda t: quality.duplicates(t["t"], ["id"])),
    ]
    summary = quality.run_suite({"t": rows, "none": rows.filter("id > 9")}, checks)
    found = {(r.check_name, r.target): (r.severity, r.failures, r.passed) for r in summary.collect()}
    assert found == {
        ("id_present", "t"): ("error", 2, False),
        ("fare_range", "t"): ("warn", 2, False),
        ("not_empty", "t"): ("error", 0, True),
        ("not_empty", "none"): ("error", 1, False),
        ("id_unique", "t"): ("error", 1, False),
    }
    one_table = quality.run_suite({"t": rows}, checks[:3])
    assert plan(one_table).count("Scan ExistingRDD") == 1
    outcomes = quality.suite_events(summary, F.lit(NOW))
    assert {r.result for r in outcomes.collect()} == {"pass", "fail"}


# --- faults -----------------------------------------------------------------------


def trips(spark, n, tmp_path):
    path = str(tmp_path / f"trips{n}")
    df = spark.range(n, numPartitions=1).select(
        F.col("id").alias("VendorID"), F.lit("2024-01-01 00:00:00").alias("tpep_pickup_datetime"), F.lit(1).alias("month")
    )
    df.write.parquet(path)
    return faults.file_ordinals(spark.read.parquet(path), ["month"])


def test_null_spike_of_forty_rows(spark, tmp_path):
    spiked = faults.null_spike(trips(spark, 40, tmp_path), F.col("ordinal"))
    hit = spiked.filter("tpep_pickup_datetime IS NULL")
    assert sorted(r.VendorID for r in hit.collect()) == [0, 19, 38]


@pytest.mark.parametrize(("n", "kept"), [(100, [0, 1, 2, 3, 4]), (3, [0])])
def test_volume_drop_keeps_the_head(spark, tmp_path, n, kept):
    dropped = faults.volume_drop(trips(spark, n, tmp_path), F.col("ordinal"))
    assert sorted(r.VendorID for r in dropped.collect()) == kept


def test_volume_drop_of_nothing(spark):
    empty = spark.range(0).withColumn("ordinal", F.col("id"))
    assert faults.volume_drop(empty, F.col("ordinal")).count() == 0


def test_ordinals_run_on_over_files(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(100).repartition(7).withColumn("month", F.lit(1)).write.parquet(path)
    numbered = faults.file_ordinals(spark.read.parquet(path), ["month"])
    assert sorted(r.ordinal for r in numbered.collect()) == list(range(100))


def test_rename_needs_its_column(spark):
    assert "vendor_id_renamed" in faults.rename_trip_column(spark.range(1).withColumnRenamed("id", "VendorID")).columns
    with pytest.raises(ValueError):
        faults.rename_weather_column(spark.range(1))


def test_faults_are_lazy_and_detected(spark, tmp_path):
    good = trips(spark, 100, tmp_path)
    renamed = faults.rename_trip_column(good)
    assert good.columns[0] == "VendorID"  # the input is untouched
    columns = [(c, t) for c, t in renamed.dtypes]
    files = spark.createDataFrame([("f", columns)], "path STRING, columns ARRAY<STRUCT<name: STRING, dtype: STRING>>")
    assert [r.missing_column for r in drift.missing_columns(files, ["VendorID"]).collect()] == ["VendorID"]
    assert quality.row_count_outside(faults.volume_drop(good, F.col("ordinal")), 100).count() == 1
    assert quality.row_count_outside(good, 100).count() == 0


def test_sample_passes_filter_below_joins(spark, plan, monkeypatch):
    left = spark.range(100).selectExpr("id", "id % 10 AS v")
    joined = left.join(spark.range(100).hint("merge"), "id")
    plans = []
    monkeypatch.setattr(quality, "stored", lambda df, name, write=quality.stored: plans.append(plan(df)) or write(df, name))
    found = quality.suite_samples(joined, [quality.RowCheck("low", "t", F.col("v") > 8)])
    row = found.first()
    assert row.failures == 10 and {r["v"] for r in row.sample_rows} == {"9"}
    for text, condition in ((plans[0], "> 8"), (plan(found), "xxhash64(")):
        assert text.rindex(condition) > text.index("SortMergeJoin")
    assert quality.suite_samples(joined, [quality.RowCheck("none", "t", F.col("v") > 10)]).first().sample_rows == []


def test_suite_joins_trips_with_their_months_once(spark, sf_dir, monkeypatch):
    calls = []
    monkeypatch.setattr(catalog.tables, "bronze_trips", lambda *a, make=catalog.tables.bronze_trips: calls.append(1) or make(*a))
    assert catalog.QUERIES["dq_summary"](spark, sf_dir).count() == 20 and len(calls) == 1
