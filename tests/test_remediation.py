from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mendwell.operators import remediation as rem

INCIDENT = "incident_id STRING, created_at TIMESTAMP_NTZ, asset_key STRING, partition_key STRING, error_type STRING, error_message STRING"
T = datetime(2024, 1, 1)


def incident(name="i", asset="bronze/tlc_yellow", key="2024-02-01", kind="", text="", at=T):
    return (name, at, asset, key, kind, text)


@pytest.fixture
def flags(spark):
    return spark.createDataFrame([("tlc_5xx",)], "flag STRING")


@pytest.fixture
def manifest(spark):
    rows = [
        ("tlc", "2024-01-01", "bronze/tlc/yellow/year=2024/month=01/", 10),
        ("tlc", "2024-02-01", "bronze/tlc/yellow/year=2024/month=02/", 20),
    ]
    return spark.createDataFrame(rows, "dataset STRING, partition_key STRING, path STRING, rows BIGINT")


GUARDS = [
    ("retry", incident(kind="HTTPStatusError", asset="bronze/other"), True),
    ("retry", incident(text="anything"), True),  # the asset name alone is a signal
    ("retry", incident(asset="silver/tlc_yellow", kind="HTTPStatusError"), False),
    ("retry", incident(key=None, kind="HTTPStatusError"), False),
    ("retry", incident(asset="bronze/other", kind="ValueError"), False),
    ("retry", incident(asset="Bronze/Other", text="WEATHER_429"), True),
    ("slip", incident(text="not yet published upstream (404)"), True),
    ("slip", incident(kind="NotFoundError"), True),
    ("slip", incident(text="503"), False),
    ("slip", incident(key="", text="404"), False),
    ("slip", incident(asset="stg_tlc", text="404"), False),
    ("coerce", incident(text="Schema did not match"), True),
    ("coerce", incident(key=None, kind="SchemaError"), True),
    ("coerce", incident(text="503 upstream"), False),
    ("coerce", incident(asset="gold/x", text="schema"), False),
    ("coerce", incident(asset=None, text="schema"), False),
]


@pytest.mark.parametrize(("name", "row", "expected"), GUARDS)
def test_guards(spark, name, row, expected):
    guard = {"retry": rem.retry_guard(), "slip": rem.slip_guard(), "coerce": rem.coerce_guard()}[name]
    assert spark.createDataFrame([row], INCIDENT).select(guard.alias("g")).first().g is expected


def test_strict_retry_guard_ignores_the_asset_name(spark):
    df = spark.createDataFrame([incident(text="disk full"), incident(text="tlc_5xx")], INCIDENT)
    assert [r.g for r in df.select(rem.retry_guard(strict=True).alias("g")).collect()] == [False, True]


def test_retry_clears_a_flag_once(spark, flags, manifest):
    rows = [
        incident("old", kind="HTTPStatusError", at=datetime(2024, 1, 1)),
        incident("new", kind="HTTPStatusError", at=datetime(2024, 1, 3)),
        incident("wx", asset="bronze/weather_nyc_daily", kind="HTTPStatusError"),
    ]
    plans = rem.plan(spark.createDataFrame(rows, INCIDENT), rem.RETRY, flags, manifest)
    found = {r.incident_id: r for r in plans.collect()}
    assert {k: r.cleared_flag for k, r in found.items()} == {"old": None, "new": "tlc_5xx", "wx": None}
    assert found["new"].next_run.run_tags == {
        "mendwell.remediation": rem.RETRY,
        "mendwell.incident_id": "new",
        "mendwell.cleared_flag": "tlc_5xx",
    }
    assert set(found["old"].next_run.run_tags) == {"mendwell.remediation", "mendwell.incident_id"}
    assert found["new"].description == "cleared chaos flag 'tlc_5xx' and queued re-materialization"
    assert found["wx"].next_run.partition_key == "2024-02-01"


def test_slip_plans(spark, flags, manifest):
    rows = [incident("a", key="2024-01-01", text="404"), incident("b", key="garbage", text="404")]
    found = {r.incident_id: r for r in rem.plan(spark.createDataFrame(rows, INCIDENT), rem.SLIP, flags, manifest).collect()}
    a = found["a"]
    assert a.next_run.partition_key == "2023-12-01"
    assert a.next_run.run_tags["mendwell.partition_slipped_from"] == "2024-01-01"
    assert a.rollback_data == {"original_partition": "2024-01-01", "slipped_partition": "2023-12-01"}
    assert found["b"].action_error == "unparseable partition_key: 'garbage'" and found["b"].next_run is None


def test_coerce_plans_use_the_incidents_partition(spark, flags, manifest):
    rows = [
        incident("own", key="2024-01-01", text="schema"),
        incident("latest", key=None, text="schema"),
        incident("absent", key="2030-01-01", text="schema"),
        incident("foreign", asset="bronze/zzz", text="schema"),
    ]
    found = {r.incident_id: r for r in rem.plan(spark.createDataFrame(rows, INCIDENT), rem.COERCE, flags, manifest).collect()}
    assert found["own"].quarantine_key == "bronze/_quarantine/tlc/yellow/year=2024/month=01/"
    assert found["own"].description.startswith("wrote 10 coerced rows")
    assert found["latest"].quarantine_key.endswith("month=02/")
    for name in ("absent", "foreign"):
        assert (found[name].success, found[name].next_run) == (False, None)


def test_decisions(spark, flags, manifest):
    base = [
        ("executed", "retry-with-backoff", True, incident(kind="HTTPStatusError")),
        ("flag off", "retry-with-backoff", False, incident()),
        ("off list", "rerun-dbt", True, incident()),
        ("guard", "partition-window-slip", True, incident(text="503")),
        ("failed", "partition-window-slip", True, incident(key="garbage", text="404")),
        ("no object", "coerce-to-string", True, incident(key="2030-01-01", text="schema")),
    ]
    rows = [(name, fix, auto, *row[1:]) for name, fix, auto, row in base]
    schema = "incident_id STRING, proposed_fix STRING, can_auto_remediate BOOLEAN, " + INCIDENT.split(", ", 1)[1]
    df = spark.createDataFrame(rows, schema)
    found = {r.incident_id: (r.action_status, r.action_reason, r.action) for r in rem.decide_actions(df, flags, manifest).collect()}
    assert found == {
        "executed": ("executed", None, "retry-with-backoff"),
        "flag off": ("skipped", "diagnosis.can_auto_remediate=false", None),
        "off list": ("skipped", "proposed_fix 'rerun-dbt' not on allowlist", None),
        "guard": ("skipped", "guard rejected", "partition-window-slip"),
        "failed": ("failed", "unparseable partition_key: 'garbage'", "partition-window-slip"),
        "no object": ("execute_returned_failure", None, "coerce-to-string"),
    }
    unwired = {r.incident_id: r.action_reason for r in rem.decide_actions(df, flags, manifest, wired=False).collect()}
    assert unwired["executed"] == "no remediation deps wired"


def test_approvals(spark, flags, manifest):
    opened = spark.createDataFrame([incident("a", kind="HTTPStatusError"), incident("b", key="garbage", text="404")], INCIDENT)
    asked = [
        ("1", "a", "retry-with-backoff"),
        ("2", "a", "partition-window-slip"),
        ("3", "a", "drop-table"),
        ("4", "b", "partition-window-slip"),
        ("5", "zz", "retry-with-backoff"),
    ]
    approvals = spark.createDataFrame(asked, "approval_id STRING, incident_id STRING, action STRING")
    found = {r.approval_id: r.status for r in rem.decide_approvals(approvals, opened, flags, manifest).collect()}
    assert found == {"1": "applied", "2": "guard_failed", "3": "off_allowlist", "4": "guard_failed", "5": "not_found"}


def test_allowlist():
    assert set(rem.ALLOWLIST) == {"retry-with-backoff", "partition-window-slip", "coerce-to-string"}


def test_quarantine_copies_named_partitions_as_text(spark):
    bronze = spark.createDataFrame(
        [(1, None, 10.5, 2024, 1), (2, "2024-02-01", 1.0, 2024, 2)],
        "VendorID BIGINT, tpep_pickup_datetime STRING, fare_amount DOUBLE, year INT, month INT",
    )
    plans = spark.createDataFrame([("bronze/_quarantine/tlc/yellow/year=2024/month=01/",), (None,)], "quarantine_key STRING")
    rows = rem.quarantine_rows(bronze, plans)
    assert dict(rows.dtypes) == {
        "VendorID": "string", "tpep_pickup_datetime": "string", "fare_amount": "string", "year": "int", "month": "int",
    }
    row = rows.collect()[0]
    assert (row.VendorID, row.tpep_pickup_datetime, row.fare_amount) == ("1", None, "10.5")
    assert bronze.count() == 2


def test_rollback_leaves_tombstones(spark):
    results = spark.createDataFrame(
        [("a", {"quarantine_key": "q1"}), ("b", {"cleared_flag": "tlc_5xx"}), ("c", {"original_partition": "x"}), ("d", None)],
        "incident_id STRING, rollback_data MAP<STRING, STRING>",
    )
    undone = rem.rollback(results)
    assert {r.incident_id: (r.undo, r.subject) for r in undone.collect()} == {
        "a": ("tombstone", "q1"), "b": ("reset_flag", "tlc_5xx"), "c": ("none", None),
    }
    objects = spark.createDataFrame([("q1",), ("q2",)], "quarantine_key STRING")
    assert [r.quarantine_key for r in rem.live_quarantine(objects, undone).collect()] == ["q2"]


def test_pending_runs(spark, flags, manifest):
    df = spark.createDataFrame([incident("a", kind="HTTPStatusError"), incident("b", kind="HTTPStatusError")], INCIDENT)
    plans = rem.plan(df, rem.RETRY, flags, manifest)
    done = df.filter(F.col("incident_id") == "a")
    assert [r.incident_id for r in rem.pending_runs(plans, done).collect()] == ["b"]
