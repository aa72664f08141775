from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mendwell.operators import incidents, snapshots

OPENED = "incident_id STRING, created_at TIMESTAMP_NTZ, asset_key STRING"
CHANGES = "incident_id STRING, seq BIGINT, kind STRING, changed_at TIMESTAMP_NTZ, proposed_fix STRING"
T = datetime(2024, 1, 1)


def tables(spark, n=60):
    opened = spark.createDataFrame([(f"i{k:02d}", T, f"a{k % 3}") for k in range(n)], OPENED)
    rows = []
    for seq in range(4 * n):
        kind = "resolve" if seq % 5 == 0 else "fix"
        # A third of all changes are of one incident; some are of unknown ones.
        target = "i00" if seq % 3 == 0 else f"i{seq * 7 % (n + 5):02d}"
        rows.append((target, seq, kind, T + timedelta(minutes=seq), None if kind == "resolve" else f"fix {seq}"))
    return opened, spark.createDataFrame(rows, CHANGES)


def plain(state):
    return sorted((r.incident_id, r.asset_key, r.status, str(r.resolved_at), r.proposed_fix) for r in state.collect())


def test_several_appends_equal_the_full_fold(spark):
    opened, changes = tables(spark)
    # Incidents appear after some of their changes, and once more later on.
    parts = [opened.filter("incident_id < 'i20'"), opened.filter("incident_id >= 'i20' AND incident_id < 'i45'"), opened.filter("incident_id >= 'i10'"), opened.limit(0)]
    ends = [60, 61, 180, 240]
    snapshot, so_far = None, parts[0].limit(0)
    for part, end in zip(parts, ends, strict=True):
        seen = changes.filter(F.col("seq") < end)
        snapshot = snapshots.start(part, seen, 4) if snapshot is None else snapshots.advance(snapshot, part, seen)
        so_far = so_far.unionByName(part).distinct()
        assert snapshot.high_water == end - 1
        assert plain(snapshot.state()) == plain(incidents.incident_state(so_far, seen))
    again = snapshots.advance(snapshot, parts[0], changes)
    assert plain(again.state()) == plain(snapshot.state())


def test_the_snapshot_is_not_shuffled(spark, plan, monkeypatch):
    opened, changes = tables(spark)
    snapshot = snapshots.start(opened.limit(50), changes.filter("seq < 100"), 4)
    seen = []
    write = snapshots._written
    monkeypatch.setattr(snapshots, "_written", lambda rows, *rest: seen.append(plan(rows)) or write(rows, *rest))
    snapshots.advance(snapshot, opened.filter("incident_id > 'i50'"), changes)
    lines = seen[0].splitlines()
    at = next(k for k, line in enumerate(lines) if snapshot.table in line)
    join = next(k for k, line in enumerate(lines) if "Join" in line and "FullOuter" in line)
    assert join < at and not any("Exchange" in line for line in lines[join:at])


def test_empty_appends_and_drop(spark):
    opened, changes = tables(spark, 3)
    first = snapshots.start(opened.limit(0), changes.limit(0), 2)
    assert first.high_water == -1 and first.state().count() == 0
    second = snapshots.advance(first, opened, changes)
    first.drop()
    assert plain(second.state()) == plain(incidents.incident_state(opened, changes))
