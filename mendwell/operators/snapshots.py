"""Incident state kept as a bucketed snapshot that later changes are folded into."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwell.operators.incidents import fold_changes, with_status
from mendwell.session import remove_folder, work_dir

BUCKETS = 32
LAST = ["resolved_seq", "resolved_at", "fix_seq", "proposed_fix"]


@dataclass(frozen=True)
class Snapshot:
    """A table bucketed by incident, and the number of the last change that it holds."""

    spark: SparkSession
    table: str
    path: str
    high_water: int
    buckets: int

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def state(self) -> DataFrame:
        """As :func:`incidents.incident_state` of all changes so far."""
        return with_status(self.rows().filter("_opened").drop("_opened", "resolved_seq", "fix_seq"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove_folder(self.spark, self.path)


def _written(rows: DataFrame, high_water: int, buckets: int) -> Snapshot:
    """One file per bucket: rows that come from the buckets before stay where they are, without a shuffle."""
    spark, table = rows.sparkSession, f"incident_snapshot_{uuid.uuid4().hex}"
    path = work_dir(spark, "incident-snapshot")
    rows.write.bucketBy(buckets, "incident_id").sortBy("incident_id").option("path", path).saveAsTable(table)
    return Snapshot(spark, table, path, high_water, buckets)


def _incoming(opened: DataFrame, later: DataFrame) -> DataFrame:
    """New incidents with their changes; a change may come before its incident."""
    marked = opened.withColumn("_opened", F.lit(True))
    return marked.join(fold_changes(later), "incident_id", "full_outer")


def start(opened: DataFrame, changes: DataFrame, buckets: int = BUCKETS) -> Snapshot:
    """A first snapshot; ``opened`` and ``changes`` as for :func:`incidents.incident_state`."""
    rows = _incoming(opened, changes).withColumn("_opened", F.coalesce("_opened", F.lit(False)))
    return _written(rows.repartition(buckets, "incident_id"), _last(changes, -1), buckets)


def _last(changes: DataFrame, otherwise: int) -> int:
    return changes.agg(F.coalesce(F.max("seq"), F.lit(otherwise))).first()[0]


def advance(before: Snapshot, opened: DataFrame, changes: DataFrame) -> Snapshot:
    """The snapshot after newly opened incidents and all changes numbered above its high-water mark.

    Only those changes are read and folded; they are shuffled to the buckets of the snapshot, which
    itself isn't. An incident that the snapshot holds already keeps its row. The former
    snapshot stays until it is dropped, so a failed run can start again from it.
    """
    later = changes.filter(F.col("seq") > before.high_water)
    old = before.rows()
    fresh = _incoming(opened, later)
    names = [c for c in old.columns if c not in ("incident_id", "_opened", *LAST)]
    new = fresh.select("incident_id", F.col("_opened").alias("_new"), *[F.col(c).alias(f"_{c}") for c in [*names, *LAST]])
    both = old.join(new, "incident_id", "full_outer")
    known = F.coalesce("_opened", F.lit(False))
    own = [F.when(known, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in names]
    # Later changes have larger numbers, so where there is one it counts.
    moved = [F.when(F.col(f"_{seq}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for seq, c in (("resolved_seq", "resolved_seq"), ("resolved_seq", "resolved_at"), ("fix_seq", "fix_seq"), ("fix_seq", "proposed_fix"))]
    rows = both.select("incident_id", *own, (known | F.coalesce("_new", F.lit(False))).alias("_opened"), *moved)
    return _written(rows, _last(later, before.high_water), before.buckets)
