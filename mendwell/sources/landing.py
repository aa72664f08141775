"""Idempotent landing of monthly partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwell.session import broadcast_if_small, work_dir
from mendwell.sources.files import write_partitions, write_table
from mendwell.sources.footers import list_files, path_part

KEYS = ["year", "month"]


def landed_partitions(spark: SparkSession, root: str) -> DataFrame:
    """Distinct ``(year, month)`` below ``root``, taken from the file listing."""
    files = list_files(spark, root)
    return files.select(*[path_part(F.col("path"), k).alias(k) for k in KEYS]).dropna().distinct()


def split_incoming(incoming: DataFrame, landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incoming rows of new partitions, and of partitions that are already landed."""
    small = broadcast_if_small(landed.select(*KEYS).distinct())
    return incoming.join(small, KEYS, "left_anti"), incoming.join(small, KEYS, "left_semi")


def land(
    incoming: DataFrame,
    root: str,
    landed: DataFrame | None = None,
    force: bool = False,
    clustered: bool = False,
    forced: DataFrame | None = None,
) -> DataFrame:
    """Land ``incoming`` and report one row per partition: ``landed`` or ``skipped``.

    ``landed`` is the manifest from before this call, by default what the folder
    holds, so that landing the same rows again adds nothing. A landed partition is left
    alone unless ``force`` asks to replace it, or ``forced`` (year, month) names it. The status compares with ``landed``
    alone, so it does not change with the files this call writes. ``clustered``
    input is copied without a shuffle.
    """
    counts = incoming.groupBy(*KEYS).agg(F.count("*").alias("rows"))
    if landed is None:
        # Taken down before anything is written: replaced files can't be listed any more.
        spark = incoming.sparkSession
        landed = write_table(landed_partitions(spark, root), work_dir(spark, "landed"))
    before = landed.select(*KEYS).distinct()
    if force:
        write_partitions(incoming, root, KEYS, replace=True, clustered=clustered)
        return counts.withColumn("status", F.lit("landed"))
    if forced is not None:
        before = before.join(forced.select(*KEYS), KEYS, "left_anti")
    fresh, _ = split_incoming(incoming, before)
    write_partitions(fresh, root, KEYS, replace=forced is not None, clustered=clustered)
    known = before.withColumn("known", F.lit(True))
    status = F.when(F.col("known"), "skipped").otherwise("landed")
    return counts.join(known, KEYS, "left").select(*KEYS, "rows", status.alias("status"))


def latest_partition(landed: DataFrame) -> DataFrame:
    """The newest landed ``(year, month)`` as a one-row table."""
    return landed.agg(F.max(F.struct(*KEYS)).alias("latest")).select("latest.*")
