"""Partition calendar, freshness and per-partition profiles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendwell.functions.scalars import month_start, next_month


def calendar_end(now: Column, end_offset: int = -1) -> Column:
    """Last monthly partition at ``now``: the last completed month, moved by the offset."""
    return F.add_months(month_start(now), end_offset - 1)


def partition_calendar(bounds: DataFrame, end_offset: int = -1) -> DataFrame:
    """Monthly partitions for each row ``(..., start, now)`` of ``bounds``."""
    keep = [c for c in bounds.columns if c not in ("start", "now")]
    start, end = month_start(F.col("start")), calendar_end(F.col("now"), end_offset)
    months = F.when(start <= end, F.sequence(start, end, F.expr("interval 1 month")))
    dated = bounds.select(*keep, F.explode(months).alias("partition_date"))
    return dated.select(
        *keep,
        "partition_date",
        F.date_format("partition_date", "yyyy-MM-dd").alias("partition_key"),
        F.year("partition_date").alias("year"),
        F.month("partition_date").alias("month"),
    )


def missing_partitions(expected: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(landed.select(*keys).distinct(), keys, "left_anti")


def next_partition(landed: DataFrame, today: date, group: list[str] | None = None) -> DataFrame:
    """The month after the newest landed one, unless it is not expected before today."""
    latest = landed.groupBy(*(group or [])).agg(F.max("partition_date").alias("latest"))
    candidate = latest.withColumn("candidate", next_month(F.col("latest")))
    return candidate.filter(F.col("candidate") <= F.date_sub(F.lit(today), 1))


def unpublished_filter(candidates: DataFrame, published: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that upstream has published."""
    return candidates.join(published.select(*keys).distinct(), keys, "left_semi")


def partition_profile(df: DataFrame, keys: list[str], ts_aliases: list[str]) -> DataFrame:
    """Rows and time bounds of every partition in one pass.

    The time column is the first alias present, cast leniently; a table without
    one still gets its row counts.
    """
    column = next((c for c in ts_aliases if c in df.columns), None)
    ts = F.lit(None).cast("timestamp_ntz") if column is None else F.col(column).try_cast("timestamp_ntz")
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min(ts).alias("pickup_min"), F.max(ts).alias("pickup_max")
    )
