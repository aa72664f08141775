"""Deterministic faults that turn good tables into bad ones.

Every fault is a lazy transform: nothing is written unless the caller writes the
result, and then to a scratch path, never over the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwell.operators.medallion import PICKUP_ALIASES, first_present
from mendwell.session import broadcast_if_small
from mendwell.sources.footers import file_counts, path_part, plain_path

# Renamed columns, null stride and kept share of the faults.
TRIP_RENAME = ("VendorID", "vendor_id_renamed")
WEATHER_RENAME = ("temperature_2m_mean", "temp_2m_mean")
NULL_STRIDE = 19
KEEP_SHARE = 0.05


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise ValueError(f"no column {old!r} to rename in {df.columns}")
    return df.withColumnRenamed(old, new)


def rename_trip_column(df: DataFrame) -> DataFrame:
    return rename_column(df, *TRIP_RENAME)


def rename_weather_column(df: DataFrame) -> DataFrame:
    return rename_column(df, *WEATHER_RENAME)


def file_ordinals(df: DataFrame, keys: list[str], name: str = "ordinal", root: str | None = None) -> DataFrame:
    """Number the rows of each partition of a Parquet scan from 0, in file order.

    A row's number is its position in its file plus the rows of the partition's
    earlier files. Rows stay where they are: only per-file counts are windowed. They are
    the rows of ``df``, which has to be a whole scan, or with ``root`` those that the footers of the
    files below it state, so that a filtered scan keeps the numbers of the whole one.
    """
    placed = df.select("*", plain_path(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    if root is None:
        counts = placed.groupBy(*keys, "_file").agg(F.count("*").alias("_rows"))
    else:
        stated = file_counts(df.sparkSession, root)
        counts = stated.select(*[path_part(F.col("path"), k).alias(k) for k in keys], plain_path(F.col("path")).alias("_file"), F.col("rows").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    numbered = placed.join(broadcast_if_small(offsets), "_file")
    return numbered.withColumn(name, F.col("_offset") + F.col("_row")).drop("_file", "_row", "_offset")


def null_spike(df: DataFrame, ordinal: Column, column: str | None = None) -> DataFrame:
    """Null the pickup column of every 19th row, the first one included."""
    target = column or first_present(df.columns, PICKUP_ALIASES)
    return df.withColumn(target, F.when(ordinal % NULL_STRIDE != 0, F.col(target)))


def volume_drop(df: DataFrame, ordinal: Column, keys: list[str] | None = None) -> DataFrame:
    """Keep the first 5 % of the rows, at least one; with ``keys`` of the rows of each partition."""
    keep = F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(KEEP_SHARE))).alias("_keep")
    if keys is None:
        return df.filter(ordinal < df.agg(keep).scalar())
    totals = df.groupBy(*keys).agg(keep)
    return df.withColumn("_ordinal", ordinal).join(broadcast_if_small(totals), keys).filter("_ordinal < _keep").select(*df.columns)
