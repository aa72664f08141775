"""Parquet, CSV and JSON reading and writing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendwell.operators.drift import missing_columns
from mendwell.session import work_dir
from mendwell.sources.footers import file_schemas, path_part

ZONE_SEED = T.StructType(
    [
        T.StructField("LocationID", T.IntegerType()),
        T.StructField("Borough", T.StringType()),
        T.StructField("Zone", T.StringType()),
        T.StructField("service_zone", T.StringType()),
    ]
)


class SchemaGateError(ValueError):
    """Some files lack expected columns, which Spark would read as nulls."""


def scan_partitions(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    partitions: Iterable[tuple[int, int]] | None = None,
    gate: bool = True,
) -> DataFrame:
    """Scan ``root/year=/month=`` with a fixed schema, pruned to ``partitions``.

    A column renamed in one partition reads as nulls in Spark. The gate compares
    the Parquet footers with the schema first and stops on any missing column.
    """
    chosen = None if partitions is None else list(partitions)

    def wanted(path: str | None = None) -> Column:
        """Condition on the partition columns, or on a path that spells them."""
        keep = F.lit(False)
        for year, month in chosen:
            parts = [F.col(k) if path is None else path_part(F.col(path), k) for k in ("year", "month")]
            keep = keep | ((parts[0] == year) & (parts[1] == month))
        return keep

    if gate:
        expected = [f.name for f in schema.fields if f.name not in ("year", "month")]
        footers = file_schemas(spark, root, None if chosen is None else wanted("path"))
        gaps = missing_columns(footers, expected).limit(5).collect()
        if gaps:
            shown = ", ".join(f"{g['path']}: {g['missing_column']}" for g in gaps)
            raise SchemaGateError(f"files without expected columns: {shown}")
    df = spark.read.schema(schema).parquet(root)
    return df if chosen is None else df.filter(wanted())


def read_seed(spark: SparkSession, path: str, schema: T.StructType = ZONE_SEED) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_partitions(
    df: DataFrame, root: str, keys: list[str], replace: bool = False, clustered: bool = False
) -> None:
    """Write zstd Parquet by ``keys``; ``replace`` swaps only the partitions present in ``df``.

    The rebalance hint groups rows by partition for few files and splits a
    partition that is much larger than the others over several tasks. Input that
    is already ``clustered``, such as files of single partitions, is not shuffled.
    """
    placed = df if clustered else df.hint("rebalance", *[F.col(k) for k in keys])
    writer = placed.write.option("compression", "zstd").partitionBy(*keys)
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)
    else:
        writer.mode("append").parquet(root)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Materialize ``df`` at ``path`` and return a scan of what was written."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table that several jobs read: computed once and written to the work folder."""
    return write_table(df, work_dir(df.sparkSession, name))


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Register a staging result as a lazy view for SQL."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def write_reports(reports: DataFrame, root: str) -> None:
    """Append report rows ``(incident_id, report_date, report)`` as text JSON by date."""
    line = F.to_json(F.struct("incident_id", "report"))
    reports.select(line.alias("value"), "report_date").write.mode("append").partitionBy("report_date").text(root)


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    schema = "incident_id STRING, report STRING"
    parsed = F.from_json("value", schema)
    return spark.read.schema("value STRING, report_date DATE").text(root).select(parsed.alias("r")).select("r.*")
