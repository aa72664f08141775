"""The daily gold table from hive-partitioned trips and weather, month by month as they change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mendwell.operators.medallion import stage_trips, stage_weather, trips_daily_from_staging
from mendwell.session import broadcast_if_small, remove_folder
from mendwell.sources.files import scan_partitions, stored, write_partitions, write_table
from mendwell.sources.footers import list_files, path_part

KEYS = ["year", "month"]
MANIFEST = "dataset STRING, year INT, month INT, files LONG, bytes LONG, mark DECIMAL(38,0)"


@dataclass(frozen=True)
class Layout:
    """Where the partitioned tables lie; the gold folder also keeps the manifests of its builds."""

    trips: str
    weather: str
    gold: str
    trips_schema: StructType
    weather_schema: StructType


def partition_manifest(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Files, bytes and a mark for each month of each dataset, from the listing alone; any changed file changes the mark."""
    out = spark.createDataFrame([], MANIFEST)
    for name, root in roots.items():
        listed = list_files(spark, root, modified=True).select("*", *[path_part(F.col("path"), k).alias(k) for k in KEYS]).dropna(subset=KEYS)
        mark = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")).cast("decimal(38,0)")
        months = listed.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), mark.alias("mark"))
        out = out.unionByName(months.withColumn("dataset", F.lit(name)))
    return out


def changed_months(now: DataFrame, before: DataFrame) -> DataFrame:
    """``year, month`` of the months with a dataset that is new, gone or different."""
    then = before.select("dataset", *KEYS, F.col("mark").alias("_was"))
    both = now.select("dataset", *KEYS, "mark").join(then, ["dataset", *KEYS], "full_outer")
    return both.filter(~F.col("mark").eqNullSafe(F.col("_was"))).select(*KEYS).distinct()


def gold_of_months(spark: SparkSession, layout: Layout, months: DataFrame | None = None) -> DataFrame:
    """Daily trips per zone with ``year, month``; ``months`` is a small table of the partitions to read.

    A trip counts in the month that it was ingested for, so its partition also tells the
    weather it meets, and both scans read the folders of ``months`` only.
    """
    trips = scan_partitions(spark, layout.trips, layout.trips_schema, gate=False)
    weather = scan_partitions(spark, layout.weather, layout.weather_schema, gate=False)
    if months is not None:
        # Spark prunes partitions at run time only by a side with a selective condition.
        wanted = broadcast_if_small(months.select(*KEYS).filter(F.col("month").between(1, 12)))
        trips, weather = (d.join(wanted, KEYS, "left_semi") for d in (trips, weather))
    daily = trips_daily_from_staging(stage_trips(trips), stage_weather(weather))
    return daily.select("*", F.year("pickup_date").alias("year"), F.month("pickup_date").alias("month"))


def _builds(spark: SparkSession, gold: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{gold}/_manifest")
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return []
    done = lambda s: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder) if done(s))


def build_gold(spark: SparkSession, layout: Layout) -> DataFrame:
    """Bring the gold table up to date; returns the ``year, month`` that were built.

    Only months whose files differ from the last build's manifest are read, and their gold partitions replaced.
    The new manifest is written last, so a build that breaks off is done again.
    """
    now = stored(partition_manifest(spark, {"trips": layout.trips, "weather": layout.weather}), "manifest")
    builds = _builds(spark, layout.gold)
    before = spark.read.schema(MANIFEST).parquet(f"{layout.gold}/_manifest/build={builds[-1]}") if builds else spark.createDataFrame([], MANIFEST)
    months = stored(changed_months(now, before), "changed-months")
    # Both datasets of a month may be gone, but a month that is left has to be read as a whole.
    present = now.select(*KEYS).distinct()
    fresh = stored(gold_of_months(spark, layout, months.join(present, KEYS, "left_semi")), "gold-months")
    write_partitions(fresh, layout.gold, KEYS, replace=True)
    # Months without any trip left; one row per calendar month.
    for r in months.join(fresh.select(*KEYS).distinct(), KEYS, "left_anti").collect():
        remove_folder(spark, f"{layout.gold}/year={r['year']}/month={r['month']}")
    number = builds[-1] + 1 if builds else 0
    write_table(now, f"{layout.gold}/_manifest/build={number}")
    for old in builds:
        remove_folder(spark, f"{layout.gold}/_manifest/build={old}")
    return months
