"""Declarative data-quality checks.

Row checks are violation conditions. All row checks of a table are counted in
one pass over it; checks that need their own grouping or join add one each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mendwell.functions.scalars import after_slack
from mendwell.session import broadcast_if_small
from mendwell.sources.files import stored
from mendwell.sources.footers import file_counts, path_part, plain_path

# Accepted boroughs of the zone dimension.
BOROUGHS = ["EWR", "Queens", "Bronx", "Manhattan", "Staten Island", "Brooklyn", "Unknown"]


# --- row conditions: true where the row violates the check ---------------------


def is_missing(column: str) -> Column:
    return F.col(column).isNull()


def not_accepted(column: str, values: list) -> Column:
    """Value outside the list; null passes."""
    return F.coalesce(~F.col(column).isin(values), F.lit(False))


def not_between(
    column: str,
    low: float | None = None,
    high: float | None = None,
    condition: Column | None = None,
    strictly: bool = False,
) -> Column:
    """Value outside the range where ``condition`` holds; bounds belong to the range unless ``strictly``."""
    value, outside = F.col(column), F.lit(False)
    if low is not None:
        outside = outside | (value <= low if strictly else value < low)
    if high is not None:
        outside = outside | (value >= high if strictly else value > high)
    if condition is not None:
        outside = condition & outside
    return F.coalesce(outside, F.lit(False))


def in_future(column: str, now: datetime, slack_hours: int = 24) -> Column:
    return F.coalesce(after_slack(F.col(column), now, slack_hours), F.lit(False))


# --- table checks: violating rows or groups --------------------------------------


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur more than once; keys with a null are ignored."""
    keyed = df.select(*columns).dropna()
    return keyed.groupBy(*columns).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def orphans(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Child rows whose non-null key has no parent.

    A parent that is not provably small is reduced to distinct keys and joined
    by shuffle, where a hot child key is split at run time.
    """
    keys = parent.select(F.col(field).alias("_parent_key")).dropna().distinct()
    rows = child.filter(F.col(column).isNotNull())
    return rows.join(broadcast_if_small(keys), F.col(column) == F.col("_parent_key"), "left_anti")


def row_count_outside(df: DataFrame, expected: float, tolerance_pct: float = 10) -> DataFrame:
    """The row count, when it is outside ``expected`` by more than the tolerance."""
    low, high = expected * (1 - tolerance_pct / 100.0), expected * (1 + tolerance_pct / 100.0)
    counted = df.agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") < low) | (F.col("n") > high))


def partition_counts_outside(
    df: DataFrame, dataset: list[str], partition: str, previous: int = 3, tolerance_pct: float = 10
) -> DataFrame:
    """Partitions whose row count strays from the mean of the ``previous`` ones."""
    counts = df.groupBy(*dataset, partition).agg(F.count("*").alias("n"))
    window = Window.partitionBy(*dataset).orderBy(partition).rowsBetween(-previous, -1)
    compared = counts.withColumn("expected", F.avg("n").over(window))
    share = tolerance_pct / 100.0
    low, high = F.col("expected") * (1 - share), F.col("expected") * (1 + share)
    return compared.filter((F.col("n") < low) | (F.col("n") > high))


def empty_partitions(expected: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Expected partitions without a single row."""
    return expected.join(df.select(*keys).distinct(), keys, "left_anti")


# --- suite -------------------------------------------------------------------


@dataclass(frozen=True)
class RowCheck:
    name: str
    target: str
    violation: Column
    severity: str = "error"


@dataclass(frozen=True)
class TableCheck:
    name: str
    target: str
    violations: Callable[[dict[str, DataFrame]], DataFrame]
    severity: str = "error"


@dataclass(frozen=True)
class NonEmptyCheck:
    """Fails when the table has no rows."""

    name: str
    target: str
    severity: str = "error"


Check = RowCheck | TableCheck | NonEmptyCheck


def _result(check: Check, failures: Column) -> Column:
    return F.struct(
        F.lit(check.name).alias("check_name"),
        F.lit(check.target).alias("target"),
        F.lit(check.severity).alias("severity"),
        failures.cast("bigint").alias("failures"),
        (failures == 0).alias("passed"),
    )


def run_suite(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """One row per check: name, target, severity, failure count, passed."""
    parts = []
    for target in dict.fromkeys(c.target for c in checks):
        mine = [c for c in checks if c.target == target]
        counted = [c for c in mine if not isinstance(c, TableCheck)]
        if counted:
            aggs = [
                F.count_if(c.violation).alias(f"f{i}")
                if isinstance(c, RowCheck)
                else F.when(F.count("*") == 0, 1).otherwise(0).alias(f"f{i}")
                for i, c in enumerate(counted)
            ]
            one_pass = tables[target].agg(*aggs)
            results = F.array(*[_result(c, F.col(f"f{i}")) for i, c in enumerate(counted)])
            parts.append(one_pass.select(F.inline(results)))
        for check in mine:
            if isinstance(check, TableCheck):
                total = check.violations(tables).agg(F.count("*").alias("f"))
                parts.append(total.select(F.inline(F.array(_result(check, F.col("f"))))))
    return reduce(DataFrame.unionByName, parts)


def suite_samples(df: DataFrame, checks: list[RowCheck], row_hash: Column | None = None, most: int = 3) -> DataFrame:
    """``check_name, target, failures, sample_rows``: row checks of one table with up to ``most`` of the rows that fail each.

    The sample is the failing row of the smallest hash in each residue class of ``most``, so it depends on the rows alone. The hashes
    are aggregated in the same pass as the counts, and the few rows are fetched by them. Both passes filter first, by the conditions
    and by the few hashes, so that Spark can leave other rows out before the joins that ``df`` is made of. ``row_hash`` is a
    long, by default a hash of all columns; rows are maps from column to text, equal ones once.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns) if row_hash is None else row_hash)
    place = F.pmod("_hash", F.lit(most))
    aggs, failing = [], F.lit(False)
    for i, c in enumerate(checks):
        bad = F.coalesce(c.violation, F.lit(False))
        failing = failing | bad
        aggs.append(F.count_if(bad).alias(f"f{i}"))
        aggs += [F.min(F.when(bad & (place == j), F.col("_hash"))).alias(f"h{i}_{j}") for j in range(most)]
    rows = [
        F.struct(F.lit(c.name).alias("check_name"), F.lit(c.target).alias("target"), F.col(f"f{i}").cast("bigint").alias("failures"), F.array_compact(F.array(*[f"h{i}_{j}" for j in range(most)])).alias("_hashes"))
        for i, c in enumerate(checks)
    ]
    counted = stored(hashed.filter(failing).agg(*aggs).select(F.inline(F.array(*rows))), "suite-counts")
    wanted = counted.select("check_name", "target", F.explode("_hashes").alias("_hash"))
    # At most ``most`` numbers for each check.
    few = [r["_hash"] for r in wanted.select("_hash").distinct().collect()]
    row = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("string") for c in df.columns]))
    fetched = hashed.filter(F.col("_hash").isin(few)).select("_hash", row.alias("_row")).join(F.broadcast(wanted), "_hash")
    lists = fetched.groupBy("check_name", "target", "_hash").agg(F.first("_row").alias("_row")).groupBy("check_name", "target").agg(F.sort_array(F.collect_list(F.struct("_hash", F.map_entries("_row").alias("_row")))).alias("_rows"))
    sample = F.transform("_rows", lambda r: F.map_from_entries(r["_row"]))
    none = F.array().cast("array<map<string,string>>")
    return counted.join(lists, ["check_name", "target"], "left").select("check_name", "target", "failures", F.coalesce(sample, none).alias("sample_rows"))


def not_null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null count of every column in one pass, one row per column."""
    counted = df.agg(*[F.count_if(is_missing(c)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures")) for c in columns])
    return counted.select(F.inline(rows))


# Files whose data is read by name where their footers lack counts; beyond that the table is scanned.
MAX_NAMED_FILES = 1_000


def counts_from_footers(spark: SparkSession, root: str, schema: StructType, keys: list[str]) -> DataFrame:
    """``*keys, column, rows, nulls`` of a hive-partitioned Parquet table without reading its data.

    Rows and nulls come from the statistics in the footers. Only files whose statistics lack the nulls of some
    column are read, and only their columns of flat types.
    """
    columns = [f.name for f in schema.fields if f.name not in keys]
    parts = [path_part(F.col("path"), k).alias(k) for k in keys]
    told = stored(file_counts(spark, root), "footer-counts")
    nulls = F.map_from_entries(F.transform("nulls", lambda c: F.struct(c["name"], c["nulls"])))
    known = told.select("path", *parts, "rows", nulls.alias("_known")).select(
        "path", *keys, "rows", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.try_element_at("_known", F.lit(c)).alias("nulls")) for c in columns]))
    )
    gaps = known.filter(F.col("nulls").isNull()).select("path").distinct()
    named = [r["path"] for r in gaps.limit(MAX_NAMED_FILES + 1).collect()]
    if named:
        # The base path tells the partition columns of single files.
        plain = StructType([f for f in schema.fields if f.name not in keys])
        scan = spark.read.schema(plain).option("basePath", root)
        data = scan.parquet(*named) if len(named) <= MAX_NAMED_FILES else scan.parquet(root)
        counted = data.groupBy(plain_path(F.col("_metadata.file_path")).alias("_file")).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        read = counted.select("_file", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("_read")) for c in columns])))
        # Files without rows give none here.
        known = known.withColumn("_file", plain_path(F.col("path"))).join(read, ["_file", "column"], "left")
        known = known.withColumn("nulls", F.coalesce("nulls", "_read", F.lit(0)))
    return known.groupBy(*keys, "column").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"))


def suite_events(summary: DataFrame, at: Column) -> DataFrame:
    """Check outcomes as metric events, passes included."""
    return summary.select(
        at.alias("ts"), "check_name", F.when(F.col("passed"), "pass").otherwise("fail").alias("result")
    )
