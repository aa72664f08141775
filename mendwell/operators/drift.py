"""Schema fingerprints and schema drift, from per-file column lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mendwell.functions.scalars import short_hash


def schema_fingerprint(files: DataFrame) -> DataFrame:
    """Add a 16-digit fingerprint of every file's ordered ``name:type`` list."""
    pairs = F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["dtype"]))
    return files.withColumn("n_columns", F.size("columns").cast("long")).withColumn(
        "schema_fingerprint", short_hash(F.array_join(pairs, ","))
    )


def missing_columns(files: DataFrame, expected: list[str]) -> DataFrame:
    """One row per file and expected column that the file lacks."""
    names = F.transform("columns", lambda c: c["name"])
    wanted = F.array(*[F.lit(c) for c in expected]) if expected else F.array().cast("array<string>")
    return files.select("path", F.explode(F.array_except(wanted, names)).alias("missing_column"))


def schema_drift(files: DataFrame, dataset: str, partition: str) -> DataFrame:
    """Compare the schemas of all files of every partition with those of the partition before it.

    ``files`` has ``columns`` per file plus the two key columns. The fingerprint of a
    partition is that of its files, or of all their fingerprints where they disagree (``n_schemas``).
    ``added`` are columns that some file before lacks and some file now has,
    ``removed`` those that some file before has and some file now lacks; both are empty without a change.
    """
    key = [dataset, partition]
    printed = schema_fingerprint(files)
    prints = F.sort_array(F.collect_set("schema_fingerprint"))
    each = printed.groupBy(*key).agg(F.count("*").alias("_files"), prints.alias("_prints"))
    pair = F.explode(F.array_distinct(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["dtype"]))))
    held = printed.select(*key, pair.alias("_pair")).groupBy(*key, "_pair").agg(F.count("*").alias("_n"))
    some = held.join(each.select(*key, "_files"), key).groupBy(*key).agg(
        F.sort_array(F.collect_list("_pair")).alias("_some"),
        F.sort_array(F.collect_list(F.when(F.col("_n") == F.col("_files"), F.col("_pair")))).alias("_all"),
    )
    print_ = F.when(F.size("_prints") == 1, F.col("_prints")[0]).otherwise(short_hash(F.array_join("_prints", ",")))
    per_partition = each.join(some, key, "left").select(
        *key, print_.alias("schema_fingerprint"), F.size("_prints").cast("long").alias("n_schemas"), "_some", "_all"
    )
    order = Window.partitionBy(dataset).orderBy(partition)
    before = per_partition.select(
        "*",
        F.lag("schema_fingerprint").over(order).alias("previous_fingerprint"),
        F.lag("_some").over(order).alias("_some_before"),
        F.lag("_all").over(order).alias("_all_before"),
    )
    changed = F.coalesce(F.col("schema_fingerprint") != F.col("previous_fingerprint"), F.lit(False))
    none = F.array().cast("array<string>")
    return before.select(
        dataset,
        partition,
        "schema_fingerprint",
        "previous_fingerprint",
        "n_schemas",
        changed.alias("changed"),
        F.when(changed, F.array_except("_some", "_all_before")).otherwise(none).alias("added"),
        F.when(changed, F.array_except("_some_before", "_all")).otherwise(none).alias("removed"),
    )
