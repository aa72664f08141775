"""Tables with one row per key, in hash buckets: writes replace rows of touched buckets only, lookups read one bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from mendwell.sources.files import stored, write_partitions
from mendwell.sources.footers import list_files

BUCKETS = 64


@dataclass(frozen=True)
class KeyedStore:
    """Rows of ``schema`` below ``root``. The number of buckets stays as it is for the life of a store.

    ``order`` names the columns by which the last of several rows of one key is told; without it a batch
    must not repeat keys, and later batches replace earlier ones.
    """

    spark: SparkSession
    root: str
    schema: StructType
    key: str
    order: tuple[str, ...] = ()
    buckets: int = BUCKETS

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        """All rows, with their ``bucket``."""
        full = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        if list_files(self.spark, self.root).isEmpty():
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.root)

    def lookup(self, key) -> DataFrame:
        """The row of one key; other buckets are pruned before anything is read."""
        found = self.read().filter((F.col("bucket") == self._bucket(F.lit(key))) & (F.col(self.key) == key))
        return found.drop("bucket")

    def upsert(self, rows: DataFrame) -> None:
        """Add rows, or replace those of their keys; writing the same rows again changes nothing.

        Only buckets that ``rows`` touches are read and replaced, each as a whole.
        """
        fresh = rows.select(*self.schema.names).withColumn("bucket", self._bucket(F.col(self.key)))
        fresh = stored(fresh, "upsert")
        # At most one number for each bucket; the condition lets Spark prune the others at run time.
        touched = fresh.select("bucket").distinct().filter(F.col("bucket").between(0, self.buckets - 1))
        old = self.read().join(F.broadcast(touched), "bucket", "left_semi")
        if self.order:
            last = F.struct(*[F.col(c) for c in self.order])
            merged = old.unionByName(fresh).groupBy(self.key).agg(F.max_by(F.struct("*"), last).alias("_last")).select("_last.*")
        else:
            merged = old.join(fresh.select(self.key), self.key, "left_anti").unionByName(fresh)
        # Written aside first: a bucket is read before it is replaced.
        write_partitions(stored(merged, "merged"), self.root, ["bucket"], replace=True)
