"""Words, stored tables and per-worker objects that the operators share."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendwell.session import work_dir

# The white space of a word boundary: space and the characters 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for null or a text of white space."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, so that no later job computes it again.

    A lost executor costs nothing that was written. ``batch`` is how many rows at a time go to Python
    while it is computed; whole texts go in short batches to bound the memory of a task.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    before = spark.conf.get(BATCH)
    if batch:
        spark.conf.set(BATCH, str(batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def as_uri(folder: str) -> str:
    """A folder's address as Arrow's file systems expect it; one without a scheme is local."""
    scheme, colon, path = folder.partition(":")
    if not colon:
        return f"file://{os.path.abspath(folder)}"
    return f"file:///{path.lstrip('/')}" if scheme == "file" else folder


def drop_stored(df: DataFrame) -> None:
    """Remove the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(values: Iterable, size_of, most: int) -> Iterator[list]:
    """Runs of consecutive values whose sizes sum to about ``most``; a larger value is a run of its own."""
    run, held = [], 0
    for value in values:
        run.append(value)
        held += size_of(value)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run
