"""Per-file schemas from Parquet footers, read on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path STRING, columns ARRAY<STRUCT<name: STRING, dtype: STRING>>"
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("columns", pa.list_(pa.struct([("name", pa.string()), ("dtype", pa.string())]))),
    ]
)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _read_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("path").to_pylist()
        columns = []
        for path in paths:
            filesystem, name = _open(path)
            schema = pq.read_schema(name, filesystem=filesystem)
            columns.append([{"name": f.name, "dtype": str(f.type)} for f in schema])
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(columns, _ARROW.field("columns").type)], schema=_ARROW
        )


def list_files(spark: SparkSession, root: str, modified: bool = False) -> DataFrame:
    """Data files below ``root``, none if there is no such folder, ``modified`` with their times; contents are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], "path STRING, length BIGINT" + (", modificationTime TIMESTAMP" if modified else ""))
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(root)
        .select("path", "length", *(["modificationTime"] if modified else []))
    )


_COUNTS = "path STRING, rows LONG, nulls ARRAY<STRUCT<name: STRING, nulls: LONG>>"


def _read_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("name", pa.string()), ("nulls", pa.int64())]))
    for batch in batches:
        paths, rows, nulls = batch.column("path").to_pylist(), [], []
        for path in paths:
            filesystem, name = _open(path)
            with pq.ParquetFile(name, filesystem=filesystem) as file:
                meta = file.metadata
            rows.append(meta.num_rows)
            totals: dict = {}
            for g in range(meta.num_row_groups):
                for k in range(meta.num_columns):
                    column = meta.row_group(g).column(k)
                    told = column.statistics is not None and column.statistics.has_null_count
                    # A count that one row group lacks is unknown for the file.
                    before = totals.get(column.path_in_schema, 0)
                    totals[column.path_in_schema] = before + column.statistics.null_count if told and before is not None else None
            nulls.append([{"name": n, "nulls": v} for n, v in totals.items()])
        arrays = [pa.array(paths, pa.string()), pa.array(rows, pa.int64()), pa.array(nulls, kind)]
        yield pa.RecordBatch.from_arrays(arrays, names=["path", "rows", "nulls"])


def file_counts(spark: SparkSession, root: str) -> DataFrame:
    """``path, rows, nulls`` of every Parquet file from its footer; the nulls of a column are null where statistics lack them."""
    files = list_files(spark, root).select("path")
    return files.coalesce(spark.sparkContext.defaultParallelism * 4).mapInArrow(_read_counts, _COUNTS)


def plain_path(path: Column) -> Column:
    """Paths as scans and listings spell them differ in the slashes of local ones and in escapes."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, r"^file:/+", "file:/"), r"\+", "%2B"))


def path_part(path: Column, key: str) -> Column:
    """Value of the partition folder ``key=`` in a path."""
    return F.regexp_extract(path, rf"/{key}=(\d+)/", 1).try_cast("int")


def file_schemas(spark: SparkSession, root: str, wanted: Column | None = None) -> DataFrame:
    """One row per Parquet file: its path and its columns in file order.

    ``wanted`` is a condition on ``path`` that spares the footers of other files.
    """
    files = list_files(spark, root).select("path")
    if wanted is not None:
        files = files.filter(wanted)
    return files.coalesce(spark.sparkContext.defaultParallelism * 4).mapInArrow(_read_footers, _SCHEMA)
