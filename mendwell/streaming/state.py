"""Log-structured state of a stream: per-bucket snapshots and the deltas of the batches after them.

Each batch writes one delta. Every few batches the deltas of committed batches are merged with the snapshots of the
buckets they touch, and what is superseded is removed, so reading the state costs one snapshot
of each bucket and a few deltas, however many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mendwell.session import remove_folder


@dataclass(frozen=True)
class StateLog:
    """State with one row per ``keys`` below ``root``; ``merge`` gives one row per key of several and may be repeated.

    ``buckets`` and ``every`` (batches between compactions) stay as they are for the life of a state.
    """

    spark: SparkSession
    root: str
    schema: StructType
    keys: tuple[str, ...]
    merge: Callable[[DataFrame], DataFrame]
    buckets: int = 16
    every: int = 8

    # --- folders ---

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _folders(self, path: str, key: str) -> dict[int, str]:
        """Folders ``key=number`` below ``path``."""
        folder, fs = self._fs(path)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return {int(n.split("=")[1]): f"{path}/{n}" for n in names if n.startswith(f"{key}=")}

    def _complete(self, path: str) -> bool:
        """Whether the write of a folder was committed as a whole."""
        folder, fs = self._fs(f"{path}/_SUCCESS")
        return fs.exists(folder)

    def _snapshots(self) -> dict[int, tuple[int, str]]:
        """For each bucket the last batch that its newest complete snapshot holds, and the folder."""
        newest: dict[int, tuple[int, str]] = {}
        for upto, path in sorted(self._folders(f"{self.root}/snapshot", "upto").items()):
            if self._complete(path):
                newest |= {b: (upto, p) for b, p in self._folders(path, "bucket").items()}
        return newest

    def compacted(self) -> int:
        """The last batch that snapshots hold, -1 without any."""
        done = [upto for upto, path in self._folders(f"{self.root}/snapshot", "upto").items() if self._complete(path)]
        return max(done, default=-1)

    def _deltas(self, upto: int | None) -> dict[int, str]:
        """Deltas of the batches after the last compaction, up to ``upto``."""
        low = self.compacted()
        return {b: p for b, p in self._folders(f"{self.root}/delta", "batch_id").items() if b > low and (upto is None or b <= upto)}

    # --- reading and writing ---

    def _scan(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def read(self, upto: int | None = None) -> DataFrame:
        """One row per key of all batches, or of those up to ``upto``, which has to lie after the last compaction."""
        paths = [p for _, p in self._snapshots().values()] + list(self._deltas(upto).values())
        return self.merge(self._scan(paths))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The delta of a batch; written again it is replaced. Due deltas of the batches before, which are committed, are compacted first."""
        if batch_id - 1 - self.compacted() >= self.every:
            self.compact(batch_id - 1)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        placed = rows.select(*self.schema.names).withColumn("bucket", bucket)
        placed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/delta/batch_id={batch_id}")

    def compact(self, upto: int) -> None:
        """Merge deltas up to ``upto`` into new snapshots of the buckets they touch, then remove what these supersede."""
        snapshots, deltas = self._snapshots(), self._deltas(upto)
        touched = {b: [] for path in deltas.values() for b in self._folders(path, "bucket")}
        for path in deltas.values():
            for b, p in self._folders(path, "bucket").items():
                touched[b].append(p)
        paths = [p for b, held in touched.items() for p in [*held, *([snapshots[b][1]] if b in snapshots else [])]]
        merged = self.merge(self._scan(paths))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        target = f"{self.root}/snapshot/upto={upto}"
        merged.select(*self.schema.names).withColumn("bucket", bucket).repartition(F.col("bucket")).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(target)
        for b in touched:
            if b in snapshots:
                remove_folder(self.spark, snapshots[b][1])
        for batch, path in self._folders(f"{self.root}/delta", "batch_id").items():
            if batch <= upto:
                remove_folder(self.spark, path)
        for other, path in self._folders(f"{self.root}/snapshot", "upto").items():
            if other != upto and not self._folders(path, "bucket"):
                remove_folder(self.spark, path)
