"""A listing state in hash partitions with a manifest per version, so that a micro-batch rewrites only what it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import state
from ..session import drop
from .market import latest_in_batch

PARTITIONS = 64


class StateTable:
    """A table keyed by ``key``: ``data``/v=n/part=p holds partition p as of version n, ``manifest``/v=n names each partition's version.

    Version n is what its manifest says and nothing else; the manifest is written last, so a version exists as a whole
    or not at all, and writing it again gives the same files' places.  Versions before the last but one are dropped.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "listing_id", partitions: int = PARTITIONS):
        self.spark, self.path, self.schema, self.key, self.partitions = spark, path.rstrip("/"), schema, key, partitions

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.partitions)).cast("int")

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/v={version}"

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, files = self._files(f"{path}/_SUCCESS")
        return files.exists(at)

    def _written(self, path: str) -> set[int]:
        at, files = self._files(path)
        names = [f.getPath().getName() for f in files.listStatus(at)]
        return {int(n.removeprefix("part=")) for n in names if n.startswith("part=")}

    def versions(self, version: int) -> dict[int, int]:
        """Partition to the version that wrote it: at most ``partitions`` entries."""
        if version == 0 or not self._exists(self._manifest(version)):
            if version:
                raise FileNotFoundError(f"version {version} of {self.path} has no manifest")
            return {}
        return {r.part: r.version for r in self.spark.read.parquet(self._manifest(version)).collect()}

    def read(self, version: int, parts: list[int] | None = None) -> DataFrame:
        """The table at ``version``, or those of its partitions."""
        held = {p: v for p, v in self.versions(version).items() if parts is None or p in parts}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        files = [f"{self.path}/data/v={v}/part={p}" for p, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*files)

    def update(self, version: int, batch: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Make ``version`` + 1 by folding ``batch`` into the partitions that it touches; these are returned."""
        before = self.versions(version)
        touched = sorted(r[0] for r in batch.select(self.part()).distinct().collect())
        written: set[int] = set()
        if touched:
            made = fold(self.read(version, touched), batch).select(*self.schema.names)
            to = f"{self.path}/data/v={version + 1}"
            made.withColumn("part", self.part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(to)
            written = self._written(to)
        now = {p: v for p, v in before.items() if p not in touched} | {p: version + 1 for p in written}
        rows = self.spark.createDataFrame(sorted(now.items()), "part int, version int")
        rows.coalesce(1).write.mode("overwrite").parquet(self._manifest(version + 1))
        self._forget(version - 1, before)
        return touched

    def _forget(self, version: int, kept: dict[int, int]) -> None:
        """Drop what only ``version`` named: the next one, which ``kept`` describes, may have to be folded again."""
        if version < 1 or not self._exists(self._manifest(version)):
            return
        for part, written in self.versions(version).items():
            if kept.get(part) != written:
                drop(self.spark, f"{self.path}/data/v={written}/part={part}")
        drop(self.spark, self._manifest(version))


def upsert_stream(rows: DataFrame, table: StateTable, log_dir: str, checkpoint: str) -> StreamingQuery:
    """Fold a stream of listing rows into ``table``, version n + 1 by micro-batch n, each row at its own time.

    Transitions go to ``log_dir``/batch=n.  A batch that failed runs again over the same rows and the same
    version, and overwrites what it had begun.
    """

    def fold(batch: DataFrame, n: int) -> None:
        latest = latest_in_batch(batch).persist()
        log: list[DataFrame] = []

        def upserted(before: DataFrame, new: DataFrame) -> DataFrame:
            log.append(state.upsert(before, new))
            return log[0]

        table.update(n, latest, upserted)
        told = state.transitions(log[0], F.col("last_seen")) if log else None
        if told is not None:
            told.write.mode("overwrite").parquet(f"{log_dir}/batch={n}")
        latest.unpersist()

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
