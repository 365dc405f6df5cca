"""The Spark session and the tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lotlens")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, most: int) -> None:
    """Let no Arrow batch sent to a Python worker outgrow ``most`` bytes; a lower bound that is set already stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).lower().removesuffix("b")
    if not held.isdigit() or not 0 < int(held) <= most:
        spark.conf.set(name, str(most))


_written: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share.

    Only a local session without that setting gets a temporary folder, which is then set; elsewhere
    a missing setting is an error, as each machine would write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lotlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the reader of those files.

    Lineage ends there: a lost executor costs a re-read, not a recomputation.  The shuffle files of the
    write go as soon as it has ended, as nothing reads them again.  The folders are removed when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_tables: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the read-only tables of ``sf_dir``, written the first time an application asks for it.

    Later queries read it from the shared folder, as they would a table that a nightly job keeps.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        made = materialise(build(), name)
        _tables[key] = (_written[-1][1], made.schema)
    path, schema = _tables[key]
    return spark.read.schema(schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop(spark, path)
        except Exception:  # the JVM may have ended already; the folder is then the cluster's to clear
            return
