"""Shared work folders, and tables that cut lineage there.

Driver and executors share only the folder named in ``spark.checkpoint.dir``; every intermediate table
goes there, so a lost executor costs a reread and nothing else.  As each table is written once and reread, the
shuffle files of its plan go as soon as it stands.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on one machine, as in tests.
LOCAL_DEFAULT = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.  A cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = LOCAL_DEFAULT
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch on its way to a worker, about; a single row may be longer.
BATCH_BYTES = 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Narrow rows of a file, and the fewest files, of tables whose size is known.
FILE_ROWS, FEWEST_FILES = 250_000, 8


class Workspace:
    """One call's folder of intermediate tables."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/strandweave-{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, rows: int | None = None, batch: int | None = None) -> DataFrame:
        """Write and reread, which cuts lineage.  A table known to have at most ``rows`` narrow rows is
        written in as few files as that takes; ``batch`` bounds the rows of the Arrow batches on the way."""
        if rows is not None:
            df = df.coalesce(max(FEWEST_FILES, -(-rows // FILE_ROWS)))
        own = {CLEANUP: "true", ARROW_BYTES: str(BATCH_BYTES)} | ({} if batch is None else {ARROW_ROWS: str(batch)})
        was = {k: self.spark.conf.get(k, None) for k in own}
        try:
            for k, v in own.items():
                self.spark.conf.set(k, v)
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            for k, v in was.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Delete all tables but those that the result is read from."""
        self.drop(*(self.names - set(names)))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The batch function of ``mapInArrow``, which gives the memory it has freed back to the system when its task
    ends: workers live on, and what one stage needed should not stand beside what the next one needs."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def partitions_for(df: DataFrame, mb: int = 32, at_least: int = 0) -> int:
    """Partitions of about ``mb`` MB of the plan's estimated input, never fewer than Spark's own setting."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if estimate > 1 << 50:  # Spark's "unknown"
        estimate = 0
    return max(shuffle, at_least, estimate // (mb << 20))
