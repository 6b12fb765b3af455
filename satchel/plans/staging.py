"""Tables staged in the folder that the driver and all executors share.

``checkpoint()`` computes its input twice and ``localCheckpoint()`` loses data with an
executor, so intermediate results that several jobs read are written as Parquet below
``spark.checkpoint.dir`` and read again.  The folder is read from the session; only a local
master without that setting (tests) gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str, str]] = []  # session, folder, scope
_SCOPE = [""]

ARROW_LIMIT, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
ARROW_SIZE, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Python workers give memory back instead of keeping what their largest task took: arrays from
#: 8 MB on are mapped apart, 64 MB stay for reuse, and Arrow takes its buffers from the same allocator.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(8 << 20), "MALLOC_TRIM_THRESHOLD_": str(64 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}

#: Rows and bytes up to which a table counts as small enough to be sent to every executor.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 32 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they share the driver's file system, and
    bound what goes to them at once and what they keep: unless the session has limits of its own,
    Arrow batches have ``ARROW_ROWS`` rows and ``ARROW_BYTES``, since rows are whole texts or blocks."""
    if spark.conf.get(ARROW_LIMIT) == "10000":
        spark.conf.set(ARROW_LIMIT, ARROW_ROWS)
    if int(spark.conf.get(ARROW_SIZE, str(2**31 - 1))) >= 64 << 20:
        spark.conf.set(ARROW_SIZE, ARROW_BYTES)
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    root = str(Path(__file__).resolve().parents[2])
    found = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in found.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, found)))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or a temporary one on a local master."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if master not in _LOCAL:
        _LOCAL[master] = tempfile.mkdtemp(prefix="satchel-")
    return "file://" + _LOCAL[master]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; deleted when the driver ends."""
    path = f"{shared_folder(spark)}/satchel-{uuid.uuid4().hex}/{label}"
    _WRITTEN.append((spark, path.rsplit("/", 1)[0], _SCOPE[-1]))
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(name: str) -> Iterator[None]:
    """What is staged inside can be dropped by this name."""
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


def drop_staged(spark: SparkSession, name: str | None = None) -> None:
    """Delete what this session has staged in the scope ``name``, or in all scopes."""
    rest = []
    for owner, path, of in _WRITTEN:
        if owner is not spark or name not in (None, of):
            rest.append((owner, path, of))
            continue
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN[:] = rest


@atexit.register
def _clean() -> None:
    for spark in {id(s): s for s, *_ in _WRITTEN}.values():
        try:
            drop_staged(spark)
        except Exception:  # the JVM may be gone already; the folder is scratch space
            return


def small(df: DataFrame, rows: int = BROADCAST_ROWS, width: int = 16) -> DataFrame:
    """Mark ``df`` (a staged table) for broadcast if its counted size is within the bound.

    ``width`` is an upper bound of a row's bytes.  Beyond the bound the table is returned as
    it is and the join shuffles.
    """
    n = df.count()
    return F.broadcast(df) if n <= rows and n * width <= BROADCAST_BYTES else df
