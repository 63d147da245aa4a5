"""Session settings, shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most this many estimated bytes may be broadcast.
BROADCAST_BYTES = 8 << 20
#: Size of a file of a table that is written compactly.
FILE_BYTES = 64 << 20
#: Bytes in memory of a written byte, as a rule.
UNPACKED = 3


def build_session(app: str = "corvine", cpus: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine.

    What is written there goes into a folder of the application (see :func:`clear_scratch`); a temporary folder goes with the process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = getattr(scratch_root, "own", None)
        if root is None:
            own = tempfile.mkdtemp(prefix="corvine-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            root = scratch_root.own = "file://" + own
    return root.rstrip("/")


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; no frame made by :func:`materialize` may be read afterwards."""
    _delete(spark, f"{scratch_root(spark)}/corvine/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str = "step", row_bytes: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files survive lost executors, unlike cached blocks, and are columnar, unlike checkpointed RDDs.
    With ``row_bytes``, the rows are counted first and written to as few files as their size asks for; a small
    table that comes out of many tasks would else be many tiny files.
    """
    spark, rows = df.sparkSession, None
    path = f"{scratch_root(spark)}/corvine/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if row_bytes is None:
        df.write.parquet(path)
    else:
        held = df.persist()
        rows = held.count()
        held.coalesce(max(1, -(-rows * row_bytes // FILE_BYTES))).write.parquet(path)
        held.unpersist()
    out = spark.read.schema(df.schema).parquet(path)
    out._corvine_path, out._corvine_rows = path, rows
    return out


def row_count(df: DataFrame) -> int:
    """The rows of a frame made by :func:`materialize` with ``row_bytes``, which counted them; else a count."""
    rows = getattr(df, "_corvine_rows", None)
    return df.count() if rows is None else rows


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`materialize`; nothing may read it afterwards."""
    path = getattr(df, "_corvine_path", None)
    if path:
        _delete(df.sparkSession, path)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when ``rows * row_bytes`` is within the limit; else leave the join to a shuffle.

    Of a frame made by :func:`materialize` the written bytes count too, ``UNPACKED`` times, whatever was assumed of its rows.
    """
    size = rows * row_bytes
    path = getattr(df, "_corvine_path", None)
    if path and size <= limit:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        size = max(size, UNPACKED * p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength())
    return F.broadcast(df) if size <= limit else df


def few_rows_per_batch(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of long texts: so few rows that a batch stays small on either side of the Python workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of few rows, for long texts; what Arrow holds goes back to the system at the end."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()


def give_back() -> None:
    """Return what a training run on the driver freed to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
