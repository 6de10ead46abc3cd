"""What the operators of this package share: the shared folder, written intermediate tables, Arrow plumbing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: While a table is written, shuffle files go as soon as the query that wrote them has ended, and Arrow batches are small.
CLEANUP, BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000
#: Tables written here are read by the run that wrote them, which knows that they are whole: they need no _SUCCESS file.
MARK = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests).

    A cluster without that setting is refused, as its machines share no temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined() and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/tallyforge-{label}-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def make_folders(spark: SparkSession, path: str) -> None:
    """Make a table's folder and those that its writer asks for on the driver, with Hadoop's permissions, where the shared folder is local.

    Hadoop starts a process (chmod) for each local folder that it makes, which counts with the driver's whole memory until it has
    begun. Folders that are there it leaves alone.
    """
    jvm, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.Path(path)
    if at.getFileSystem(conf).getScheme() != "file":
        return
    kind = jvm.permission.FsPermission
    mode = kind.getDirDefault().applyUMask(kind.getUMask(conf)).toShort()
    made = at.toUri().getPath()
    os.makedirs(os.path.dirname(made), exist_ok=True)
    for folder in (made, f"{made}/_temporary", f"{made}/_temporary/0"):
        os.mkdir(folder)
        os.chmod(folder, mode)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = {name: spark.conf.get(name) for name in (CLEANUP, BATCH)}
    own = int(before[BATCH])
    try:
        spark.conf.set(CLEANUP, "true")
        spark.conf.set(BATCH, str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS))
        make_folders(spark, path)
        df.write.mode("append").option("compression", "zstd").option(MARK, "false").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches (Spark bounds their bytes) in parts of a few rows, so that few texts at a time become Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts whose strings in that column have about `size` bytes, or a single row."""
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // size
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows], strict=True):
            yield b.slice(a, z - a)


def parts_for(spark: SparkSession, n_bytes: int, each: int, least: int = 1) -> int:
    """Partitions of about `each` bytes."""
    return max(least, -(-int(n_bytes) // each))


def files_for(spark: SparkSession, n_bytes: int, each: int = 8 << 20) -> int:
    """Files that a table of so many bytes is worth: of about `each` bytes, but two for each core and 12 at least.

    Where shuffle partitions are many and small, a table is coalesced to these. In a local folder Hadoop starts a process for
    each file (chmod) and one for its checksums, which counts with the whole memory of the JVM until it has begun.
    """
    return parts_for(spark, n_bytes, each, max(12, 2 * spark.sparkContext.defaultParallelism))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    cast = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [x if x is not None else b"" for x in cast.to_pylist()]


def splits(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    return zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)


def columns_of(documents: DataFrame) -> list[str]:
    return list(documents.columns)


def unsigned_hex(column: Column) -> Column:
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
