"""Tables between two steps: written where driver and executors share a folder, so that a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to how many bytes, as JSON, a table is sent to every executor.
BROADCAST_BYTES = 32 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def place(spark: SparkSession, name: str) -> str:
    """A new path: in the folder that spark.checkpoint.dir names, or a temporary one where a local master has none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or tempfile.gettempdir()}/tallyforge-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go as soon as it has ended, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that is read again; it goes when the JVM ends."""
    spark = df.sparkSession
    path = place(spark, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(side: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A join's side, hinted for broadcast if it was counted to be small enough; beyond that Spark joins by the key.

    For sides such as a bank's checks, whose size nothing bounds but which Spark can't tell either: unhinted, it would shuffle the answers.
    """
    size = side.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64).alias("size")).first()["size"] or 0
    return F.broadcast(side) if size <= limit else side
