"""A trial log as a streaming sink: a Python data source whose epochs are committed, so that each trial stands once whatever is lost when.

Tasks write Parquet files under `data/`; an epoch counts once `commits/<epoch>.json`, which names its files, has been moved into place. A file
that no commit names was left by a lost task or a job that ended early, and is never read. An epoch that is run again after its commit keeps the
files of the first run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.storage import filesystem


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class LogWriter(DataSourceStreamArrowWriter):
    """write() runs in tasks, commit() and abort() once an epoch."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        name, writer, rows = f"data/{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if writer is None and batch.num_rows:
                    fs.create_dir(f"{root}/data", recursive=True)
                    writer = pa.parquet.ParquetWriter(fs.open_output_stream(f"{root}/{name}"), batch.schema)
                if batch.num_rows:
                    writer.write_batch(batch)
                rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(name if writer is not None else None, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803  (the interface's name)
        fs, root = filesystem(self.path)
        place = f"{root}/commits/{batchId:012d}.json"
        if fs.get_file_info(place).type != pa.fs.FileType.NotFound:
            self.abort(messages, batchId)
            return
        files = [m.file for m in messages if m is not None and m.file is not None]
        fs.create_dir(f"{root}/commits", recursive=True)
        draft = f"{root}/_draft-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps({"epoch": batchId, "files": files, "rows": sum(m.rows for m in messages if m is not None)}).encode())
        fs.move(draft, place)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        """Deletes what an epoch wrote, unless its commit names it: Spark aborts as well where a commit succeeded and its answer was lost."""
        fs, root = filesystem(self.path)
        place, kept = f"{root}/commits/{batchId:012d}.json", []
        if fs.get_file_info(place).type != pa.fs.FileType.NotFound:
            with fs.open_input_stream(place) as f:
                kept = json.loads(f.read())["files"]
        for m in messages:
            if m is not None and m.file is not None and m.file not in kept:
                fs.delete_file(f"{root}/{m.file}")


class TrialLog(DataSource):
    """Format trial_log; option path: the log's folder, which driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "trial_log"

    def streamWriter(self, schema: StructType, overwrite: bool) -> LogWriter:  # noqa: N802
        return LogWriter(self.options["path"])


def write_log(rows: DataFrame, path: str, checkpoint: str, source: type[DataSource] = TrialLog) -> StreamingQuery:
    """Append a stream to a log, to the end of what there is; a stream belongs to one checkpoint and one log."""
    rows.sparkSession.dataSource.register(source)
    q = rows.writeStream.format(source.name()).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def commits(spark: SparkSession, path: str) -> DataFrame:
    """epoch, files and rows of every committed epoch."""
    return spark.read.schema("epoch long, files array<string>, rows long").json(f"{path}/commits")


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all committed epochs; no file beyond theirs is looked at."""
    files = [r["file"] for r in commits(spark, path).select(F.explode("files").alias("file")).collect()]  # a name for each task that wrote
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in files]) if files else spark.createDataFrame([], schema)
