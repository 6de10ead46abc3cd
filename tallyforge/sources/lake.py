"""A table of Parquet files that is changed by parts: new files beside the old ones, and a manifest that says which count.

A lake is a folder. Files lie in folders of their own for each write and part; `_manifest/<version>.json` names, for each part, the folders that
hold it. A version is committed by creating its manifest, which fails if another writer was first; until then nothing that was written counts, so
a job that ends in between leaves the lake as it was, and can be run again. Files that no manifest names are left for whoever cleans up.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cleaned

class Overtaken(RuntimeError):
    """Another writer committed the version that this one was to be."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, lake: str) -> list[int]:
    at, fs = _fs(spark, f"{lake}/_manifest")
    if not fs.exists(at):
        return []
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, lake: str, version: int | None = None) -> dict:
    """The manifest of a version, by default the last: version, schema and the folders of each part."""
    known = versions(spark, lake)
    if version is None and not known:
        return {"version": 0, "schema": None, "parts": {}}
    at, fs = _fs(spark, f"{lake}/_manifest/{known[-1] if version is None else version:012d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def commit(spark: SparkSession, lake: str, found: dict) -> None:
    at, fs = _fs(spark, f"{lake}/_manifest/{found['version']:012d}.json")
    try:
        stream = fs.create(at, False)
    except Exception as e:  # the file system's own exception, through the gateway
        raise Overtaken(f"version {found['version']} of {lake} is there already") from e
    stream.write(json.dumps(found).encode())
    stream.close()


def read(spark: SparkSession, lake: str, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
    """The rows of a version, or of some of its parts (codes as part_code() gives them): no other files are listed or read."""
    found = manifest(spark, lake, version)
    if found["schema"] is None:
        raise FileNotFoundError(f"no version of {lake}")
    paths = [f"{lake}/{folder}" for code, folders in found["parts"].items() if parts is None or code in parts for folder in folders]
    return spark.read.schema(found["schema"]).parquet(*paths) if paths else spark.createDataFrame([], found["schema"])


def part_code(column: str):
    """A part's name in paths: of any value, null included."""
    return F.substring(F.sha2(F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")), 256), 1, 16)


def ddl_of(rows: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)


def upsert(rows: DataFrame, lake: str, keys: list[str], part: str) -> int:
    """Rows replace those with equal keys and are added otherwise; the lake's version afterwards, the same if there are no rows.

    Only parts that rows fall into are read and written: a row's part is that of the row it replaces. Keys are unique, and not null.
    """
    spark = rows.sparkSession
    before, name = manifest(spark, lake), uuid.uuid4().hex[:12]
    data, rest = (f"v{before['version'] + 1}-{name}{x}" for x in ("", "-kept"))
    ddl = ddl_of(rows)
    if before["schema"] not in (None, ddl):
        raise ValueError(f"rows have other columns than {lake}")
    write(rows.withColumn("_part", part_code(part)), f"{lake}/{data}")
    touched = folders(spark, f"{lake}/{data}")
    if not touched:
        remove(spark, f"{lake}/{data}")
        return before["version"]
    old, kept = [c for c in touched if c in before["parts"]], []
    if old:  # rows that stay go to files of their own: nothing is written twice
        fresh = spark.read.schema(ddl).parquet(*[f"{lake}/{data}/_part={c}" for c in touched]).select(*keys)
        write(read(spark, lake, before["version"], old).join(fresh, keys, "left_anti").select(*rows.columns).withColumn("_part", part_code(part)), f"{lake}/{rest}")
        kept = folders(spark, f"{lake}/{rest}")
    parts = before["parts"] | {c: [f"{data}/_part={c}", *([f"{rest}/_part={c}"] if c in kept else [])] for c in touched}
    commit(spark, lake, {"version": before["version"] + 1, "schema": ddl, "parts": parts})
    return before["version"] + 1


def write(rows: DataFrame, path: str) -> None:
    """Rows in a folder for each part; the shuffle files behind them go when they are written."""
    with cleaned(rows.sparkSession):
        rows.write.option("compression", "zstd").partitionBy("_part").parquet(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The parts that a write made, a folder for each."""
    at, fs = _fs(spark, path)
    return sorted(f.getPath().getName().removeprefix("_part=") for f in fs.listStatus(at) if f.isDirectory() and f.getPath().getName().startswith("_part="))


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)
