"""Reading and writing result files, registries, checkpoints and logs. A model's name is quoted, never trusted as a path."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..operators.board import prefer_judged
from . import batch


def load_results(spark: SparkSession, path: str, judged: bool | None = None, modules: list[str] | None = None) -> DataFrame:
    """Trials of all result files under a path, with their run's model, file and position; of some modules, if these are given.

    Files that aren't wanted aren't opened, and other modules' trials are dropped where a file is read, a trial at a time.
    """
    found = batch.read(spark, batch.TrialResults, path)
    if judged is not None:
        found = found.filter(F.col("judged") == F.lit(judged))
    if modules:
        found = found.filter(F.col("module").isin(modules))
    flat = found.select("model", "source_file", "trial_seq", F.from_json("trial", schema.TRIAL).alias("r")).select("model", "source_file", "trial_seq", "r.*")
    return schema.with_defaults(flat, schema.TRIAL_DEFAULTS)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schema.RESULT_FILE).option("multiLine", True).option("pathGlobFilter", "*_raw_results*.json").json(path)
    return schema.with_defaults(raw.select("meta.*", F.col("_metadata.file_name").alias("source_file")), schema.RUN_DEFAULTS)


def load_preferred(spark: SparkSession, path: str, modules: list[str] | None = None) -> DataFrame:
    """Trials of each run's judged file, or of its raw one; the files' names are listed without reading any."""
    named = spark.read.format("binaryFile").option("pathGlobFilter", "*_raw_results*.json").load(path).select(F.substring_index("path", "/", -1).alias("file"))
    return load_results(spark, path, modules=modules).join(prefer_judged(named).select(F.col("file").alias("source_file")), "source_file", "left_semi")


def save_trials(trials: DataFrame, path: str) -> None:
    """The lake: Parquet by model, so that boards read what they need."""
    trials.write.mode("append").partitionBy("model").parquet(path)


def save_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """The models' registry from YAML; a missing file is an empty registry."""
    return batch.read(spark, batch.ModelRegistry, path)


def load_tasks(spark: SparkSession, folder: str, modules: list[str] | None = None, fast: bool = False) -> DataFrame:
    """The task bank, a YAML file for each module; only the wanted modules' files are read. Tier and band are inferred."""
    tasks = batch.read(spark, batch.TaskBank, folder)
    if modules:
        tasks = tasks.filter(F.col("module").isin(modules))
    if fast:
        tasks = tasks.filter("fast")
    key = F.to_json(F.struct(*[c for c in tasks.columns if c not in ("fast", "task_hash", "world_hash")]))
    return tasks.withColumn("task_hash", F.substring(F.sha2(key, 256), 1, 16))


def same_header(fingerprint: dict[str, str], head: Column) -> Column:
    """Whether a header line tells every key of the fingerprint as it is wanted."""
    told = F.from_json(head, "map<string,string>")
    return F.forall(F.array(*[F.coalesce(told[F.lit(k)] == F.lit(v), F.lit(False)) for k, v in fingerprint.items()]), lambda x: x)


def log_rows(lines: DataFrame, fingerprint: dict[str, str], ddl: str) -> DataFrame:
    """Rows of an append-only JSON log (file, line_no, value): a header that must fit, then trials up to the first torn line.

    A header that doesn't fit leaves nothing, and so does a file without one. Files are logs of their own. What is known of a file is one
    row, put together from partial aggregates, so a file's lines need not meet in one task.
    """
    told = lines.groupBy("file").agg(
        F.min(F.when(F.try_parse_json("value").isNull(), F.col("line_no"))).alias("torn"), F.max(F.when(F.col("line_no") == 0, F.col("value"))).alias("head")
    ).filter(same_header(fingerprint, F.col("head")))
    whole = lines.join(told, "file").filter("line_no > 0 AND (torn IS NULL OR line_no < torn)")
    return whole.select("file", "line_no", F.from_json("value", ddl).alias("row")).select("file", "line_no", "row.*")


def log_lines(spark: SparkSession, path: str, fits: Callable[[Column], Column]) -> DataFrame:
    """file, line_no and value of the lines after the header (line 0) and before the first torn one, of those logs whose header fits.

    A log of any length is read in splits by any number of tasks. Lines of a split are numbered as they are read, so a split's number of
    lines, its first torn line and (from the first split) the header are one row, and a running sum over a file's splits tells the number of
    each line. Lines are joined to their own split's row: no task holds more of a log than a split, and a split's lines
    come in their order. The text source lists the files once.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_name").alias("file"),
        F.monotonically_increasing_id().alias("seq"), "value",
    )
    splits = raw.groupBy("path", "split").agg(
        F.count("*").alias("lines"), F.min("seq").alias("first"), F.min(F.when(F.try_parse_json("value").isNull(), F.col("seq"))).alias("bad"),
        F.min_by(F.when(F.col("split") == 0, F.col("value")), "seq").alias("head"),
    )
    own = Window.partitionBy("path")
    before = F.coalesce(F.sum("lines").over(own.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = splits.withColumn("before", before)
    told = numbered.select("path", "split", (F.col("before") - F.col("first")).alias("shift"), F.min(F.col("before") + F.col("bad") - F.col("first")).over(own).alias("torn"), F.max("head").over(own).alias("head"))
    wanted = told.filter(fits(F.col("head"))).drop("head")
    lines = raw.join(wanted, ["path", "split"]).withColumn("line_no", F.col("seq") + F.col("shift"))
    return lines.filter("line_no > 0 AND (torn IS NULL OR line_no < torn)").select("file", "line_no", "value").sortWithinPartitions("file", "line_no")


def read_log(spark: SparkSession, path: str, fingerprint: dict[str, str], ddl: str) -> DataFrame:
    """The rows of a log, or of all logs in a folder; see log_lines."""
    lines = log_lines(spark, path, lambda head: same_header(fingerprint, head))
    return lines.select("file", "line_no", F.from_json("value", ddl).alias("row")).select("file", "line_no", "row.*")


class TrialLog:
    """An append-only log of a run's finished trials: a header with the run's fingerprint, then a JSON line for each.

    Every line is on disk before the next trial begins, so a run that dies leaves all but its last. ``discard`` goes with the
    results file: a log that is still there means that a run did not finish.
    """

    def __init__(self, path: str | Path, fingerprint: dict[str, Any]):
        self.path, self.fingerprint = Path(path), fingerprint

    def __enter__(self) -> TrialLog:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.file = self.path.open("a", encoding="utf-8")
        if not self.file.tell():
            self.append({"__checkpoint__": self.fingerprint})
        return self

    def append(self, row: dict[str, Any]) -> None:
        self.file.write(json.dumps(row, default=str) + "\n")
        self.file.flush()
        os.fsync(self.file.fileno())

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def discard(self) -> None:
        self.file.close()
        self.path.unlink(missing_ok=True)


def log_path(results: str | Path) -> Path:
    return Path(f"{results}.partial.jsonl")


#: What has to be the same for trials of two sessions to be one run. Where the model was served is no part of it.
SAME_RUN = ("model", "profile", "thinking", "temperature", "seed", "max_tokens", "max_tokens_override", "bench_version")


def run_fingerprint(settings: dict[str, Any]) -> dict[str, Any]:
    return {name: settings.get(name) for name in SAME_RUN}


def plain(settings: Column) -> Column:
    """Settings (JSON) as a text that is the same for equal settings, whatever their order; where a model was served is no part of it."""
    told = F.try_parse_json(settings).cast("map<string,variant>")
    return F.to_json(F.transform_values(F.map_filter(told, lambda k, v: k != "endpoint"), lambda k, v: F.to_json(v)))


def read_trial_log(spark: SparkSession, path: str, fingerprint: dict[str, Any], ddl: str = schema.TRIAL) -> DataFrame:
    """Trials of an interrupted run: none if the log is another run's, and none from the first torn line on."""
    fits = lambda head: F.coalesce(plain(F.get_json_object(head, "$.__checkpoint__")) == plain(F.lit(json.dumps(fingerprint))), F.lit(False))
    return log_lines(spark, path, fits).select("file", "line_no", F.from_json("value", ddl).alias("row")).select("file", "line_no", "row.*")


def append_log(path: str | Path, row: dict[str, Any]) -> None:
    """A line more in a log that is only ever appended to; it is stamped in UTC."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("a", encoding="utf-8") as f:
        f.write(json.dumps({"at": datetime.now(UTC).isoformat(timespec="seconds")} | row, default=str) + "\n")


def find_tasks_dir(*bases: str | Path) -> Path:
    """The first folder `tasks` below the given places (here, then beside the package)."""
    places = [Path(b) / "tasks" for b in bases or (Path.cwd(), Path(__file__).resolve().parents[2])]
    found = next((p for p in places if p.is_dir()), None)
    if found is None:
        raise FileNotFoundError(f"no folder of tasks: {', '.join(map(str, places))}")
    return found


def candidate_fingerprint(folder: str | Path, module: str) -> str:
    """Twelve digits that change with a module's task file; empty without one."""
    file = Path(folder) / f"{module}.yaml"
    return hashlib.sha256(file.read_bytes()).hexdigest()[:12] if file.exists() else ""


def read_expectation(folder: str | Path, module: str, task_id: str) -> dict | None:
    """What a candidate's author said beforehand that the probe would show."""
    import yaml

    file = Path(folder) / f"{module}.yaml"
    data = (yaml.safe_load(file.read_text()) or {}) if file.exists() else {}
    return next((t.get("probe_expect") for t in data.get("tasks", []) if t.get("id") == task_id), None)


def slug(name: str) -> str:
    return re.sub(r"[^\w.-]", "_", name)


def probe_paths(root: str | Path, task_id: str) -> dict[str, Path]:
    return {"tasks": Path(root) / "tasks", "run": Path(root) / "runs" / slug(task_id), "log": Path(root) / "log.jsonl"}


def assert_outside(path: str | Path, results: str | Path) -> None:
    """Refuses a path within the results, where a probe's files would pass for a run's."""
    own, kept = Path(path).resolve(), Path(results).resolve()
    if own.is_relative_to(kept):
        raise ValueError(f"{own} is inside the results {kept}")


def served_context(body: Column) -> Column:
    """The context window that a server's properties (JSON) tell; null if they tell none. Asking the server is the caller's part."""
    n = F.get_json_object(body, "$.default_generation_settings.n_ctx").try_cast("long")
    return F.when(n > 0, n)


def context_urls(endpoint: str, model: str) -> list[str]:
    """Where a server may tell its properties, in the order to try."""
    root = re.sub(r"/v1/?$", "", endpoint.rstrip("/"))
    return [f"{root}/props", f"{root}/upstream/{model}/props"]


def save_board(rows: DataFrame, path: str | Path, **more: Any) -> None:
    """The board as one JSON document; it has a row for each model."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(more | {"rows": [json.loads(r) for r in rows.toJSON().collect()]}, indent=2, ensure_ascii=False))


def cycles_for(log: DataFrame, task_id: str) -> DataFrame:
    """How often a task was probed with a valid verdict, over lines that parse (value)."""
    row = F.from_json("value", "task_id string, verdict string")
    return log.select(row.alias("r")).filter((F.col("r.task_id") == task_id) & (F.col("r.verdict") != "INVALID")).agg(F.count("*").alias("cycles"))
