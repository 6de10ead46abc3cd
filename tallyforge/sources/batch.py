"""Task banks, registries and result files as batch data sources: a partition for each file, filters taken to the files.

What a file's name tells (a bank's module; whether a result file is judged) decides which files are planned; what a row tells (a trial's
module or task) is tested in the task that reads it, before the row leaves Python. Equality and IN are taken, all else stays with Spark.
Paths are folders or single files that driver and executors share. A file that isn't what its name says is an error that names it.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from typing import Any, BinaryIO

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not

from .. import schema
from .storage import filesystem

CHUNK = 1 << 20


@dataclass
class File(InputPartition):
    path: str

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


class FileReader(DataSourceReader):
    """Plans files by the columns that their names tell (facts); a subclass reads one."""

    pattern = "*"
    #: Columns whose filters are taken.
    known: tuple[str, ...] = ()

    def __init__(self, path: str):
        self.path, self.tests = path, []

    def facts(self, name: str) -> dict[str, Any]:
        return {}

    def keeps(self, told: dict[str, Any]) -> bool:
        return all(told[c] is not None and told[c] in values for c, values in self.tests if c in told)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  (the interface's name)
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if isinstance(f, Not) and isinstance(inner, EqualTo) and isinstance(inner.value, bool):  # how Spark says that a truth value is false
                inner = EqualTo(inner.attribute, not inner.value)
            elif isinstance(f, Not) or not isinstance(f, (EqualTo, In)):
                inner = None
            if inner is not None and len(inner.attribute) == 1 and inner.attribute[0] in self.known:
                self.tests.append((inner.attribute[0], [inner.value] if isinstance(inner, EqualTo) else list(inner.value)))
            else:
                yield f

    def partitions(self) -> list[File]:
        fs, root = filesystem(self.path)
        found = fs.get_file_info(root)
        if found.type == pyarrow.fs.FileType.File:
            files = [found]
        else:
            files = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
        wanted = [f.path for f in files if f.type == pyarrow.fs.FileType.File and fnmatchcase(f.base_name, self.pattern)]
        return [File(p) for p in sorted(wanted) if self.keeps(self.facts(File(p).name))]

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads where nothing is planned
            return
        fs, _ = filesystem(self.path)
        try:
            yield from self.rows(fs, partition)
        except ValueError as e:
            raise ValueError(f"{partition.path}: {e}") from e

    def rows(self, fs: pyarrow.fs.FileSystem, file: File) -> Iterator[tuple]:
        raise NotImplementedError


def yaml_entries(fs: pyarrow.fs.FileSystem, path: str, key: str, bare: bool = False) -> Iterator[Any]:
    """The entries of a YAML document's list under a key (bare: or of a document that is a list), one after the other: of a file of any size one entry is held, and what has an anchor."""
    import yaml
    from yaml.composer import Composer, ComposerError

    base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    # The parser in C puts whole documents together; Composer does so a node at a time.
    bases = (Composer, base) if base is not yaml.SafeLoader else (base,)

    class Loader(*bases):
        def __init__(self, stream: Any):
            base.__init__(self, stream)
            Composer.__init__(self)

        def whole(self) -> Any:
            return self.construct_document(self.compose_node(None, None))

        def entries(self) -> Iterator[Any]:
            if not self.check_event(yaml.SequenceStartEvent) or self.peek_event().anchor is not None:
                yield from self.whole() or []
                return
            self.get_event()
            while not self.check_event(yaml.SequenceEndEvent):
                yield self.whole()
            self.get_event()

    def top_keys() -> list[str | None]:
        """The keys of a document that is a mapping. The last of equal ones counts, and a merge (<<) may bring keys, so both are known before entries leave."""
        keys, depth, at = [], 0, 0
        with fs.open_input_stream(path) as f:
            for event in yaml.parse(f, base):
                if isinstance(event, yaml.CollectionEndEvent):
                    depth -= 1
                    if depth == 0:
                        break
                elif isinstance(event, yaml.NodeEvent):
                    if depth == 0 and not isinstance(event, yaml.MappingStartEvent):
                        return []
                    if depth == 1:
                        keys += [event.value if isinstance(event, yaml.ScalarEvent) else None] if at % 2 == 0 else []
                        at += 1
                    depth += isinstance(event, yaml.CollectionStartEvent)
        return keys

    try:
        keys = top_keys()
        with fs.open_input_stream(path) as f:
            loader = Loader(f)
            loader.get_event()
            if loader.check_event(yaml.StreamEndEvent):
                return
            loader.get_event()
            if loader.check_event(yaml.MappingStartEvent) and loader.peek_event().anchor is None and "<<" not in keys and None not in keys:
                last = len(keys) - 1 - keys[::-1].index(key) if key in keys else -1
                loader.get_event()
                for i in range(len(keys)):
                    loader.whole()
                    if i == last:
                        yield from loader.entries()
                    else:
                        loader.whole()  # its anchors may be meant below
                loader.get_event()
            elif bare and loader.check_event(yaml.SequenceStartEvent):
                yield from loader.entries()
            else:
                found = loader.whole() or {}
                yield from (found.get(key) or []) if isinstance(found, dict) or not bare else found
            loader.get_event()
            if not loader.check_event(yaml.StreamEndEvent):
                raise ComposerError("expected a single document", None, "but found another", loader.peek_event().start_mark)
    except yaml.YAMLError as e:
        raise ValueError(f"no YAML: {e}") from e


def infer_tier(module: str, task: dict) -> str:
    if "tier" in task:
        return task["tier"]
    if module == "tools":
        return "baseline" if task.get("axis") == "call" else "hard"
    if module == "code":
        return "hard" if task.get("buggy_code") else "baseline"
    return "baseline" if module in ("format", "knowledge") else "hard"


def infer_band(task: dict) -> str:
    return task.get("band") or {"easy": "anchor", "hard": "hard"}.get(task.get("difficulty", "medium"), "mid")


class TaskReader(FileReader):
    """Tasks of a bank's files, one for each module; only the wanted modules' files are opened. Tier and band are inferred."""

    pattern, known = "*.yaml", ("module", "fast")

    def facts(self, name: str) -> dict[str, Any]:
        return {"module": name.removesuffix(".yaml")}

    def rows(self, fs: pyarrow.fs.FileSystem, file: File) -> Iterator[tuple]:
        module = file.name.removesuffix(".yaml")
        for t in yaml_entries(fs, file.path, "tasks", bare=True):
            if not self.keeps({"fast": bool(t.get("fast"))}):
                continue
            yield (
                t.get("id"), module, t.get("axis"), t.get("prompt"), t.get("system_prompt"), t.get("difficulty", "medium"), infer_tier(module, t), infer_band(t),
                bool(t.get("fast")), t.get("max_tokens"), t.get("answer_type"), json.dumps(t.get("expected", {})), [json.dumps(c) for c in t.get("constraints") or []],
                t.get("tools") or [], t.get("optimal_turns"), "", "",
            )


class ModelReader(FileReader):
    """Entries of a registry that have a name."""

    pattern, known = "*.yaml", ("name",)

    def rows(self, fs: pyarrow.fs.FileSystem, file: File) -> Iterator[tuple]:
        kinds = [c.split() for c in schema.MODEL.split(", ")]
        value = lambda e, c, t: None if e.get(c) is None else float(e[c]) if t == "double" else str(e[c])
        for e in yaml_entries(fs, file.path, "models"):
            if e.get("name") and self.keeps({"name": str(e["name"])}):
                yield tuple(value(e, c, t) for c, t in kinds)


class Walk:
    """A JSON document value by value, holding one value and what was read ahead."""

    decoder = json.JSONDecoder()

    def __init__(self, stream: BinaryIO, chunk: int = CHUNK):
        self.stream, self.chunk, self.text, self.at = io.TextIOWrapper(stream, "utf-8-sig"), chunk, "", 0

    def more(self) -> bool:
        """Reads as much again as is waiting, so that a long value is tried a few times only."""
        got = self.stream.read(max(self.chunk, len(self.text) - self.at))
        self.text, self.at = self.text[self.at :] + got, 0
        return bool(got)

    def mark(self) -> str:
        """The next character that isn't blank; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, mark: str) -> None:
        if self.mark() != mark:
            raise ValueError(f"no JSON of the kind looked for: {mark!r} is missing")
        self.at += 1

    def value(self) -> tuple[Any, str]:
        """The next value and its text."""
        self.mark()
        while True:
            try:
                found, end = self.decoder.raw_decode(self.text, self.at)
            except json.JSONDecodeError:
                if not self.more():
                    raise
                continue
            size = end - self.at
            if len(self.text) - end < 3 and self.more():  # a number may go on: of 1e+5 what was read may end after 1, e or +
                continue
            text = self.text[self.at : self.at + size]
            self.at += size
            return found, text

    def several(self, opening: str, closing: str) -> Iterator[int]:
        """Counts the members of an object or array; whoever iterates takes each."""
        self.take(opening)
        n = 0
        if self.mark() != closing:
            while True:
                yield n
                n += 1
                if self.mark() != ",":
                    break
                self.take(",")
        self.take(closing)

    def fields(self) -> Iterator[str]:
        for _ in self.several("{", "}"):
            name, _ = self.value()
            self.take(":")
            yield name


class ResultReader(FileReader):
    """Trials of result files as texts, one after the other: a file of any size is never held whole."""

    pattern, known = "*_raw_results*.json", ("source_file", "judged", "module", "task_id")

    def facts(self, name: str) -> dict[str, Any]:
        return {"source_file": name, "judged": name.endswith("_judged.json")}

    def rows(self, fs: pyarrow.fs.FileSystem, file: File) -> Iterator[tuple]:
        model = None
        with fs.open_input_stream(file.path) as stream:
            walk = Walk(stream)
            for name in walk.fields():
                if name == "meta":
                    model = (walk.value()[0] or {}).get("model")
                    break
                self.past(walk, name)
        with fs.open_input_stream(file.path) as stream:
            walk = Walk(stream)
            for name in walk.fields():
                if name != "results" or walk.mark() != "[":
                    walk.value()
                    continue
                for seq in walk.several("[", "]"):
                    trial, text = walk.value()
                    if isinstance(trial, dict) and self.keeps({c: trial.get(c) for c in ("module", "task_id")}):
                        yield file.name, file.name.endswith("_judged.json"), model, seq, trial.get("module"), trial.get("task_id"), text
            if walk.mark():
                raise ValueError("something follows the document")

    @staticmethod
    def past(walk: Walk, name: str) -> None:
        if name == "results" and walk.mark() == "[":
            for _ in walk.several("[", "]"):
                walk.value()
        else:
            walk.value()


class FileSource(DataSource):
    """Format of one kind of files; option path."""

    reads: type[FileReader]
    ddl = ""

    @classmethod
    def name(cls) -> str:
        return cls.__name__

    def schema(self) -> str:
        return self.ddl

    def reader(self, schema: Any) -> FileReader:
        return self.reads(self.options["path"])


class TaskBank(FileSource):
    reads, ddl = TaskReader, schema.TASK


class ModelRegistry(FileSource):
    reads, ddl = ModelReader, schema.MODEL


class TrialResults(FileSource):
    reads, ddl = ResultReader, "source_file string, judged boolean, model string, trial_seq long, module string, task_id string, trial string"


def read(spark: SparkSession, source: type[FileSource], path: str) -> DataFrame:
    """The rows of a source's files. Spark plans later than this, so its filter push-down to Python stays on for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load(path)
