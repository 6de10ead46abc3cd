"""How many files the operators write."""

from pathlib import Path

import corpus_pipeline
from tallyforge.llm import neighbours, shared


def test_small_tables_are_few_files(spark, tmp_path, monkeypatch):
    """Each file of a local folder costs a process that counts with a JVM's whole memory; many shuffle partitions made as many files."""
    paths, new = [], shared.new_path
    monkeypatch.setattr(shared, "new_path", lambda *a: paths.append(new(*a)) or paths[-1])
    conf = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").write.parquet(out := f"{tmp_path}/{name}")
            paths.append(out)
            docs = spark.read.parquet(out)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {p: len(list(Path(p.removeprefix("file:")).glob("part-*"))) for p in paths}
    assert len(files) > 8 and max(files.values()) <= 12, files
    own = [p for p in paths if not p.startswith(str(tmp_path))]
    assert own and not any((Path(p.removeprefix("file:")) / "_SUCCESS").exists() for p in own)


def test_neighbours_tables_start_no_process_of_the_driver(spark, monkeypatch):
    paths, new = [], shared.new_path
    monkeypatch.setattr(shared, "new_path", lambda *a: paths.append(new(*a)) or paths[-1])
    rows = [(i, [float(i % 7 + 1), float(i % 11), 1.0]) for i in range(120)]
    assert neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 15
    assert len(paths) == 4 and not any((Path(p.removeprefix("file:")) / "_SUCCESS").exists() for p in paths)


def test_tables_folders_start_no_process(spark, tmp_path, monkeypatch):
    """Hadoop starts a chmod for each local folder that it makes, which counts with the whole memory of the driver; a table had three."""
    paths, new = [], shared.new_path
    monkeypatch.setattr(shared, "new_path", lambda *a: paths.append(new(*a)) or paths[-1])
    rows = [(i, [float(i % 7 + 1), float(i % 11), 1.0]) for i in range(120)]
    jfr, file = spark.sparkContext._jvm.jdk.jfr, spark.sparkContext._jvm.java.io.File(f"{tmp_path}/processes.jfr")
    recording = jfr.Recording()
    try:
        recording.enable("jdk.ProcessStart").withoutStackTrace()
        recording.start()
        assert neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 15
        spark.range(3).write.parquet(f"{tmp_path}/seen")
        recording.stop()
        recording.dump(file.toPath())
    finally:
        recording.close()
    events = jfr.consumer.RecordingFile.readAllEvents(file.toPath())
    started = [e.getString("command") for e in events]
    folders = {f"{p.removeprefix('file:')}{x}" for p in paths for x in ("", "/_temporary", "/_temporary/0")}
    assert any(x.endswith("/seen/_temporary/0") for x in started)  # such processes are seen
    assert len(paths) == 4 and not [x for x in started if x.split()[-1] in folders]
    for p in paths:
        folder = Path(p.removeprefix("file:"))
        assert list(folder.glob("part-*")) and not (folder / "_temporary").exists() and folder.stat().st_mode & 0o777 == 0o755
