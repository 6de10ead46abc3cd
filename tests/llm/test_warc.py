import gzip
import hashlib

import pytest
from pyspark.sql import functions as F
from tallyforge.llm import warc
from tallyforge.llm.shared import materialize, new_path

PAGES = [(1, "http://a/x y\n", "p" * 200), (2, "http://b", "p" * 200), (5, None, "é" * 60), (3, "u", "é" * 60), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 30), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 30), (None, "u", "p" * 200), (10, "u", "z" * 3_000_000)]
DDL = "page_id long, url string, html string, digest string, record_type string"


def pages(spark):
    return spark.createDataFrame([(*p, "x", "y") for p in PAGES], DDL).repartition(3)


def brute():
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        twins = [j for j, _, h in PAGES if (h or "").encode() == data and j is not None]
        first = min(twins) if len(data) >= 100 and twins else None
        revisit = first is not None and (i is None or i > first)
        out.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    assert sorted(((str(r[0]), *tuple(r)[1:]) for r in warc.round_trip(pages(spark)).collect()), key=repr) == brute()


@pytest.fixture(scope="module")
def archive(spark):
    path = new_path(spark, "test-warc")
    manifest = materialize(warc.write(warc.with_revisits(pages(spark)), path, roll=300), "manifest").collect()
    return path, manifest


def test_files_roll_over_and_are_plain_warc(archive):
    path, manifest = archive
    assert sum(r["records"] for r in manifest) == len(PAGES) and len(manifest) > 3
    for r in manifest:
        with gzip.open(f"{path.removeprefix('file:')}/{r['file']}") as f:
            data = f.read()
        assert data.count(b"\r\n\r\nWARC/1.1\r\nWARC-Type: ") + data.startswith(b"WARC/1.1\r\nWARC-Type: ") == r["records"]


def test_pushed_predicates_and_skipped_payloads(spark, archive):
    path, _ = archive
    every = warc.read(spark, path)
    assert every.count() == len(PAGES)
    revisits = every.filter("record_type = 'revisit'")
    assert revisits.count() == sum(b[3] == "revisit" for b in brute())
    plan = revisits._jdf.queryExecution().executedPlan().toString()
    assert "(record_type" not in plan.split("BatchScan")[0].replace("isnotnull(record_type", "")
    assert every.filter(F.col("record_id").isin("<urn:page:4>", "<urn:page:10>") & F.col("target_uri").startswith("u")).count() == 2
    assert warc.read(spark, path, payload=False).filter("payload IS NOT NULL").count() == 0
    assert every.filter("record_id = '<urn:page:10>'").select(F.octet_length("payload")).first()[0] == 3_000_000


def test_records_without_skip_lengths(tmp_path, spark):
    one = warc.record("response", "1", "http://a", "d", 3, b"abc", None)
    two = warc.record("response", "2", "http://b", "d", 100_000, b"q" * 100_000, None)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(one))
    assert [(r["target_uri"], len(r["payload"])) for r in warc.read(spark, str(tmp_path)).collect()] == [("http://a", 3), ("http://b", 100_000), ("http://a", 3)]
    assert warc.read(spark, str(tmp_path)).filter("target_uri = 'http://a'").count() == 2


def test_unwanted_payloads_are_not_read(tmp_path):
    import pyarrow.fs

    big = warc.member(warc.record("response", "1", "u", "d", 5_000_000, bytes(range(256)) * 20_000, None))
    (tmp_path / "y.warc.gz").write_bytes(big * 3)

    class Counting:
        def __init__(self, f):
            self.f, self.read_bytes = f, 0

        def read(self, n):
            data = self.f.read(n)
            self.read_bytes += len(data)
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

    with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "y.warc.gz")) as f:
        counting = Counting(f)
        assert list(warc.records_in(counting, lambda h: False, True)) == []
        assert counting.read_bytes <= 3 * 8192


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], DDL)).count() == 0
    assert warc.read(spark, new_path(spark, "none")).count() == 0


def test_members_of_many_records_and_plain_archives(spark, tmp_path):
    records = [warc.record("response", str(i), "u", "d", n, b"\r\n" * (n // 2), None) for i, n in enumerate((0, 10, 300_000, 8, 20_000, 2))]
    whole = b"".join(records)
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "some.warc.gz").write_bytes(gzip.compress(b"".join(records[:2])) + warc.member(records[2]) + gzip.compress(b"") + gzip.compress(b"".join(records[3:])))
    (tmp_path / "plain.warc").write_bytes(whole)
    want = sorted((f"<urn:page:{i}>", n) for i, n in enumerate((0, 10, 300_000, 8, 20_000, 2)))
    found = warc.read(spark, str(tmp_path))
    assert sorted(map(tuple, found.select("record_id", F.length("payload")).collect())) == sorted(want * 3)
    assert found.filter("record_id = '<urn:page:3>'").select("record_type").count() == 3
    assert warc.read(spark, str(tmp_path), payload=False).count() == 18


@pytest.mark.parametrize("name", ["cut.warc", "cut.warc.gz", "member.warc.gz"])
def test_archives_that_end_too_soon_are_errors(tmp_path, name):
    data = warc.record("response", "1", "u", "d", 900, bytes(range(225)) * 4, None)
    data = {"cut.warc": data[:-500], "cut.warc.gz": gzip.compress(data[:-500]), "member.warc.gz": gzip.compress(data)[:-200]}[name]
    (tmp_path / name).write_bytes(data)
    with warc.pa.fs.LocalFileSystem().open_input_file(str(tmp_path / name)) as stream, pytest.raises(ValueError, match="too soon"):
        list(warc.records_in(stream, lambda h: True, True, name.endswith(".gz")))
