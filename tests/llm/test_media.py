import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from tallyforge.llm import media as M

from .corpus import documents, empty, rows


def plain_unfilter(raw, height, stride, step):
    """The standard's filters, byte by byte."""
    out, at, above = bytearray(), 0, bytes(stride)
    for _ in range(height):
        kind, line = raw[at], bytearray(raw[at + 1 : at + 1 + stride])
        for x in range(stride):
            a, b, c = (line[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = a + b - c
            near = min((abs(p - v), k) for k, v in enumerate((a, b, c)))[1]
            line[x] = (line[x] + (0, a, b, (a + b) // 2, (a, b, c)[near])[kind]) % 256
        out += line
        above, at = bytes(line), at + 1 + stride
    return bytes(out)


def pixel_stream(png):
    at, body = 8, b""
    while at < len(png):
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return zlib.decompress(body)


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (0, 1, 2), (1, 2, 3, 4), (0, 1, 2, 3, 4)])
def test_round_trip_and_standard(channels, filters):
    rng = np.random.default_rng(channels)
    for height, width in ((1, 1), (1, 24), (9, 7), (24, 24), (40, 3)):
        for data in (rng.integers(0, 256, height * width * channels), np.cumsum(rng.integers(-3, 4, height * width * channels)) % 256):
            samples = data.astype(np.uint8).tobytes()
            png = M.write_png(samples, width, channels, filters)
            image = M.read_png(png)
            assert (image.width, image.height, image.channels, image.samples) == (width, height, channels, samples)
            assert plain_unfilter(pixel_stream(png), height, width * channels, channels) == samples


def test_mixed_filters_of_each_row():
    rng = random.Random(1)
    for step in (1, 3, 4):
        for kinds in ((0, 1, 2), (0, 1, 2, 3, 4), (2,), (2, 0)):
            lines = np.array([[rng.choice(kinds), *(rng.randrange(256) for _ in range(6 * step))] for _ in range(17)], np.uint8)
            assert M.unfiltered(lines, step).tobytes() == plain_unfilter(lines.tobytes(), 17, 6 * step, step)


def test_many_chunks(monkeypatch):
    monkeypatch.setattr(M, "IDAT", 100)
    samples = random.Random(2).randbytes(5760)
    png = M.write_png(samples, 24)
    assert png.count(b"IDAT") > 50 and M.read_png(png).samples == samples


def plain_hash(grey):
    """Straight from the definition, on exact cells."""
    h, w = len(grey), len(grey[0])
    part = lambda i, n: range(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1))
    columns = [[sum(grey[y][x] for y in part(i, h)) * 1024 // len(part(i, h)) for x in range(w)] for i in range(32)]
    cell = [[sum(columns[i][x] for x in part(j, w)) // len(part(j, w)) for j in range(32)] for i in range(32)]
    cos = [[round(math.cos(u * (2 * x + 1) * math.pi / 64) * 2**14) for x in range(32)] for u in range(8)]
    low = [sum(cos[u][y] * cos[v][x] * cell[y][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low)[32]
    return int("".join("01"[x > middle] for x in low), 2).to_bytes(8)


@pytest.mark.parametrize(("height", "width"), [(24, 24), (1, 576), (33, 31), (70, 48), (576, 3)])
def test_cosine_hash(height, width):
    rng = np.random.default_rng(height)
    samples = rng.integers(0, 256, (height, width)).astype(np.uint8)
    assert M.cosine_hash(M.Image(width, height, 8, 1, samples.tobytes())) == plain_hash(samples.tolist())


def test_hash_stays_near_for_small_changes():
    y, x = np.mgrid[0:96, 0:96]
    smooth = (128 + 60 * np.sin(x / 17) * np.cos(y / 23) + 40 * np.sin((x + y) / 31)).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + np.random.default_rng(1).integers(-4, 5, smooth.shape), 0, 255).astype(np.uint8)
    other = np.random.default_rng(2).integers(0, 256, smooth.shape).astype(np.uint8)
    bits = [int.from_bytes(M.cosine_hash(M.Image(96, 96, 8, 1, s.tobytes()))) for s in (smooth, noisy, other)]
    assert (bits[0] ^ bits[1]).bit_count() <= 8 < (bits[0] ^ bits[2]).bit_count()


def test_report_equals_brute_force(spark):
    found = {(str(r["doc_id"]), r["payload_sha256"], r["n_bytes"]): r for r in M.report(documents(spark)).collect()}
    assert M.report(documents(spark)).count() == len(rows())
    for doc_id, text, *_ in rows():
        data = (text or "").encode()
        n = max(1, -(-len(data) // 576)) * 576
        payload = data.ljust(n, b"\xff")
        r = found[str(doc_id), hashlib.sha256(payload).hexdigest(), len(data)]
        assert (r["payload_bytes"], r["tail_crc32"], r["error"]) == (n, zlib.crc32(payload[-32:]), None)
    stored = {(r["doc_id"], r["n_bytes"], hashlib.sha256(r["media"]).hexdigest()): r["media"] for r in M.store(documents(spark)).collect()}
    for r in found.values():
        png = stored[r["doc_id"], r["n_bytes"], r["media_sha256"]]
        height, width = struct.unpack_from(">I", png, 20)[0], struct.unpack_from(">I", png, 16)[0]
        payload = plain_unfilter(pixel_stream(png), height, width, 1)
        assert hashlib.sha256(payload).hexdigest() == r["payload_sha256"] and r["media_bytes"] == len(png)
        if height < 100:
            assert r["feature"] == plain_hash([list(payload[y * width : (y + 1) * width]) for y in range(height)]).hex()


def test_all_filters_in_a_job(spark):
    df = spark.createDataFrame([(i, "some text of a row " * i) for i in range(40)], "doc_id long, text string")
    want = {r["doc_id"]: r["payload_sha256"] for r in M.load(M.store(df)).collect()}
    assert {r["doc_id"]: r["payload_sha256"] for r in M.load(M.store(df, filters=(1, 2, 3, 4))).collect()} == want


def test_payload_is_the_text(spark):
    df = spark.createDataFrame([(1, "é" * 1000), (2, None)], "doc_id long, text string")
    back = {r["doc_id"]: r["payload"][: r["n_bytes"]].decode() for r in M.load(M.store(df), payload=True).collect()}
    assert back == {1: "é" * 1000, 2: ""}


def damaged():
    good = M.write_png(bytes(range(256)) * 9, 48)
    flip = lambda at: good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
    header = lambda *v: M.SIGNATURE + M.chunk(b"IHDR", struct.pack(">IIBBBBB", *v)) + M.chunk(b"IDAT", zlib.compress(bytes(9))) + M.chunk(b"IEND", b"")
    yield from (None, b"", b"plain", good[:-5], good[:30], flip(3), flip(20), flip(60), M.SIGNATURE, M.SIGNATURE + M.chunk(b"IEND", b""))
    yield from (header(0, 1, 8, 0, 0, 0, 0), header(1, 1, 8, 5, 0, 0, 0), header(8, 1, 8, 0, 0, 0, 1), header(2**31 - 1, 2**31 - 1, 8, 6, 0, 0, 0), header(4, 4, 8, 0, 0, 0, 0))
    yield M.SIGNATURE + M.chunk(b"IHDR", b"short") + M.chunk(b"IEND", b"")
    body = zlib.compress(bytes(10))
    bad_sum = body[:-1] + bytes([body[-1] ^ 1])
    start = M.SIGNATURE + M.chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 1, 8, 0, 0, 0, 0))
    yield start + M.chunk(b"IDAT", bad_sum) + M.chunk(b"IEND", b"")
    yield start + M.chunk(b"IDAT", zlib.compress(bytes([9]) * 10)) + M.chunk(b"IEND", b"")


def test_damaged_media_ends_no_job(spark):
    bad = list(damaged())
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(bad)], "id long, media binary")
    found = M.load(df).orderBy("id").collect()
    assert len(found) == len(bad) and all(r["error"] and r["feature"] is None and r["payload_sha256"] is None for r in found)


def test_sixteen_bits_are_read_but_not_hashed():
    lines = bytes([1, 0, 7, 0, 2, 1, 5])
    png = M.SIGNATURE + M.chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 1, 16, 0, 0, 0, 0)) + M.chunk(b"IDAT", zlib.compress(lines)) + M.chunk(b"IEND", b"")
    assert M.read_png(png).samples == bytes([0, 7, 0, 9, 1, 14])
    assert M.examined(png, False)["error"]


def test_very_long_text(spark):
    text = "long text " * 300_000
    r = M.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert r["n_bytes"] == 3_000_000 and r["payload_bytes"] == -(-3_000_000 // 576) * 576 and r["error"] is None


def test_empty(spark):
    assert M.report(empty(spark)).count() == 0
