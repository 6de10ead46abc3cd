"""Media columns: bytes kept as PNG images in binary columns, read back with every check, and hashed by low frequencies.

``write_png`` stores bytes as the 8-bit samples of an image, each row under the filter whose residues are smallest, deflated into IDAT
chunks. ``read_png`` walks the chunks, tests each one's CRC and the stream's Adler sum, and undoes all five filters with numpy: rows without
or with the left neighbour at once, runs of rows over the one above by running sums, and images with averages or Paeth predictions along
their anti-diagonals, whose pixels depend on earlier diagonals only. ``cosine_hash`` averages the samples into 32 by 32 cells, takes the 8 by 8
lowest frequencies of their cosine transform and sets a bit for each that is above their median. It is done in whole numbers, so
that equal bytes give equal hashes on every machine.

Defined cases of ``store`` and ``load``: a null text is empty; texts are stored whole, padded with bytes 255 up to a positive multiple of
``UNIT``; repeated rows are stored for each; a null doc_id stays null; columns beyond doc_id and text are ignored; an empty table gives an
empty table. Media that is null, torn, or fails a checksum gives a row whose ``error`` says why, and null features: no job ends by it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, materialize

UNIT, PAD = 576, 255
#: Widths of images of text: multiples of 24 that divide UNIT. The most bytes of one IDAT chunk.
WIDTHS, IDAT = (24, 48, 72, 96, 144, 192, 288, 576), 1 << 20
CHUNK = 8 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
CELLS, LOW = 32, 8
#: Cosines of the LOW lowest frequencies at the cells' middles, as whole numbers.
COSINES = np.rint(np.cos(np.outer(np.arange(LOW), 2 * np.arange(CELLS) + 1) * np.pi / (2 * CELLS)) * 2**14).astype(np.int64)
#: Samples of a pixel by colour type: grey, RGB, palette, grey with alpha, RGB with alpha.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class BadImage(ValueError):
    """Why bytes aren't an image that can be read."""


@dataclass
class Image:
    width: int
    height: int
    depth: int
    channels: int
    samples: bytes


def paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The neighbour closest to left + up - corner; ties go left, then up."""
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c)).astype(np.uint8)


def residues(rows: np.ndarray, kind: int, step: int) -> np.ndarray:
    """Rows of samples less what the filter predicts, modulo 256."""
    left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, step:], up[1:], corner[1:, step:] = rows[:, :-step], rows[:-1], rows[:-1, :-step]
    if kind == NONE:
        return rows
    predicted = {SUB: lambda: left, UP: lambda: up, AVERAGE: lambda: ((left.astype(np.uint16) + up) >> 1).astype(np.uint8), PAETH: lambda: paeth(left, up, corner)}
    return rows - predicted[kind]()


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(samples: bytes, width: int, channels: int = 1, filters: tuple[int, ...] = (NONE, SUB, UP), level: int = 6) -> bytes:
    """An image of 8-bit samples; each row takes the filter whose residues, as signed bytes, have the smallest sum."""
    stride = width * channels
    rows = np.frombuffer(samples, np.uint8).reshape(-1, stride)
    tried = [residues(rows, kind, channels) for kind in filters]
    # A row without a filter deflates better than its residues tell: it is left as it is unless another halves its sum.
    cost = np.stack([np.minimum(t, 0 - t).sum(axis=1, dtype=np.int64) * (1 if kind == NONE else 2) for kind, t in zip(filters, tried, strict=True)])
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), stride + 1), np.uint8)
    lines[:, 0] = np.array(filters, np.uint8)[best]
    for k, t in enumerate(tried):
        lines[best == k, 1:] = t[best == k]
    packed = zlib.compress(lines.tobytes(), level)
    colour = {n: c for c, n in CHANNELS.items() if c != 3}[channels]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, colour, 0, 0, 0)
    body = b"".join(chunk(b"IDAT", packed[i : i + IDAT]) for i in range(0, len(packed), IDAT))
    return SIGNATURE + chunk(b"IHDR", header) + body + chunk(b"IEND", b"")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks up to IEND, each with its checksum tested."""
    if data[:8] != SIGNATURE:
        raise BadImage("no PNG signature")
    at = 8
    while True:
        if at + 12 > len(data):
            raise BadImage("torn chunk")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if at + 12 + size > len(data):
            raise BadImage("torn chunk")
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise BadImage(f"wrong checksum of {kind.decode('latin-1')}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def inflated(packed: list[bytes], size: int) -> bytes:
    """The pixel stream; never more than the header's size is inflated. zlib tests the stream's own checksum at its end."""
    stream = zlib.decompressobj()
    if size > 1032 * sum(map(len, packed)) + 64:  # deflate makes no more of a byte
        raise BadImage("pixel stream too short for its header")
    try:
        out = stream.decompress(b"".join(packed), size + 1)
    except zlib.error as e:
        raise BadImage(f"pixel stream: {e}") from None
    if len(out) != size or not stream.eof:
        raise BadImage("pixel stream of another length")
    return out


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """The samples of rows that begin with their filter's number; `step` bytes make a pixel."""
    kind, rows = lines[:, 0], lines[:, 1:].copy()
    if kind.max(initial=0) > PAETH:
        raise BadImage("unknown filter")
    if (kind >= AVERAGE).any():
        return along_diagonals(kind, rows, step)
    if (kind == SUB).any():
        at = np.flatnonzero(kind == SUB)
        pixels = rows[at].reshape(len(at), -1, step)
        rows[at] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(len(at), -1)
    if (kind == UP).any():
        # Sums down the image, less those above the row that a run of such rows rests on.
        base = np.maximum.accumulate(np.where(kind == UP, -1, np.arange(len(kind))))
        sums = np.concatenate([np.zeros((1, rows.shape[1]), np.uint8), np.cumsum(rows, axis=0, dtype=np.uint8)])
        rows = sums[1:] - sums[np.maximum(base, 0)]
    return rows


def along_diagonals(kind: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """All filters: a pixel needs those to its left and above, so each anti-diagonal of pixels is done at once."""
    height, width = len(rows), rows.shape[1] // step
    pixels = np.zeros((height + 1, width + 1, step), np.uint8)  # a zero row above and a zero pixel before
    pixels[1:, 1:] = rows.reshape(height, width, step)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1)) + 1
        x = d - y + 2
        left, up, corner = pixels[y, x - 1], pixels[y - 1, x], pixels[y - 1, x - 1]
        mean = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
        choices = np.stack([np.zeros_like(left), left, up, mean, paeth(left, up, corner)])
        pixels[y, x] += choices[kind[y - 1], np.arange(len(y))]
    return pixels[1:, 1:].reshape(height, width * step)


def read_png(data: bytes) -> Image:
    """The samples of an image that isn't interlaced, of any colour type, with 8 or 16 bits (or fewer, packed in bytes)."""
    header, packed = None, []
    for k, (kind, body) in enumerate(chunks(data)):
        if (k == 0) != (kind == b"IHDR"):
            raise BadImage("no header, or more than one")
        if kind == b"IHDR":
            if len(body) != 13:
                raise BadImage("header of another length")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if header is None:
        raise BadImage("no header")
    width, height, depth, colour, method, filtering, interlaced = header
    if not width or not height or colour not in CHANNELS or depth not in (1, 2, 4, 8, 16) or method or filtering or interlaced:
        raise BadImage("a header that isn't read")
    bits = depth * CHANNELS[colour]
    stride = (width * bits + 7) // 8
    lines = np.frombuffer(inflated(packed, height * (stride + 1)), np.uint8).reshape(height, stride + 1)
    return Image(width, height, depth, CHANNELS[colour], unfiltered(lines, max(1, bits // 8)).tobytes())


def cells(rows: np.ndarray) -> np.ndarray:
    """Means, in 1024ths, of the samples in CELLS by CELLS parts of an image; a small image's samples serve several parts."""
    for axis in (0, 1):
        n = rows.shape[axis]
        first = np.arange(CELLS) * n // CELLS
        size = np.maximum((np.arange(CELLS) + 1) * n // CELLS - first, 1)
        sums = np.add.reduceat(rows, first, axis=axis, dtype=np.int64) if n >= CELLS else np.take(rows, first, axis=axis).astype(np.int64)
        rows = sums * (1024 if axis == 0 else 1) // size.reshape((-1, 1) if axis == 0 else (1, -1))
    return rows


def cosine_hash(image: Image) -> bytes:
    """64 bits: is each of the LOW by LOW lowest frequencies of the cells above their median. Of 8-bit images."""
    if image.depth != 8:
        raise BadImage("only 8-bit samples are hashed")
    rows = np.frombuffer(image.samples, np.uint8).reshape(image.height, image.width, image.channels)
    grey = rows[:, :, 0] if image.channels == 1 else rows[:, :, : 3 if image.channels > 2 else 1].sum(axis=2, dtype=np.int64)
    low = (COSINES @ cells(grey) @ COSINES.T).ravel()
    return np.packbits(low > np.sort(low)[LOW * LOW // 2]).tobytes()


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % UNIT or (UNIT if not data else 0))


def width_for(n: int) -> int:
    """The largest of WIDTHS that leaves an image of n samples no wider than high."""
    return max(w for w in WIDTHS if w * w <= n)


def store(documents: DataFrame, filters: tuple[int, ...] = (NONE, SUB, UP)) -> DataFrame:
    """doc_id, n_bytes, media: each text as a PNG of grey samples, about square where it is short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, CHUNK):
            texts = [t.encode() if t else b"" for t in b.column(1).to_pylist()]
            media = pa.array([write_png(p, width_for(len(p)), filters=filters) for p in map(padded, texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


LOADED = "width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature binary, error string"


def examined(data: bytes | None, keep: bool) -> dict:
    out: dict = {"media_bytes": len(data or b""), "media_sha256": hashlib.sha256(data or b"").hexdigest()}
    try:
        image = read_png(data or b"")
        out |= {"payload_bytes": len(image.samples), "payload_sha256": hashlib.sha256(image.samples).hexdigest(), "tail_crc32": zlib.crc32(image.samples[-32:])}
        out |= {"width": image.width, "height": image.height, "feature": cosine_hash(image), "payload": image.samples if keep else None}
    except BadImage as e:
        out["error"] = str(e)
    return out


def load(media: DataFrame, payload: bool = False) -> DataFrame:
    """The columns of media, its measures (LOADED) and, if asked for, the payload read back."""
    own = media.columns
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    added = [x.split(" ") for x in LOADED.split(", ")] + ([["payload", "binary"]] if payload else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, own.index("media"), CHUNK):
            found = [examined(x.as_py(), payload) for x in b.column(own.index("media"))]
            columns = [pa.array([f.get(c) for f in found], kinds[k]) for c, k in added]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*own, *(c for c, _ in added)])

    types = ", ".join(f"`{c}` {t}" for c, t in media.dtypes)
    return media.mapInArrow(run, types + ", " + ", ".join(f"{c} {k}" for c, k in added))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the measures of every text's image, which is written as a table and read back; the feature in hex."""
    found = load(materialize(store(documents), "media"))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.lower(F.hex("feature")).alias("feature"), "error"
    )
