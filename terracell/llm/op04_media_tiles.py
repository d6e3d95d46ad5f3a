"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, kept as NPY tiles with difference hashes.

``decode`` reads P1-P6 (8-bit) and uncompressed BMP (8-bit palette, 24 and 32 bit) to an array (height, width, channels).
``area_resize`` takes exact box means from the integral image, so its cost does not depend on the scale.  ``dhash`` compares neighbours
of a 9 x 8 grey image.  Bytes that are no readable image (a size that the bytes don't hold or that is not positive, samples out of range) give null
tile and hash, and the reason in ``error``; null bytes give a row of nulls.
Repeated rows keep a row each; other columns are ignored; an empty table gives an empty one.  Work is row by row, bounded by one arrow batch.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import shared_path, utf8

WIDTH = 64
TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")
STORED = "id long, n_bytes long, media binary, tile binary, dhash string"
TILES = "id long, height int, width int, channels int, media_bytes long, media_sha256 string, tile binary, dhash string, error string"


def _held(samples: int, width: int, height: int, size: int) -> None:
    if width <= 0 or height <= 0 or samples > size:
        raise ValueError("no positive size that the bytes hold")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = int(data[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = TOKEN.match(data, at)
        if not m:
            raise ValueError("short header")
        fields.append(int(m[1]))
        at = m.end()
    w, h = fields[:2]
    top, channels = fields[2] if kind not in (1, 4) else 1, 3 if kind in (3, 6) else 1
    if not 0 < top < 256:
        raise ValueError("only 8-bit samples")
    _held(w * h * (1 if kind in (1, 4) else channels) // (8 if kind == 4 else 1), w, h, len(data))
    if kind == 4:
        row = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w]
        return ((1 - bits) * 255)[:, :, None]
    if kind in (5, 6):
        x = np.frombuffer(data, np.uint8, w * h * channels, at + 1)
    else:
        text = re.sub(rb"#[^\n]*", b"", data[at:])
        x = np.array([int(c) if len(c) < 4 else -1 for c in (re.findall(rb"[01]", text) if kind == 1 else text.split())][: w * h * channels])
        if len(x) and not 0 <= x.min() <= x.max() <= top:
            raise ValueError("samples out of range")
        x = (1 - x) * 255 if kind == 1 else x
    x = x.reshape(h, w, channels)
    return x if top == 255 or kind == 1 else (x.astype(np.int64) * 255 // top).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    at, head, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or depth not in (8, 24, 32):
        raise ValueError("only plain BMP of 8, 24 or 32 bits")
    row = (w * depth + 31) // 32 * 4
    _held(row * abs(h), w, abs(h), len(data))
    x = np.frombuffer(data, np.uint8, row * abs(h), at).reshape(abs(h), row)[:, : w * depth // 8]
    x = x if h < 0 else x[::-1]
    if depth == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        return palette[x]
    return x.reshape(abs(h), w, depth // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Samples (height, width, channels), uint8; ValueError for anything else."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and data[1:2]:
            return _netpbm(data).astype(np.uint8)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError(str(e)) from e
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(payload: bytes, width: int = WIDTH) -> bytes:
    """A binary PGM whose samples are the payload, row by row."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the height x width equal boxes of the image (fractional edges weighted), float64."""
    h, w, c = image.shape
    total = np.zeros((h + 1, w + 1, c))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def at(x: np.ndarray, n: int, parts: int) -> np.ndarray:  # the integral at fractional rows: linear between whole ones
        edges = np.arange(parts + 1) * (n / parts)
        low = np.minimum(edges.astype(np.int64), n - 1)
        part = (edges - low)[:, None, None]
        return x[low] * (1 - part) + x[low + 1] * part

    cut = at(at(total, h, height).transpose(1, 0, 2), w, width).transpose(1, 0, 2)
    return (cut[1:, 1:] - cut[:-1, 1:] - cut[1:, :-1] + cut[:-1, :-1]) / ((h / height) * (w / width))


def dhash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 8 box means is darker than its right neighbour."""
    grey = np.floor(area_resize(image, 8, 9).mean(axis=2) * 256 + 0.5)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tiles(media: DataFrame, id_col: str = "id", media_col: str = "media", side: int = 16) -> DataFrame:
    """TILES of each row's media bytes: the NPY tile is uint8 (side, side, channels)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in TILES.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is None:
                    rows.append((i, None, None, None, None, None, None, None, "null"))
                    continue
                known = (len(data), hashlib.sha256(data).hexdigest())
                try:
                    x = decode(data)
                    rows.append((i, *x.shape, *known, tile_of(x, side), dhash(x), None))
                except ValueError as e:
                    rows.append((i, None, None, None, *known, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(each, TILES)


def tile_of(image: np.ndarray, side: int = 16) -> bytes:
    """An NPY file of uint8 (side, side, channels)."""
    return npy(np.floor(area_resize(image, side, side) + 0.5).astype(np.uint8))


def text_media(docs: DataFrame) -> DataFrame:
    """id, n_bytes, media, tile and dhash: each text's UTF-8 bytes, padded with 0 to a positive multiple of 64, as a binary PGM; its NPY tile and difference hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1).to_pylist()
            media = [encode_pgm(x + bytes(-len(x) % WIDTH if x else WIDTH)) for x in data]
            images = [decode(x) for x in media]
            tiles_ = [tile_of(x) for x in images]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary()), pa.array(tiles_, pa.binary()), pa.array([dhash(x) for x in images])], names=["id", "n_bytes", "media", "tile", "dhash"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), utf8("text").alias("data")).mapInArrow(each, STORED)


def text_digests(docs: DataFrame) -> DataFrame:
    """Stores every text as media with its tile and hash, reads the stored bytes back, and digests what was read.

    The feature is the stored difference hash with the crc32 of the samples of the stored NPY tile."""
    spark = docs.sparkSession
    path = shared_path(spark, "media")
    text_media(docs).write.option("compression", "zstd").parquet(path)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, n, data, tile, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = decode(data).tobytes()
                samples = np.load(io.BytesIO(tile), allow_pickle=False)
                out.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"{known}{zlib.crc32(samples.tobytes()):08x}", tile))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)

    stored = spark.read.schema(STORED).parquet(path)
    return stored.mapInArrow(each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
