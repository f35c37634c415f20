"""Media columns: Netpbm (P5, P6) and BMP bytes decoded to numpy arrays, area-resized through integral images,
written as NPY tiles, with difference hashes. Encoders for the same formats store any payload losslessly."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, named, prepare, task

FORMATS = ("pgm", "ppm", "bmp")
_HEAD = re.compile(rb"P([2356])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


def encode(pixels: np.ndarray, kind: str) -> bytes:
    """An array (rows, columns) or (rows, columns, 3) of uint8 as binary Netpbm or as a 24-bit BMP."""
    h, w = pixels.shape[:2]
    if kind == "bmp":
        line = w * 3
        pad = -line % 4
        body = np.zeros((h, line + pad), dtype=np.uint8)
        body[:, :line] = pixels[::-1, :, ::-1].reshape(h, line)
        return b"BM" + struct.pack("<IHHI", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()
    return b"P%d\n%d %d\n255\n" % (5 if pixels.ndim == 2 else 6, w, h) + pixels.tobytes()


def decode(data: bytes) -> np.ndarray | None:
    """The samples of P2, P3, P5, P6 (up to 8 bits) or of an uncompressed 24-bit BMP; None if it is none of these or is cut off."""
    if data[:2] == b"BM" and len(data) >= 54:
        start = struct.unpack_from("<I", data, 10)[0]
        w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
        line = (w * 3 + 3) // 4 * 4
        if bits != 24 or packed or w <= 0 or h == 0 or len(data) < start + line * abs(h):
            return None
        rows = np.frombuffer(data, dtype=np.uint8, count=line * abs(h), offset=start).reshape(abs(h), line)[:, : w * 3].reshape(abs(h), w, 3)[:, :, ::-1]
        return rows[::-1] if h > 0 else rows
    m = _HEAD.match(data)
    if not m:
        return None
    kind, w, h, most = (int(x) for x in m.groups())
    shape = (h, w) if kind in (2, 5) else (h, w, 3)
    n = int(np.prod(shape))
    if w <= 0 or h <= 0 or not 0 < most < 256:
        return None
    if kind < 4:
        values = np.array(data[m.end() :].split()[:n], dtype=np.int64)
        return values.astype(np.uint8).reshape(shape) if len(values) == n and values.max() < 256 else None
    return np.frombuffer(data, dtype=np.uint8, count=n, offset=m.end()).reshape(shape) if len(data) >= m.end() + n else None


def area_resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean grey of each cell of a rows x columns grid over the picture, cells weighing the pixels that they cover in
    part. An integral image is read at fractional corners by linear interpolation, which is exact for area means."""
    grey = pixels.sum(axis=2, dtype=np.int64) if pixels.ndim == 3 else pixels.astype(np.int64)
    h, w = grey.shape
    ys, xs = np.arange(rows + 1) * h / rows, np.arange(columns + 1) * w / columns
    down = np.zeros((h + 1, w), dtype=np.int64)
    np.cumsum(grey, axis=0, out=down[1:])
    y0 = np.minimum(ys.astype(np.int64), h - 1)
    lines = down[y0] + (ys - y0)[:, None] * (down[y0 + 1] - down[y0])
    full = np.zeros((rows + 1, w + 1))
    np.cumsum(lines, axis=1, out=full[:, 1:])
    x0 = np.minimum(xs.astype(np.int64), w - 1)
    corner = full[:, x0] + (xs - x0) * (full[:, x0 + 1] - full[:, x0])
    cells = np.diff(np.diff(corner, axis=0), axis=1) / ((h / rows) * (w / columns))
    return cells / (3.0 if pixels.ndim == 3 else 1.0)


def npy_tile(cells: np.ndarray) -> bytes:
    """Cells rounded to uint8 as the bytes of an .npy file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(cells), 0, 255).astype(np.uint8))
    return out.getvalue()


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each of 8 x 8 cells is darker than its right neighbour."""
    cells = np.rint(area_resize(pixels, 8, 9) * 16)
    return np.packbits((cells[:, 1:] > cells[:, :-1]).ravel()).tobytes().hex()


def payload_of(text: bytes, unit: int = 192) -> bytes:
    """text with spaces appended up to a positive multiple of unit."""
    n = max(1, -(-len(text) // unit)) * unit
    return text + b" " * (n - len(text))


def store(payload: bytes) -> bytes:
    """A payload of a multiple of 192 bytes as a picture: its checksum picks grey (192 wide), colour (64 wide) or BMP."""
    kind = FORMATS[zlib.crc32(payload) % 3]
    flat = np.frombuffer(payload, dtype=np.uint8)
    return encode(flat.reshape(-1, 192) if kind == "pgm" else flat.reshape(-1, 64, 3), kind)


MEDIA = T.StructType([T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("format", T.StringType()), ("tile", T.BinaryType()))])


def text_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = 16) -> DataFrame:
    """One row per document: figures of its stored picture, its difference hash as feature, and a tile x tile NPY thumbnail.

    A null text is an empty one; an empty text is one unit of 192 spaces. Equal texts give equal values. Rows are
    independent of each other, so no shuffle happens; ids may be null or repeat, the id's column may not be named like
    one of the result; other columns are not returned. No rows give no rows.
    """
    prepare(docs.sparkSession)
    named(docs, *MEDIA.names, needs=(id_col,))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *MEDIA.fields])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                media = store(payload_of(raw))
                pixels = decode(media)
                back = pixels.tobytes()
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(pixels), "bmp" if media[:1] == b"B" else "pgm" if media[1:2] == b"5" else "ppm", npy_tile(area_resize(pixels, tile, tile)) if tile else b""))
            made = [pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()))] if rows else None
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=schema.names)

    return docs.select(id_col, F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b"")).alias("raw")).mapInArrow(task("media", run), schema)


def decode_media(df: DataFrame, content_col: str = "content", tile: int = 16) -> DataFrame:
    """df with width, height, channels int, tile binary (NPY) and dhash string added, in place of columns of these names;
    all null where the bytes are null or no picture that decode() reads. No rows give no rows."""
    prepare(df.sparkSession)
    df = named(df, "width", "height", "channels", "tile", "dhash", needs=(content_col,))
    schema = T.StructType([*df.schema.fields, T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("tile", T.BinaryType()), T.StructField("dhash", T.StringType())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = []
            for raw in batch.column(batch.schema.get_field_index(content_col)).to_pylist():
                pixels = decode(raw) if raw else None
                rows.append((None,) * 5 if pixels is None else (pixels.shape[1], pixels.shape[0], 1 if pixels.ndim == 2 else 3, npy_tile(area_resize(pixels, tile, tile)), difference_hash(pixels)))
            made = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return df.mapInArrow(task("media", run), schema)
