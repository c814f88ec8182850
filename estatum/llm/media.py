"""Media columns: Netpbm and BMP to numpy arrays, area-resized by integral
images, and written as NPY tiles with difference hashes.

Null or broken media give a row with ``ok`` false and null features; extra
columns of the input are ignored; repeated rows give repeated results; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatum.llm.common import extended, materialize, table

FEATURES = "ok boolean, width integer, height integer, channels integer, n_samples long, samples_sha256 string, tail_crc32 long, dhash string, tile_npy binary"
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    at, out = 2, []
    for _ in range(count):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("short Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as height x width (x 3) samples; two bytes a sample over 255."""
    kind = data[1] - 48
    (w, h, *rest), at = _header(data, 2 if kind in (1, 4) else 3)
    depth = 3 if kind in (3, 6) else 1
    if kind <= 3:
        body = data[at - 1 :]
        flat = np.array(list(re.sub(rb"\s", b"", body)), np.uint8) - 48 if kind == 1 else np.array(body.split(), np.uint16)
        if kind != 1 and rest[0] < 256:
            flat = flat.astype(np.uint8)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        flat = np.unpackbits(rows, axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if rest[0] > 255 else np.uint8, h * w * depth, at)
    return flat[: h * w * depth].reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (palette indices), 24- and 32-bit BMP; RGB order."""
    at, w, h, bits, packed = struct.unpack_from("<I4xii2xHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("BMP kind not supported")
    stride, n = (w * bits // 8 + 3) & ~3, abs(h)
    rows = np.frombuffer(data, np.uint8, stride * n, at).reshape(n, stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    return rows if bits == 8 else rows.reshape(n, w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP, bottom row first."""
    h, w = samples.shape
    stride = (w + 3) & ~3
    body = np.zeros((h, stride), np.uint8)
    body[:, :w] = samples[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    head = struct.pack("<2sIHHI", b"BM", 1078 + stride * h, 0, 0, 1078) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, stride * h, 0, 0, 256, 0)
    return head + palette + body.tobytes()


def _edge_integral(a: np.ndarray, parts: int) -> np.ndarray:
    """Integral along axis 0 at ``parts + 1`` even, fractional edges: only rows
    of the integral image that the resize looks at are kept."""
    n = a.shape[0]
    edges = np.arange(parts + 1) * (n / parts)
    whole = np.minimum(edges.astype(np.int64), n)
    out = np.zeros((parts + 1, *a.shape[1:]), np.float64)
    for k in range(parts):
        out[k + 1] = out[k] + a[whole[k] : whole[k + 1]].sum(axis=0, dtype=np.float64)
    part = np.where(whole < n, edges - whole, 0.0)
    return out + a[np.minimum(whole, n - 1)] * part.reshape(-1, *[1] * (a.ndim - 1))


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each output cell's exact area; enlarges as well as shrinks."""
    rows = np.diff(_edge_integral(a, height), axis=0)
    cells = np.diff(_edge_integral(np.ascontiguousarray(np.swapaxes(rows, 0, 1)), width), axis=0)
    return np.swapaxes(cells, 0, 1) * (height * width / (a.shape[0] * a.shape[1]))


def difference_hash(grey: np.ndarray, side: int = 8) -> int:
    small = np.round(area_resize(grey, side, side + 1), 6)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def features(data: bytes | None, tile: int) -> tuple:
    """One row of FEATURES."""
    try:
        a = decode(data or b"")
        if not a.size:
            raise ValueError("no samples")
    except (ValueError, IndexError, struct.error):
        return (False, None, None, None, None, None, None, None, None)
    raw = np.ascontiguousarray(a).tobytes()
    grey = a.mean(axis=2) if a.ndim == 3 else a
    top = 255.0 if a.dtype.itemsize == 1 else 65535.0
    out = io.BytesIO()
    small = area_resize(a, tile, tile)
    np.save(out, np.clip(np.round(small * (255.0 / top if top > 255 else 1.0), 0), 0, 255).astype(np.uint8))
    return (True, a.shape[1], a.shape[0], 1 if a.ndim == 2 else a.shape[2], a.size, hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), f"{difference_hash(grey):016x}", out.getvalue())


def media_tiles(df: DataFrame, keep: list[str], media: str = "media", tile: int = 16) -> DataFrame:
    """``keep`` columns plus FEATURES of the binary column ``media``."""
    schema = extended(df.select(*keep).schema, FEATURES)
    kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(media)
            rows = [features(x.as_buffer().to_pybytes() if x.is_valid else None, tile) for x in b.column(at)]
            cols = [b.column(i) for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)

    return df.select(*keep, media).mapInArrow(run, schema)


def pgm_of(text: Column, width: int = 64) -> tuple[Column, Column]:
    """A text's UTF-8 bytes, zero-filled to full rows, as a binary PGM; and the
    number of bytes before filling."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    rows = F.greatest(F.lit(1), F.ceil(n / width)).cast("int")
    body = F.rpad(raw, rows * width, F.lit(b"\0"))
    return F.concat(F.encode(F.concat(F.lit(f"P5\n{width} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8"), body), n.cast("long")


def op1_media(spark, sf_dir: str) -> DataFrame:
    """Texts stored as PGM images, read back, tiled and hashed.  Null text counts
    as empty and fills one row of zero samples."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    media, n = pgm_of(F.col("text"))
    stored = materialize(docs.select("doc_id", n.alias("n_bytes"), media.alias("media")), "media")
    sized = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    out = media_tiles(sized, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return out.select("doc_id", "n_bytes", F.col("n_samples").alias("payload_bytes"), F.col("samples_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", F.concat_ws("-", "dhash", F.lower(F.hex(F.crc32("tile_npy")))).alias("feature"))
