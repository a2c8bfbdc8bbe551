"""Media columns: Netpbm and BMP images decoded to arrays, shrunk by area, kept as NPY tiles.

Decoders read PBM, PGM and PPM (plain and raw, 8 and 16 bits) and uncompressed BMP (8, 24 and 32
bits). Shrinking averages exact areas with an integral image, taken in strips of rows so that tall
images stay within bounded memory. A difference hash compares neighbours of the shrunk image.

Nulls: a null or unreadable image gives nulls and an error text; a null text is an empty one.
Empty tables give empty results; repeated rows give equal values; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
STRIP_ROWS = 4096


def encode_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_ppm(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom, each padded to four bytes."""
    h, w, _ = image.shape
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = image[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + h * stride, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * stride, 2835, 2835, 0, 0) + rows.tobytes()


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The next `fields` numbers of a Netpbm header, past comments, and where the header ends."""
    out, at = [], 2
    while len(out) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1  # one white space ends the header


def decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    if kind in b"14":
        (w, h), at = _header(data, 2)
        most = 1
    else:
        (w, h, most), at = _header(data, 3)
    depth = 3 if kind in b"36" else 1
    if not (w and h and 0 < most < 65536):
        raise ValueError("bad Netpbm size")
    if kind == b"1":
        digits = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), np.uint8)
        flat = 255 * (1 - (digits[: w * h] - 48))
    elif kind in b"23":
        flat = np.array(data[at - 1 :].split()[: w * h * depth], np.int64)
    elif kind == b"4":
        stride = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * stride, at).reshape(h, stride), axis=1)[:, :w]
        flat = 255 * (1 - bits.reshape(-1))
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h * depth, at)
    if len(flat) != w * h * depth:
        raise ValueError("Netpbm samples are missing")
    if kind not in b"14" and most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    image = np.asarray(flat).astype(np.uint8).reshape(h, w, depth)
    return image if depth == 3 else image[:, :, 0]


def decode_bmp(data: bytes) -> np.ndarray:
    at = struct.unpack_from("<I", data, 10)[0]
    head, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if bits not in (8, 24, 32) or packed not in (0, 3) or w <= 0 or h == 0:
        raise ValueError("BMP kind not read")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, at).reshape(abs(h), stride)
    rows = rows if h < 0 else rows[::-1]
    if bits == 8:
        colours = (at - 14 - head) // 4
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(colours, 4)[:, 2::-1]
        return palette[rows[:, :w]]
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """The image as rows x columns, or rows x columns x 3, of 8-bit samples."""
    if data[:1] == b"P" and data[1:2] in [b"1", b"2", b"3", b"4", b"5", b"6"]:
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def shrink(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over equal areas: differences of the integral image at fractional borders."""
    h, w = image.shape[:2]
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    low = np.minimum(ys.astype(np.int64), h - 1)
    want = np.zeros((height + 1, *image.shape[1:]))
    above = np.zeros(image.shape[1:])
    for at in range(0, h, STRIP_ROWS):
        strip = image[at : at + STRIP_ROWS]
        inside = np.flatnonzero((low >= at) & (low < at + len(strip)))
        sums = np.zeros((len(strip) + 1, *image.shape[1:]), np.int64)
        np.cumsum(strip, axis=0, out=sums[1:])
        part = (ys[inside] - low[inside]).reshape(-1, *[1] * (image.ndim - 1))
        want[inside] = above + sums[low[inside] - at] + part * strip[low[inside] - at]
        above = above + sums[-1]
    across = np.zeros((height + 1, w + 1, *image.shape[2:]))
    np.cumsum(want, axis=1, out=across[:, 1:])
    left = np.minimum(xs.astype(np.int64), w - 1)
    share = (xs - left).reshape(1, -1, *[1] * (image.ndim - 2))
    corners = across[:, left] * (1 - share) + across[:, left + 1] * share
    area = (h / height) * (w / width)
    return np.diff(np.diff(corners, axis=0), axis=1) / area


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    small = np.round(shrink(grey(image) if image.ndim == 3 else image, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(shrink(image, size, size)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def decode_column(df: DataFrame, image: str, key: str, tile: int = 32) -> DataFrame:
    """Per row: the key, width, height, channels, the tile as NPY bytes, dhash, error."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, width int, height int, channels int, tile binary, dhash string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1):
                try:
                    a = decode(data.as_py() or b"")
                    rows.append((a.shape[1], a.shape[0], 3 if a.ndim == 3 else 1, npy_tile(a, tile), difference_hash(a), None))
                except (ValueError, IndexError, struct.error, OverflowError) as e:
                    rows.append((None, None, None, None, None, str(e)[:200] or "unreadable"))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=[key, "width", "height", "channels", "tile", "dhash", "error"])

    return df.select(key, F.col(image).cast("binary")).mapInArrow(run, schema)


def payload_of(text: bytes) -> bytes:
    return text + bytes(max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def media_facts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text stored as a grey image 64 wide, read back and described."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_py() or b""
                media = encode_pgm(np.frombuffer(payload_of(raw), np.uint8).reshape(-1, WIDTH))
                image = decode(media)
                back = image.tobytes()
                rows.append((k, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), hashlib.sha256(npy_tile(image, 16)).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    spec = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"
    return docs.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(run, spec)


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_facts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
