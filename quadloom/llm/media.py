"""Media columns: text payloads as 8-bit greyscale PNG, read back with numpy, with a cosine-transform hash.

The PNG writer makes IHDR, IDAT and IEND chunks; filters (none, sub, up) are picked for each band of
rows by the least sum of absolute residuals. The reader tests the signature, every chunk's CRC-32, the
zlib checksum and the geometry, undoes all five filters of the format, and refuses anything broken.

Defined cases: a null or empty text is a payload of 64 zero bytes; texts of any length are one image 64
wide; equal texts have equal values; repeated rows stay repeated; other columns are ignored; an
empty table gives an empty table. A media value that is not such a PNG raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import text as X

WIDTH, BAND, GRID, LOW = 64, 64, 32, 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ENCODED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_N = np.arange(GRID)
_COSINES = np.cos(np.pi * (2 * _N + 1) * np.arange(LOW)[:, None] / (2 * GRID))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels: np.ndarray, level: int = 4) -> bytes:
    """8-bit greyscale PNG of a two-dimensional uint8 array."""
    high, wide = pixels.shape
    left = np.zeros_like(pixels)
    left[:, 1:] = pixels[:, :-1]
    up = np.zeros_like(pixels)
    up[1:] = pixels[:-1]
    lines = np.empty((high, wide + 1), np.uint8)
    residuals = (pixels, pixels - left, pixels - up)
    starts = np.arange(0, high, BAND)
    cost = np.stack([np.add.reduceat(np.abs(r.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64), starts) for r in residuals])
    kind = np.repeat(cost.argmin(0), BAND)[:high]
    lines[:, 0] = kind
    for k, r in enumerate(residuals):
        lines[kind == k, 1:] = r[kind == k]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _sequential(line: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    """Average (3) and Paeth (4), whose pixels depend on the one before."""
    out, left, corner = np.empty_like(line), 0, 0
    for i, (x, b) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        if kind == 3:
            guess = (left + b) // 2
        else:
            p = left + b - corner
            guess = min((left, b, corner), key=lambda v: abs(p - v))
        left, corner = (x + guess) & 255, b
        out[i] = left
    return out


def unfiltered(lines: np.ndarray) -> np.ndarray:
    """Undoes the filters of lines (filter type first), a run of rows of one type at a time."""
    kind, body = lines[:, 0], lines[:, 1:]
    if len(kind) and kind.max() > 4:
        raise ValueError("unknown PNG filter")
    out = np.empty_like(body)
    cuts = np.r_[0, np.flatnonzero(np.diff(kind)) + 1, len(kind)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b:
            continue
        above = out[a - 1] if a else np.zeros(body.shape[1], np.uint8)
        if kind[a] == 0:
            out[a:b] = body[a:b]
        elif kind[a] == 1:
            np.cumsum(body[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind[a] == 2:
            np.cumsum(body[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += above
        else:
            for r in range(a, b):
                out[r] = above = _sequential(body[r], above, int(kind[r]))
    return out


def pixels(data: bytes) -> np.ndarray:
    """The image of an 8-bit greyscale PNG; ValueError for anything else or any failed checksum."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, shape, parts, ended = 8, None, [], False
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(data[at + 4 : at + 8 + n]):
            raise ValueError("a PNG chunk is cut or fails its checksum")
        at += 12 + n
        if kind == b"IHDR":
            wide, high, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit greyscale")
            shape = (high, wide + 1)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
            break
    if shape is None or not ended:
        raise ValueError("a PNG without its header or end")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError("PNG data fail") from e
    if len(raw) != shape[0] * shape[1]:
        raise ValueError("PNG data of another size")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(shape))


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: signs of the 8 x 8 lowest cosine coefficients against their median, of a 32 x 32 reduction."""
    high, wide = image.shape
    cut = lambda n: np.arange(GRID) * n // GRID
    small = image.astype(np.float64)
    for axis, n in ((0, high), (1, wide)):
        if n >= GRID:
            at = cut(n)
            size = np.diff(np.r_[at, n])
            small = np.add.reduceat(small, at, axis=axis) / (size[:, None] if axis == 0 else size)
        else:
            small = small.take(cut(n), axis=axis)
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    low[0] = 0  # mean brightness
    return np.packbits(low > np.median(low)).tobytes().hex()


def _encode(batches):
    for whole in batches:
        for batch in X.slices(whole):
            data, offsets = X.utf8(batch.column(1))
            media = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                payload = np.zeros(max(1, -(-(b - a) // WIDTH)) * WIDTH, np.uint8)
                payload[: b - a] = data[a:b]
                media.append(png(payload.reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _decode(batches):
    for batch in batches:
        rows = []
        for data in batch.column(2).to_pylist():
            image = pixels(data)
            payload = image.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[c.split()[0] for c in READ.split(", ")])


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a PNG in a binary column."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode, ENCODED)


def features(media: DataFrame) -> DataFrame:
    """Reads a column of encoded() back and computes its features."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, READ)


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    return features(encoded(X.read(spark, sf_dir, "documents")))
