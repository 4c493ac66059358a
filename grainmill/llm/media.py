"""Payloads as PNG images in a binary column, and perceptual hashes of them.

A payload becomes an 8-bit grey image 64 samples wide. The PNG is written chunk
by chunk with its checksums; reading tests each checksum, inflates and undoes the
row filters with numpy. The feature is the sign pattern of the low-frequency
cosine coefficients of a 32 x 32 reduction.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import materialize, ship, small_batches, table, text_bytes, worker_cache

WIDTH = 64
#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey PNG of a (height, width) uint8 array. Rows repeat little in
    text, so each row takes the better of no filter and the difference to the row
    above, by the sum of absolute differences."""
    height, width = pixels.shape
    up = pixels.copy()
    up[1:] -= pixels[:-1]
    cost = lambda x: np.minimum(x, 256 - x.astype(np.int16)).sum(axis=1)
    use_up = cost(up) < cost(pixels)
    use_up[0] = False
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = np.where(use_up, 2, 0)
    rows[:, 1:] = np.where(use_up[:, None], up, pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The pixels of an 8-bit grey PNG, not interlaced. A wrong checksum, a wrong
    size or another kind of image raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise ValueError(f"PNG: checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("PNG: only whole 8-bit grey images are read")
    width, height = head[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    if len(raw) != height * (width + 1):
        raise ValueError("PNG: size")
    raw = raw.reshape(height, width + 1)
    return _unfilter(raw[:, 0], raw[:, 1:].copy())


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters in place. Runs of rows of one kind among none, left
    and up are undone at once by cumulative sums; the two others go row by row."""
    if kinds.size and kinds.max() > 4:
        raise ValueError("PNG: filter")
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
        if start == end or kinds[start] == 0:
            continue
        if kinds[start] == 1:
            np.cumsum(rows[start:end], axis=1, dtype=np.uint8, out=rows[start:end])
        elif kinds[start] == 2:
            first = max(start - 1, 0)
            rows[start:end] = np.cumsum(rows[first:end], axis=0, dtype=np.uint8)[start - first :]
        else:
            for y in range(start, end):
                above = rows[y - 1] if y else np.zeros(rows.shape[1], np.uint8)
                _unfilter_row(int(kinds[y]), rows[y], above)
    return rows


def _unfilter_row(kind: int, row: np.ndarray, above: np.ndarray) -> None:
    left = corner = 0
    for x, b in enumerate(above.tolist()):
        if kind == 3:
            guess = (left + b) >> 1
        else:
            p = left + b - corner
            guess = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
        left, corner = (int(row[x]) + guess) & 255, b
        row[x] = left


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(k)[:, None])


def cosine_hash(pixels: np.ndarray, size: int = 32, low: int = 8) -> str:
    """16 hex digits: which of the low x low cosine coefficients of the area
    average exceed their median (the constant term left out of the median)."""
    def shrink(n: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(size + 1) * n / size
        return np.floor(edge[:-1]).astype(int), np.maximum(np.ceil(edge[1:]).astype(int), 1)

    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    total[1:, 1:] = pixels.cumsum(0, dtype=np.float64).cumsum(1)
    (y0, y1), (x0, x1) = shrink(pixels.shape[0]), shrink(pixels.shape[1])
    area = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    small = area / ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    basis = worker_cache(f"cosines-{size}-{low}", lambda: _cosines(size, low))
    c = np.round(basis @ small @ basis.T, 6).ravel()
    return np.packbits(c > np.median(c[1:])).tobytes().hex()


def padded(text: bytes) -> bytes:
    return text + b"\0" * ((-len(text)) % WIDTH if text else WIDTH)


def to_media(docs: DataFrame, level: int = 1) -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes, zero-padded to a positive
    multiple of 64, as a PNG. A null text is an empty one. Rows are handled one by
    one: repeated rows and null ids give their own results, an empty table an empty
    one. Very long texts become one image each. Other columns are ignored."""
    ship(docs.sparkSession)

    def encode(batches):
        for batch in small_batches(batches):
            texts = text_bytes(batch.column(1))
            media = [encode_png(np.frombuffer(padded(t), np.uint8).reshape(-1, WIDTH), level) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored images hold, decoded from their bytes."""
    ship(media.sparkSession)

    def features(batches):
        for batch in small_batches(batches):
            out = []
            for data in batch.column(2).to_pylist():
                pixels = decode_png(data)
                payload = pixels.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(pixels)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(materialize(to_media(table(spark, sf_dir, "documents")), "media"))
