"""Media columns: bytes as 8-bit grey PNG images, read back with checksum tests, and cosine-transform hashes.

A payload is a text's UTF-8 bytes with 0 bytes appended up to a positive multiple of WIDTH; each
WIDTH bytes are one row of pixels. The decoder tests every chunk's CRC, inflates IDAT and undoes all
five row filters with numpy. The feature is the sign pattern of the 8 x 8 lowest frequencies of a
32 x 32 mean-pooled image.

Null counts as the empty text (one row of 0 pixels). A text of any length is one image, filtered in blocks
of rows; its bytes, pixels and stored form are in memory at once, a few times its size. Equal texts give equal values; rows are never
merged or dropped, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bagwright.llm.common import map_batches

WIDTH = 64
#: Rows of pixels filtered at once.
ROWS = 1 << 16
_MAGIC = b"\x89PNG\r\n\x1a\n"
_LEVEL = 1


def payload(data: bytes) -> bytes:
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(data: bytes, width: int = WIDTH) -> bytes:
    """A grey PNG of whole rows; each row takes the filter (none, left or up) with the least absolute residue. ROWS go at once."""
    grid = np.frombuffer(data, np.uint8).reshape(-1, width)
    packer, packed = zlib.compressobj(_LEVEL), []
    for lo in range(0, len(grid), ROWS):
        rows = grid[lo : lo + ROWS]
        left, up = rows.copy(), rows.copy()
        left[:, 1:] -= rows[:, :-1]
        up[1:] -= rows[:-1]
        if lo:
            up[0] -= grid[lo - 1]
        forms = (rows, left, up)
        cost = np.stack([np.abs(f.view(np.int8).astype(np.int16)).sum(1) for f in forms])
        best = cost.argmin(0).astype(np.uint8)
        lines = np.empty((len(rows), width + 1), np.uint8)
        lines[:, 0] = best
        for k, f in enumerate(forms):
            lines[best == k, 1:] = f[best == k]
        packed.append(packer.compress(lines.tobytes()))
    packed.append(packer.flush())
    head = struct.pack(">IIBBBBB", width, len(grid), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join(packed)) + _chunk(b"IEND", b"")


def read_chunks(media: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, body) of each chunk; raises ValueError on a bad signature, length or checksum."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG")
    found, at = [], 8
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("a chunk is cut off")
        (n,) = struct.unpack_from(">I", media, at)
        kind, body, crc = media[at + 4 : at + 8], media[at + 8 : at + 8 + n], media[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(crc, "big"):
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        found.append((kind, body))
        at += 12 + n
    if not found or found[0][0] != b"IHDR" or found[-1][0] != b"IEND":
        raise ValueError("chunks are missing")
    return found


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the row filters. Runs of one filter go at once where its sums allow that."""
    out = rows.copy()
    n, width = rows.shape
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        kind = kinds[a]
        before = out[a - 1].copy() if a else np.zeros(width, np.uint8)
        if kind == 1:
            out[a:b] = np.cumsum(rows[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(rows[a:b], axis=0, dtype=np.uint8) + before
        elif kind in (3, 4):
            for y in range(a, b):
                line, up = out[y], (out[y - 1] if y else np.zeros(width, np.uint8)).astype(int).tolist()
                left = corner = 0
                for x, v in enumerate(rows[y].tolist()):
                    if kind == 3:
                        guess = (left + up[x]) // 2
                    else:
                        p = left + up[x] - corner
                        da, db, dc = abs(p - left), abs(p - up[x]), abs(p - corner)
                        guess = left if da <= db and da <= dc else up[x] if db <= dc else corner
                    left, corner = (v + guess) & 255, up[x]
                    line[x] = left
        elif kind != 0:
            raise ValueError(f"filter {kind} does not exist")
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Pixels (rows, width) of an 8-bit grey PNG."""
    found = read_chunks(media)
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", found[0][1])
    if (depth, colour, interlace) != (8, 0, 0):
        raise ValueError("only 8-bit grey images without interlacing are read")
    raw = zlib.decompress(b"".join(body for kind, body in found if kind == b"IDAT"))
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return _unfilter(lines[:, 0], lines[:, 1:])


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_GRID, _LOW = 32, 8
_DCT = _cosines(_GRID, _LOW)


def _pool(x: np.ndarray, n: int) -> np.ndarray:
    """Means over n bands of rows; fewer rows are repeated."""
    at = np.arange(n) * len(x) // n
    if len(x) < n:
        return x[at]
    return np.add.reduceat(x, at, axis=0, dtype=np.float64) / np.diff([*at, len(x)])[:, None]


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the lowest 64 frequencies (but the mean) lie above their median."""
    small = _pool(_pool(pixels, _GRID).T, _GRID).T
    low = np.round(_DCT @ small @ _DCT.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's payload as a PNG in a binary column."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, media = [], []
            for t in batch.column(1):
                data = (t.as_py() or "").encode()
                sizes.append(len(data))
                media.append(encode_png(payload(data)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

        return f

    src = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return map_batches(src, make, "doc_id long, n_bytes long, media binary")


def media_features(df: DataFrame) -> DataFrame:
    """Reads (doc_id, n_bytes, media) back: digests of payload and stored form, and the feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(media: bytes) -> tuple:
        pixels = decode_png(media)
        data = pixels.tobytes()
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(pixels)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = list(zip(*map(one, batch.column(2).to_pylist()), strict=True))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], names=names)

        return f

    return map_batches(
        df.select("doc_id", "n_bytes", "media"),
        make,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
