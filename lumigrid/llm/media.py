"""Media columns: PNG images in binary columns, written and read here with zlib and numpy.

A payload becomes an 8-bit grey image of 48 samples a row. Reading walks the chunks, tests
every checksum, inflates the image data and undoes the row filters with numpy. The feature
is a hash of the low frequencies of the two-dimensional cosine transform.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, id_text, slices, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
UNIT, WIDTH = 576, 48
LOW = 8  # frequencies kept on each axis


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\xff")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray, level: int = 6, idat_bytes: int = 1 << 16) -> bytes:
    """A grey 8-bit image. One filter (none, left or up) serves the whole image: the one with the least sum of magnitudes."""
    height, width = samples.shape
    left = samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up = samples.copy()
    up[1:] -= samples[:-1]
    cost = [int(np.minimum(x, 256 - x.astype(np.int16)).sum()) for x in (samples, left, up)]
    kind = cost.index(min(cost))
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = (samples, left, up)[kind]
    data = zlib.compress(rows.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", data[i : i + idat_bytes]) for i in range(0, len(data), idat_bytes))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def unfilter(rows: np.ndarray, kinds: np.ndarray, pixel: int = 1) -> np.ndarray:
    """Undo PNG row filters. Runs of rows with one filter are undone together where that is possible."""
    out = np.empty_like(rows)
    height = len(rows)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for start, end in zip([0, *edges], [*edges, height], strict=True):
        kind, run = int(kinds[start]) if height else 0, rows[start:end]
        above = out[start - 1] if start else np.zeros(rows.shape[1], np.uint8)
        if kind == 0:
            out[start:end] = run
        elif kind == 1:
            out[start:end] = np.cumsum(run.reshape(len(run), -1, pixel), axis=1, dtype=np.uint8).reshape(run.shape)
        elif kind == 2:
            out[start:end] = np.cumsum(run, axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for y in range(start, end):
                prior, line, done = above.tolist(), rows[y].tolist(), []
                for x, value in enumerate(line):
                    a = done[x - pixel] if x >= pixel else 0
                    b, c = prior[x], prior[x - pixel] if x >= pixel else 0
                    if kind == 3:
                        guess = (a + b) >> 1
                    else:
                        p = a + b - c
                        guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    done.append((value + guess) & 255)
                out[y] = done
                above = out[y]
        else:
            raise ValueError(f"unknown row filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit, not interlaced PNG as an array of height x width x channels. Raises ValueError on damage."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, parts, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        length, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + length]
        if len(body) < length or at + 12 + length > len(data):
            raise ValueError("chunk runs past the end")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise ValueError(f"checksum of {kind!r} differs")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if header is None or not ended:
        raise ValueError("header or end is missing")
    width, height, depth, colour, _, _, interlace = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("only 8-bit grey or colour without interlacing is read")
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"damaged image data: {e}") from e
    if raw.size != height * (width * channels + 1):
        raise ValueError("image data has the wrong length")
    raw = raw.reshape(height, width * channels + 1)
    return unfilter(raw[:, 1:], raw[:, 0], channels).reshape(height, width, channels)


@lru_cache(maxsize=512)
def _basis(n: int) -> np.ndarray:
    """Rounded cosines times 1024: sums of products stay exact in doubles, in whatever order they are added."""
    return np.round(1024 * np.cos(np.pi * np.outer(np.arange(LOW), np.arange(n) + 0.5) / n))


def cosine_hash(grey: np.ndarray) -> bytes:
    """64 bits: which of the LOW x LOW lowest frequencies, each scaled to a mean, lie above their median; the mean itself is not compared."""
    height, width = grey.shape
    low = _basis(height) @ grey.astype(np.float64) @ _basis(width).T
    flat = low.ravel()
    return np.packbits(np.concatenate([[False], flat[1:] > np.median(flat[1:])])).tobytes()


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("cosine_hash", pa.binary())])


def _store(level: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                texts = utf8(b.column("text"))
                yield batch(_STORED, b.column("doc_id"), [len(t) for t in texts], [encode_png(np.frombuffer(pad(t), np.uint8).reshape(-1, WIDTH), level) for t in texts])

    return run


def _read(batches):
    for whole in batches:
        for b in slices(whole, "media"):
            out = []
            for media in b.column("media").to_pylist():
                if media is None:
                    out.append((None,) * 7)
                    continue
                image = decode_png(media)[:, :, 0]
                payload = image.tobytes()
                mark = cosine_hash(image)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), mark.hex(), mark))
            yield batch(_READ, b.column("doc_id"), b.column("n_bytes"), *zip(*out, strict=True))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes as a PNG in a binary column. Null text is stored like the empty one; rows are kept as they are, repeated ones too, null ids too.

    Texts of any length are stored whole, a row at a time at most;
    other columns are not read, whatever their names; an empty table gives an empty result.
    """
    return id_text(docs, id_col, text_col).mapInArrow(_store(level), "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Read back what store_media made: sizes, checksums and the cosine hash (hexadecimal in feature, bytes in cosine_hash). A null media gives nulls; a damaged one raises."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, cosine_hash binary")
