"""Image files as rows: PNM, PFM, PNG, baseline JPEG, QOI, RGBE and plain TIFF, decoded and encoded with numpy.

Files come through Spark's binaryFile source, so any file system that Spark reads will do.
Formats that need outside libraries raise Unsupported.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg

RAW_EXTENSIONS = frozenset("3fr ari arw bay bmq cap cine cr2 cr3 crw cs1 dc2 dcr dng gpr erf fff ia iiq k25 kc2 kdc mdc mef mos mrw nef nrw orf pef pxn qtk raf raw rdc rw1 rw2 sr2 srf srw sti x3f".split())
LDR_EXTENSIONS = frozenset("bmp bmq cap cine dib gif jpeg jpg png ppm pgm pbm pnm webp qoi j2k jp2 jpf".split())
HDR_EXTENSIONS = frozenset("avif exr hdr heic heif hif jxl pfm rgbe tif tiff".split())


class Unsupported(ValueError):
    pass


def kind_of(path: str) -> str:
    """raw, hdr, ldr or other, by extension."""
    e = path.rsplit(".", 1)[-1].lower()
    return "raw" if e in RAW_EXTENSIONS else "hdr" if e in HDR_EXTENSIONS else "ldr" if e in LDR_EXTENSIONS else "other"


def read_pnm(data: bytes) -> np.ndarray:
    m = re.match(rb"P([2356])\s(?:#[^\n]*\n|\s)*(\d+)(?:#[^\n]*\n|\s)+(\d+)(?:#[^\n]*\n|\s)+(\d+)\s", data)
    if not m:
        raise Unsupported("not a PNM file")
    kind, w, h, top = (int(x) for x in m.groups())
    channels = 3 if kind in (3, 6) else 1
    if kind in (2, 3):
        values = np.array(data[m.end() :].split()[: w * h * channels], float)
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else "u1", w * h * channels, m.end()).astype(float)
    if values.size < w * h * channels:
        raise Unsupported("the file ends early")
    return (values / top).reshape(h, w, channels)


def write_pnm(a: np.ndarray, bits: int = 8) -> bytes:
    top = 2**bits - 1
    v = np.floor(np.clip(a, 0, 1) * top + 0.5).astype(">u2" if bits > 8 else "u1")
    return f"P{6 if a.shape[2] == 3 else 5}\n{a.shape[1]} {a.shape[0]}\n{top}\n".encode() + v.tobytes()


def read_pfm(data: bytes) -> np.ndarray:
    m = re.match(rb"P([Ff])\s+(\d+)\s+(\d+)\s+(-?[\d.eE+-]+)\s", data)
    if not m:
        raise Unsupported("not a PFM file")
    channels, w, h = 3 if m[1] == b"F" else 1, int(m[2]), int(m[3])
    return np.frombuffer(data, "<f4" if float(m[4]) < 0 else ">f4", w * h * channels, m.end()).reshape(h, w, channels)[::-1].astype(float)


def write_pfm(a: np.ndarray) -> bytes:
    return f"{'PF' if a.shape[2] == 3 else 'Pf'}\n{a.shape[1]} {a.shape[0]}\n-1.0\n".encode() + a[::-1].astype("<f4").tobytes()


_PNG = b"\x89PNG\r\n\x1a\n"


def write_png(a: np.ndarray, bits: int = 8) -> bytes:
    v = np.floor(np.clip(a, 0, 1) * (2**bits - 1) + 0.5).astype(">u2" if bits > 8 else "u1")
    h, w, c = v.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.frombuffer(v.tobytes(), np.uint8).reshape(h, -1)], axis=1)
    block = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return _PNG + block(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + block(b"IDAT", zlib.compress(rows.tobytes())) + block(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    if data[:8] != _PNG:
        raise Unsupported("not a PNG file")
    at, head, parts = 8, None, []
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if head is None or head[2] not in (8, 16) or head[3] not in (0, 2, 4, 6) or head[6]:
        raise Unsupported("only 8 and 16 bits without palette or interlacing")
    w, h, bits, colour = head[:4]
    c = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = c * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, -1)
    out, up = np.zeros((h, raw.shape[1] - 1), np.uint8), np.zeros(raw.shape[1] - 1, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + up
        elif kind:
            done = np.zeros(len(line), int)
            for x in range(len(line)):
                l, u, d = (done[x - step], int(up[x]), int(up[x - step])) if x >= step else (0, int(up[x]), 0)
                p = l + u - d
                guess = (l + u) // 2 if kind == 3 else min((l, u, d), key=lambda q: (abs(p - q), (l, u, d).index(q)))
                done[x] = (int(line[x]) + guess) & 255
            line = done.astype(np.uint8)
        out[y] = up = line
    return np.frombuffer(out.tobytes(), ">u2" if bits == 16 else "u1").reshape(h, w, c) / float(2**bits - 1)


def write_qoi(a: np.ndarray) -> bytes:
    v = np.floor(np.clip(a, 0, 1) * 255 + 0.5).astype(int)
    h, w, c = v.shape
    out, seen, last, run = bytearray(b"qoif" + struct.pack(">IIBB", w, h, c, 0)), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    for px in v.reshape(-1, c):
        p = (*px.tolist(), 255) if c == 3 else tuple(px.tolist())
        if p == last:
            run += 1
            if run == 62:
                out.append(0xC0 | 61)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        k = (p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64
        d = [(p[i] - last[i] + 128) % 256 - 128 for i in range(3)]
        if seen[k] == p:
            out.append(k)
        elif p[3] != last[3]:
            out += bytes([0xFF, *p])
        elif all(-2 <= x <= 1 for x in d):
            out.append(0x40 | d[0] + 2 << 4 | d[1] + 2 << 2 | d[2] + 2)
        elif -32 <= d[1] <= 31 and -8 <= d[0] - d[1] <= 7 and -8 <= d[2] - d[1] <= 7:
            out += bytes([0x80 | d[1] + 32, d[0] - d[1] + 8 << 4 | d[2] - d[1] + 8])
        else:
            out += bytes([0xFE, *p[:3]])
        seen[k] = last = p
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out + b"\0" * 7 + b"\1")


def read_qoi(data: bytes) -> np.ndarray:
    if data[:4] != b"qoif":
        raise Unsupported("not a QOI file")
    w, h, c, _ = struct.unpack_from(">IIBB", data, 4)
    out, seen, p, at = [], [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14
    while len(out) < w * h:
        b = data[at]
        at += 1
        if b == 0xFE:
            p, at = (*data[at : at + 3], p[3]), at + 3
        elif b == 0xFF:
            p, at = tuple(data[at : at + 4]), at + 4
        elif b >> 6 == 0:
            p = seen[b]
        elif b >> 6 == 1:
            p = ((p[0] + (b >> 4 & 3) - 2) % 256, (p[1] + (b >> 2 & 3) - 2) % 256, (p[2] + (b & 3) - 2) % 256, p[3])
        elif b >> 6 == 2:
            g = (b & 63) - 32
            e = data[at]
            at += 1
            p = ((p[0] + g - 8 + (e >> 4)) % 256, (p[1] + g) % 256, (p[2] + g - 8 + (e & 15)) % 256, p[3])
        else:
            out += [p] * ((b & 63) + 1)
            continue
        seen[(p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64] = p
        out.append(p)
    return np.array(out[: w * h], float).reshape(h, w, 4)[:, :, :c] / 255


def write_rgbe(a: np.ndarray) -> bytes:
    top = a.max(axis=2)
    e = np.where(top > 1e-32, np.ceil(np.log2(np.maximum(top, 1e-38)) + 1e-12), -128).astype(int)
    v = np.where(top[..., None] > 1e-32, np.clip(a * 256.0 / 2.0 ** e[..., None].astype(float), 0, 255), 0).astype(np.uint8)
    return f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {a.shape[0]} +X {a.shape[1]}\n".encode() + np.concatenate([v, (e + 128).clip(0, 255).astype(np.uint8)[..., None]], axis=2).tobytes()


def read_rgbe(data: bytes) -> np.ndarray:
    m = re.search(rb"\n\n-Y (\d+) \+X (\d+)\n", data)
    if not data.startswith(b"#?") or not m:
        raise Unsupported("not an RGBE file")
    h, w = int(m[1]), int(m[2])
    v = np.frombuffer(data, np.uint8, h * w * 4, m.end()).reshape(h, w, 4).astype(float)
    return np.where(v[..., 3:] > 0, (v[..., :3] + 0.5) / 256 * 2.0 ** (v[..., 3:] - 128), 0)


def write_tiff(a: np.ndarray, bits: int = 16) -> bytes:
    """Little-endian, one strip, not compressed; 32 bits are floats."""
    h, w, c = a.shape
    data = a.astype("<f4").tobytes() if bits == 32 else np.floor(np.clip(a, 0, 1) * (2**bits - 1) + 0.5).astype("<u2" if bits == 16 else "u1").tobytes()
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, bits), (259, 3, 1, 1), (262, 3, 1, 2 if c >= 3 else 1), (273, 4, 1, 8), (277, 3, 1, c), (278, 4, 1, h), (279, 4, 1, len(data)), (339, 3, 1, 3 if bits == 32 else 1)]
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0" * 4


def read_tiff(data: bytes) -> np.ndarray:
    if data[:4] != b"II*\0":
        raise Unsupported("only little-endian TIFF")
    at = struct.unpack_from("<I", data, 4)[0]
    tags = {t: v for t, _, _, v in (struct.unpack_from("<HHII", data, at + 2 + 12 * i) for i in range(struct.unpack_from("<H", data, at)[0]))}
    if tags.get(259, 1) != 1:
        raise Unsupported("only TIFF without compression")
    w, h, c, bits = tags[256], tags[257], tags.get(277, 1), tags[258]
    kind = "<f4" if tags.get(339) == 3 else "<u2" if bits == 16 else "u1"
    return np.frombuffer(data, kind, w * h * c, tags[273]).reshape(h, w, c) / (1.0 if kind == "<f4" else float(2**bits - 1))


READERS = {"ppm": read_pnm, "pgm": read_pnm, "pnm": read_pnm, "pfm": read_pfm, "png": read_png, "qoi": read_qoi, "hdr": read_rgbe, "rgbe": read_rgbe, "tif": read_tiff, "tiff": read_tiff, "jpg": jpeg.decode, "jpeg": jpeg.decode}
WRITERS = {"ppm": write_pnm, "pnm": write_pnm, "pfm": write_pfm, "png": write_png, "qoi": write_qoi, "hdr": write_rgbe, "tif": write_tiff, "tiff": write_tiff, "jpg": jpeg.encode, "jpeg": jpeg.encode}


def decode(path: str, data: bytes) -> np.ndarray:
    e = path.rsplit(".", 1)[-1].lower()
    if e not in READERS:
        raise Unsupported(f"no decoder for .{e}")
    return READERS[e](data)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, pixels, error) of all image files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(READERS) + "}").load(folder).select("path", "content")

    def run(frames):
        for f in frames:
            out = []
            for path, data in zip(f.path, f.content):
                try:
                    a = decode(path, data)
                    out.append((path, *a.shape, a.ravel(), None))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    out.append((path, 0, 0, 0, np.zeros(0), str(e)))
            yield pd.DataFrame(out, columns=["path", "height", "width", "channels", "pixels", "error"])

    return files.mapInPandas(run, "path string, height int, width int, channels int, pixels array<double>, error string")


def encode_images(images: DataFrame, extension: str, **options) -> DataFrame:
    """(path, content) from rows (path, height, width, channels, pixels)."""
    writer = WRITERS.get(extension)
    if writer is None:
        raise Unsupported(f"no encoder for .{extension}")

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"path": f.path, "content": [writer(np.asarray(p).reshape(h, w, c), **options) for p, h, w, c in zip(f.pixels, f.height, f.width, f.channels)]})

    return images.mapInPandas(run, "path string, content binary")


EXIF_SCHEMA = "path string, maker string, model string, lens string, orientation int, datetime string, exposure double, aperture double, iso double, focal_length double, exposure_bias double, exposure_program int, metering_mode int, flash int, width int, height int, lat double, lon double, alt double, error string"


def read_exif(files: DataFrame) -> DataFrame:
    """EXIF_SCHEMA of rows (path, content): what JPEG and TIFF files say of their pictures; what they don't say is null."""
    names = [c.split(" ")[0] for c in EXIF_SCHEMA.split(", ")]

    def run(frames):
        for f in frames:
            out = []
            for path, data in zip(f.path, f.content, strict=True):
                row = dict.fromkeys(names) | {"path": path}
                try:
                    found = jpeg.read_exif(bytes(data))
                    found["datetime"] = found.get("datetime_original") or found.get("datetime")
                    row |= {k: v for k, v in found.items() if k in row and not isinstance(v, list)}
                except (ValueError, struct.error) as e:
                    row["error"] = str(e)
                out.append(tuple(row[n] for n in names))
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, EXIF_SCHEMA)


def import_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Film rolls (folder) and image rows (path, folder, filename, kind, modified, length) of a folder tree; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    e = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    kind = F.when(e.isin(*RAW_EXTENSIONS), "raw").when(e.isin(*HDR_EXTENSIONS), "hdr").when(e.isin(*LDR_EXTENSIONS), "ldr")
    images = files.withColumn("kind", kind).where("kind is not null").withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("filename", F.regexp_extract("path", r"([^/]*)$", 1))
    return images.select("folder").distinct(), images
