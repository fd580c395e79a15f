"""Baseline JPEG in numpy: reading (any subsampling, restarts, grey or colour) and writing (4:4:4, quality 1 to 100), and EXIF.

Progressive, lossless and arithmetic-coded files raise ValueError. Entropy coding walks symbol by
symbol in Python; transforms are one matrix product for all blocks.
"""

from __future__ import annotations

import math
import struct

import numpy as np

# Fixed values of the standard's annex K: quantisation of luminance and chrominance at quality 50, row by row.
LUMA = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
CHROMA = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"
# EXIF tags of interest, and sizes of its types.
TAGS = {0x010F: "maker", 0x0110: "model", 0x0112: "orientation", 0x0132: "datetime", 0x829A: "exposure", 0x829D: "aperture", 0x8822: "exposure_program", 0x8827: "iso", 0x9003: "datetime_original", 0x9004: "datetime_digitized", 0x9204: "exposure_bias", 0x9207: "metering_mode", 0x9209: "flash", 0x920A: "focal_length", 0xA002: "width", 0xA003: "height", 0xA434: "lens", 0xA405: "focal_length_35mm", 0x4746: "rating"}
GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

_K = np.arange(8)
_DCT = np.sqrt(np.where(_K[:, None] == 0, 1, 2) / 8) * np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16)
#: Places of a block's coefficients in the order of the file: along diagonals, turning at the edges.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _table(numbers: str, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(numbers.split(), int) * scale + 50) // 100, 1, 255)


class _Codes:
    """A Huffman code from how many codes there are of each length, and their symbols in order."""

    def __init__(self, counts: list[int], symbols: list[int]):
        self.counts, self.symbols, self.code, self.find = counts, symbols, {}, {}
        code, at = 0, 0
        for length in range(1, 17):
            for s in symbols[at : at + counts[length - 1]]:
                self.code[s], self.find[length, code] = (code, length), s
                code += 1
            at += counts[length - 1]
            code <<= 1


def _optimal(frequency: dict[int, int]) -> _Codes:
    """A code of at most 16 bits for symbols as often as given, none of it all ones."""
    weights = {s: [n, [s]] for s, n in frequency.items()} | {-1: [0, [-1]]}
    length = dict.fromkeys(weights, 0)
    heap = sorted(weights.values(), key=lambda w: (w[0], -w[1][0]))
    while len(heap) > 1:
        (n, a), (m, b) = heap[0], heap[1]
        for s in a + b:
            length[s] += 1
        heap = sorted([*heap[2:], [n + m, a + b]], key=lambda w: (w[0], -w[1][0]))
    counts = [0] * max(33, max(length.values()) + 1)
    for n in length.values():
        counts[n] += 1
    for n in range(len(counts) - 1, 16, -1):  # too long: a pair moves up, a shorter code makes room
        while counts[n]:
            j = n - 2
            while not counts[j]:
                j -= 1
            counts[n] -= 2
            counts[n - 1] += 1
            counts[j + 1] += 2
            counts[j] -= 1
    longest = max(i for i, c in enumerate(counts) if c)
    counts[longest] -= 1  # the reserved symbol had the longest
    order = sorted((s for s in length if s >= 0), key=lambda s: (length[s], -frequency[s], s))
    return _Codes(counts[1:17], order)


def _magnitude(v: int) -> tuple[int, int]:
    """Size in bits, and the bits, of a coefficient."""
    size = abs(v).bit_length()
    return size, v if v >= 0 else v + (1 << size) - 1


def encode(pixels: np.ndarray, quality: int = 95) -> bytes:
    """Height x width x 1 or 3 values in [0, 1], display-coded."""
    if not 1 <= quality <= 100:
        raise ValueError("quality lies between 1 and 100")
    a = np.floor(np.clip(pixels[..., :3], 0, 1) * 255 + 0.5)
    h, w, n = a.shape
    if n == 3:
        r, g, b = np.moveaxis(a, -1, 0)
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    else:
        planes = [a[..., 0]]
    tables = [_table(LUMA, quality), _table(CHROMA, quality)]
    streams = []
    for i, p in enumerate(planes):
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
        blocks = p.reshape(p.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        c = (_DCT @ blocks @ _DCT.T).reshape(-1, 64) / tables[min(i, 1)]
        streams.append(np.round(c).astype(int)[:, ZIGZAG])
    symbols: list[tuple[int, int, int, int]] = []  # (table, symbol, size, bits)
    before = [0] * len(planes)
    for row in range(len(streams[0])):
        for i, s in enumerate(streams):
            kind = min(i, 1)
            block = s[row]
            size, bits = _magnitude(int(block[0]) - before[i])
            before[i] = int(block[0])
            symbols.append((kind, size, size, bits))
            last = 0
            for k in np.flatnonzero(block[1:]).tolist():
                run = k - last
                last = k + 1
                for _ in range(run // 16):
                    symbols.append((2 + kind, 0xF0, 0, 0))
                size, bits = _magnitude(int(block[k + 1]))
                symbols.append((2 + kind, run % 16 << 4 | size, size, bits))
            if last < 63:
                symbols.append((2 + kind, 0, 0, 0))
    seen: list[dict[int, int]] = [{} for _ in range(4)]
    for t, s, _, _ in symbols:
        seen[t][s] = seen[t].get(s, 0) + 1
    codes = [_optimal(f) if f else None for f in seen]
    bits_ = "".join(format(codes[t].code[s][0], f"0{codes[t].code[s][1]}b") + (format(b, f"0{n}b") if n else "") for t, s, n, b in symbols)
    bits_ += "1" * (-len(bits_) % 8)
    body = int(bits_, 2).to_bytes(len(bits_) // 8, "big").replace(b"\xff", b"\xff\x00")
    part = lambda marker, data: struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    for i in range(min(len(planes), 2)):
        out += part(0xDB, bytes([i]) + bytes(tables[i][ZIGZAG].tolist()))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(len(planes))))
    for t, c in enumerate(codes):
        if c:
            out += part(0xC4, bytes([t // 2 << 4 | t % 2]) + bytes(c.counts) + bytes(c.symbols))
    out += part(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, min(i, 1) * 0x11]) for i in range(len(planes))) + b"\0\x3f\0")
    return out + body + b"\xff\xd9"


class _Bits:
    """Bits of a scan's data, stuffing removed."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at, self.n = self.at + 1, self.n + 8
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, codes: _Codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (s := codes.find.get((length, code))) is not None:
                return s
        raise ValueError("damaged data")

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _segments(data: bytes):
    """(marker, payload, end) of each marker segment up to the scan's data."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not JPEG")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            raise ValueError("the file is cut off")
        yield marker, data[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size
        if marker == 0xDA:
            return


def decode(data: bytes) -> np.ndarray:
    """Height x width x 1 or 3 values in [0, 1]."""
    quant, codes, frame, restart = {}, {}, None, 0
    for marker, body, end in _segments(data):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide, k = body[at] >> 4, body[at] & 15
                values = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(int)
                quant[k] = np.empty(64, int)
                quant[k][ZIGZAG] = values
                at += 129 if wide else 65
        elif marker == 0xC4:
            at = 0
            while at < len(body):
                counts = list(body[at + 1 : at + 17])
                codes[body[at]] = _Codes(counts, list(body[at + 17 : at + 17 + sum(counts)]))
                at += 17 + sum(counts)
        elif marker in (0xC0, 0xC1):
            depth, h, w, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not h or not w:
                raise ValueError("only 8 bits, and one or three channels")
            frame = h, w, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None or body[0] != len(frame[2]):
                raise ValueError("scans apart")
            tables = {body[1 + 2 * i]: (codes[body[2 + 2 * i] >> 4], codes[0x10 | body[2 + 2 * i] & 15]) for i in range(body[0])}
            return _scan(data[end:], frame, tables, quant, restart)
    raise ValueError("no image data")


def _scan(data: bytes, frame, tables, quant, restart: int) -> np.ndarray:
    h, w, parts = frame
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = math.ceil(w / (8 * most_h)), math.ceil(h / (8 * most_v))
    blocks = [np.zeros((down * p[2], across * p[1], 64), int) for p in parts]
    pieces, start, at = [], 0, 0
    while True:  # cut at restart markers, stop at any other
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            pieces.append(data[start:])
            break
        if data[at + 1] == 0:
            at += 2
        elif 0xD0 <= data[at + 1] <= 0xD7:
            pieces.append(data[start:at])
            start = at = at + 2
        else:
            pieces.append(data[start:at])
            break
    number, bits, before = 0, None, []
    for unit in range(across * down):
        if unit == 0 or (restart and unit % restart == 0):
            if number >= len(pieces):
                raise ValueError("the data is cut off")
            bits, before, number = _Bits(pieces[number]), [0] * len(parts), number + 1
        y, x = divmod(unit, across)
        for i, (name, ph, pv, _) in enumerate(parts):
            dc, ac = tables[name]
            for v in range(pv):
                for u in range(ph):
                    block = blocks[i][y * pv + v, x * ph + u]
                    before[i] += bits.value(bits.symbol(dc))
                    block[0] = before[i]
                    k = 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            if k > 63:
                                raise ValueError("damaged data")
                            block[ZIGZAG[k]] = bits.value(s & 15)
                        k += 1
        if bits.at > len(bits.data) + 8:
            raise ValueError("the data is cut off")
    planes = []
    for b, (_, ph, pv, q) in zip(blocks, parts, strict=True):
        c = (b * quant[q]).reshape(-1, 8, 8)
        p = (_DCT.T @ c @ _DCT).reshape(*b.shape[:2], 8, 8).swapaxes(1, 2).reshape(b.shape[0] * 8, b.shape[1] * 8) + 128
        planes.append(np.repeat(np.repeat(p, most_v // pv, axis=0), most_h // ph, axis=1)[:h, :w])
    if len(planes) == 3:
        y, cb, cr = planes
        planes = [y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]
    return np.clip(np.round(np.stack(planes, axis=-1)), 0, 255) / 255


# --- EXIF


def read_exif(data: bytes) -> dict:
    """What a JPEG or TIFF file says of its picture: TAGS by name, and lat, lon (degrees), alt (metres). Empty if it says nothing."""
    if data[:2] == b"\xff\xd8":
        for marker, body, _ in _segments(data):
            if marker == 0xE1 and body[:6] == b"Exif\0\0":
                return _tiff(body[6:])
        return {}
    return _tiff(data) if data[:2] in (b"II", b"MM") else {}


def _tiff(t: bytes) -> dict:
    order = {b"II": "<", b"MM": ">"}.get(t[:2])
    if order is None or len(t) < 8:
        return {}

    def directory(at: int) -> dict[int, object]:
        out = {}
        if not 0 < at <= len(t) - 2:
            return out
        for i in range(struct.unpack_from(order + "H", t, at)[0]):
            place = at + 2 + 12 * i
            if place + 12 > len(t):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", t, place)
            size = SIZES.get(kind, 0) * count
            place = place + 8 if size <= 4 else struct.unpack_from(order + "I", t, place + 8)[0]
            if size and place + size <= len(t):
                out[tag] = _values(t[place : place + size], kind, count, order)
        return out

    main = directory(struct.unpack_from(order + "I", t, 4)[0])
    found = main | (directory(main[0x8769]) if isinstance(main.get(0x8769), int) else {})
    out = {name: found[tag] for tag, name in TAGS.items() if tag in found}
    gps = {GPS[k]: v for k, v in (directory(main[0x8825]) if isinstance(main.get(0x8825), int) else {}).items() if k in GPS}
    for name, negative in (("lat", "S"), ("lon", "W")):
        parts = gps.get(name)
        if isinstance(parts, list) and len(parts) == 3 and all(isinstance(p, float) for p in parts):
            degrees = parts[0] + parts[1] / 60 + parts[2] / 3600
            out[name] = -degrees if gps.get(f"{name}_ref") == negative else degrees
    if isinstance(gps.get("alt"), float):
        out["alt"] = -gps["alt"] if gps.get("alt_ref") == 1 else gps["alt"]
    return out


def _values(raw: bytes, kind: int, count: int, order: str):
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
    if kind in (5, 10):
        pairs = struct.unpack(order + ("I" if kind == 5 else "i") * 2 * count, raw)
        values = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
    else:
        code = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}[kind]
        values = list(struct.unpack(order + code * count, raw))
    return values[0] if count == 1 else values
