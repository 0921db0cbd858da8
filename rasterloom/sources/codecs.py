"""Image files to arrays and back: bitmaps, PNG and TIFF; JPEG is written here and read by Spark's image source.

Decoders give (image, white): an (h, w, channels) array of samples and the white
level.  What the formats allow beyond that (interlacing, CMYK, odd depths) is
refused with a ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np


def decode_bmp(data: bytes) -> tuple[np.ndarray, float]:
    """An uncompressed 8-bit palette or 24-bit bitmap."""
    if data[:2] != b"BM":
        raise ValueError("not a bitmap")
    offset, size, width, height, planes, bits, packing, _, _, _, colours, _ = struct.unpack_from("<10x I I i i H H I I i i I I", data)
    if size < 40 or planes != 1 or packing or bits not in (8, 24) or width <= 0 or not height:
        raise ValueError("only uncompressed 8-bit and 24-bit bitmaps")
    h, stride = abs(height), (width * bits // 8 + 3) & ~3
    rows = np.frombuffer(data, np.uint8, h * stride, offset).reshape(h, stride)
    if bits == 8:
        n = colours or 256
        palette = np.frombuffer(data, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
        out = palette[rows[:, :width]]
    else:
        out = rows[:, : 3 * width].reshape(h, width, 3)[:, :, ::-1]
    return (out[::-1] if height > 0 else out), 255.0


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit bitmap of an (h, w, 3) or (h, w, 1) array of bytes."""
    h, w, n = image.shape
    rgb = np.repeat(image, 3, 2) if n == 1 else image
    stride = (3 * w + 3) & ~3
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHI", b"BM", 54 + h * stride, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, h * stride, 0, 0, 0, 0) + rows.tobytes()


def _unfiltered(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG's decompressed data without their filters."""
    rows = np.frombuffer(raw, np.uint8, h * (stride + 1)).reshape(h, stride + 1)
    out = np.zeros((h + 1, stride), np.uint8)  # a row of zeros stands before the first
    for y in range(h):
        kind, line, up = int(rows[y, 0]), rows[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            pad = np.zeros(-(-stride // step) * step, np.uint8)
            pad[:stride] = line
            out[y + 1] = np.add.accumulate(pad.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            now, above, left = line.tolist(), up.tolist(), [0] * step
            done = left + now
            for i, v in enumerate(now):
                a, b = done[i], above[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[i - step] if i >= step else 0
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                done[i + step] = (v + guess) & 255
            out[y + 1] = done[step:]
        else:
            raise ValueError("unknown PNG filter")
    return out[1:]


def decode_png(data: bytes) -> tuple[np.ndarray, float]:
    """Any depth and colour type without interlacing: palettes become RGB, small greys 8 bits, transparency a fourth channel of colours; greys lose their alpha."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, chunks, packed = 8, {}, []
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        packed.append(body) if kind == b"IDAT" else chunks.setdefault(kind, body)
        at += 12 + size
    w, h, bits, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    if interlace or not w or not h:
        raise ValueError("interlaced or empty PNG")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride = -(-w * n * bits // 8)
    rows = _unfiltered(zlib.decompress(b"".join(packed)), h, stride, max(1, n * bits // 8))
    if bits == 16:
        image = rows.view(">u2").astype(np.uint16).reshape(h, w, n)
    elif bits == 8:
        image = rows.reshape(h, w, n)
    else:
        places = np.arange(8 - bits, -1, -bits)
        image = ((rows[..., None] >> places) & ((1 << bits) - 1)).astype(np.uint8).reshape(h, -1)[:, :w, None]
    if colour == 3:
        table = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3)
        if b"tRNS" in chunks:
            alpha = np.full(len(table), 255, np.uint8)
            alpha[: len(chunks[b"tRNS"])] = np.frombuffer(chunks[b"tRNS"], np.uint8)
            table = np.concatenate([table, alpha[:, None]], 1)
        image = table[image[..., 0]]
    elif colour == 0 and bits < 8:
        image = image * np.uint8(255 // ((1 << bits) - 1))
    elif colour == 2 and b"tRNS" in chunks:
        clear = (image == np.array(struct.unpack(">3H", chunks[b"tRNS"]))).all(-1)
        image = np.concatenate([image, np.where(clear, 0, 65535 if bits == 16 else 255)[..., None].astype(image.dtype)], 2)
    if colour in (0, 4):
        image = image[..., :1]
    return image, 65535.0 if bits == 16 else 255.0


def encode_png(image: np.ndarray) -> bytes:
    """PNG of an (h, w, 1, 3 or 4) array of 8 or 16 bits."""
    h, w, n = image.shape
    colour = {1: 0, 3: 2, 4: 6}[n]
    rows = image.astype(">u2" if image.dtype.itemsize == 2 else np.uint8).reshape(h, -1).view(np.uint8)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8 * image.dtype.itemsize, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _unpacked_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _unpacked_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, growing one code early; 256 clears the table, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
        out += word
        last = word
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


_UNPACK: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: _unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked_bits}


def decode_tiff(data: bytes) -> tuple[np.ndarray, float]:
    """First image: strips or tiles, 8, 16 or 32 bits (signed, unsigned or float), plain, LZW, Deflate or PackBits; no CMYK."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack_from(order + "I", data, 4)[0]
    kinds = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in kinds:
            continue
        size = struct.calcsize(f"{order}{n}{kinds[kind]}")
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        tags[tag] = struct.unpack_from(f"{order}{n}{kinds[kind]}", data, where)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, bits, n, form = one(256, 0), one(257, 0), one(258, 0), one(277, 1) or 1, one(339, 1)
    if not w or not h or not bits:
        raise ValueError("TIFF without size or depth")
    if one(262, 1) == 5:
        raise ValueError("CMYK TIFF")
    if bits not in ((32,) if form == 3 else (8, 16, 32)) or one(259, 1) not in _UNPACK:
        raise ValueError(f"TIFF of {bits} bits, compression {one(259, 1)}")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
    apart = one(284, 1) == 2  # planes one after the other
    image = np.zeros((h, w, n), kind.newbyteorder("="))
    tiled = 322 in tags
    tw, th = (one(322, w), one(323, h)) if tiled else (w, min(h, one(278, h)))
    across, per, each = -(-w // tw), -(-w // tw) * -(-h // th), 1 if apart else n
    for i, (start, size) in enumerate(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True)):
        plane, place = divmod(i, per)
        y, x = place // across * th, place % across * tw
        rows = th if tiled else min(th, h - y)
        part = np.frombuffer(_UNPACK[one(259, 1)](data[start : start + size]), kind, rows * tw * each).reshape(rows, tw, each)
        if one(317, 1) == 2:
            part = np.add.accumulate(part, axis=1, dtype=kind.newbyteorder("="))
        part = part[: h - y, : w - x]
        image[y : y + part.shape[0], x : x + part.shape[1], plane if apart else slice(None)] = part[..., 0] if apart else part
    return image, 1.0 if form == 3 else float(2 ** (bits - (form == 2)) - 1)


def encode_tiff(image: np.ndarray) -> bytes:
    """Uncompressed little-endian TIFF of one strip, 8 or 16 bits, 1, 3 or 4 channels."""
    h, w, n = image.shape
    bits = 8 * image.dtype.itemsize
    body = image.astype(f"<u{bits // 8}").tobytes()
    extra = struct.pack(f"<{n}H", *[bits] * n)
    start = 8
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, n, bits if n == 1 else start + len(body)), (259, 3, 1, 1), (262, 3, 1, 1 if n == 1 else 2), (273, 4, 1, start), (277, 3, 1, n), (278, 4, 1, h), (279, 4, 1, len(body)), (284, 3, 1, 1)]
    if n == 4:
        tags.append((338, 3, 1, 2))
    table = start + len(body) + len(extra)
    table += table % 2
    return struct.pack("<2sHI", b"II", 42, table) + body + extra + b"\0" * (table - start - len(body) - len(extra)) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"


# Fixed values of the JPEG standard: the zigzag order and the example quantisation tables.
_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
_CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)


def _huffman(counts: np.ndarray) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """(codes of each length 1 to 16, symbols, symbol to (code, length)) for symbols that occur so often; codes of more than 16 bits are shortened as the standard says."""
    import heapq

    symbols = [int(s) for s in np.flatnonzero(counts)]
    heap = [(int(counts[s]), i, [s]) for i, s in enumerate(symbols)] + [(0, len(symbols), [-1])]  # a symbol that is never used keeps the all-ones code free
    depth = dict.fromkeys([*symbols, -1], 0)
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], made, a[2] + b[2]))
        made += 1
    of = [0] * 64
    for d in depth.values():
        of[max(1, d)] += 1
    for d in range(63, 16, -1):  # two leaves too deep: one goes up a level, the other takes the place beside a leaf above
        while of[d]:
            j = next(k for k in range(d - 2, 0, -1) if of[k])
            of[d] -= 2
            of[d - 1] += 1
            of[j + 1] += 2
            of[j] -= 1
    of[max(d for d in range(17) if of[d])] -= 1  # that of the unused symbol
    ranked = sorted(symbols, key=lambda s: (depth[s], s))
    lengths = [d for d in range(1, 17) for _ in range(of[d])]
    codes, code, last = {}, 0, 0
    for s, n in zip(ranked, lengths, strict=True):
        code <<= n - last
        codes[s] = code, n
        code, last = code + 1, n
    return of[1:17], ranked, codes


def encode_jpeg(image: np.ndarray, quality: int = 96) -> bytes:
    """Baseline JPEG of an (h, w, 1 or 3) array of bytes, without chroma subsampling, with Huffman tables made for the image."""
    h, w, n = image.shape
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (_LUMA, _CHROMA)][: 1 + (n == 3)]
    v = image.astype(float)
    if n == 3:
        r, g, b = v[..., 0], v[..., 1], v[..., 2]
        v = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b], -1)
    v = np.pad(v - 128, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    k = np.arange(8)
    basis = np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    blocks = v.reshape(v.shape[0] // 8, 8, v.shape[1] // 8, 8, n).transpose(0, 2, 4, 1, 3)
    freq = basis @ blocks @ basis.T
    quant = np.stack([tables[min(c, len(tables) - 1)].reshape(8, 8) for c in range(n)])
    coded = np.rint(freq / quant).astype(int).reshape(-1, n, 64)[..., _ZIGZAG]
    events: list[tuple[int, int, int, int]] = []  # table (DC, AC by component class), symbol, extra bits, their number
    before = [0] * n
    for block in coded.tolist():
        for c, row in enumerate(block):
            put = min(c, 1) * 2
            d, before[c] = row[0] - before[c], row[0]
            size = abs(d).bit_length()
            events.append((put, size, d if d >= 0 else d + (1 << size) - 1, size))
            run = 0
            last = max((i for i in range(1, 64) if row[i]), default=0)
            for a in row[1 : last + 1]:
                if not a:
                    run += 1
                    continue
                while run > 15:
                    events.append((put + 1, 0xF0, 0, 0))
                    run -= 16
                size = abs(a).bit_length()
                events.append((put + 1, run << 4 | size, a if a >= 0 else a + (1 << size) - 1, size))
                run = 0
            if last < 63:
                events.append((put + 1, 0, 0, 0))
    seen = np.zeros((4, 256), np.int64)
    for t, s, _, _ in events:
        seen[t, s] += 1
    made = [_huffman(x) for x in seen[: 2 * len(tables)]]
    held, bits, out = 0, 0, bytearray()
    for t, s, extra, size in events:
        code, length = made[t][2][s]
        held, bits = held << length + size | code << size | extra, bits + length + size
        while bits >= 8:
            bits -= 8
            byte = held >> bits & 255
            out.append(byte)
            if byte == 255:
                out.append(0)
            held &= (1 << bits) - 1
    if bits:
        byte = (held << 8 - bits | (1 << 8 - bits) - 1) & 255
        out += b"\xff\0" if byte == 255 else bytes([byte])
    segment = lambda mark, body: struct.pack(">BBH", 255, mark, len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    head += b"".join(segment(0xDB, bytes([i]) + bytes(t[_ZIGZAG].tolist())) for i, t in enumerate(tables))
    head += segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(n)))
    head += b"".join(segment(0xC4, bytes([(i % 2) << 4 | i // 2]) + bytes(counts) + bytes(symbols)) for i, (counts, symbols, _) in enumerate(made))
    head += segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, min(c, 1) * 0x11]) for c in range(n)) + b"\0\x3f\0")
    return head + bytes(out) + b"\xff\xd9"


DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, float]]] = {"bmp": decode_bmp, "png": decode_png, "tif": decode_tiff, "tiff": decode_tiff}
ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {"bmp": encode_bmp, "png": encode_png, "tiff": encode_tiff, "jpeg": encode_jpeg}
#: Numbers of channels that a format holds.
CHANNELS = {"png": (1, 3, 4), "tiff": (1, 3, 4), "jpeg": (1, 3), "bmp": (1, 3)}
