"""TIFF images of 8-bit samples: image directories, strips and tiles, four compressions and the horizontal predictor."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Fixed values of the format.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
PAGE_NUMBER = 297
_TYPES = {1: "B", 3: "H", 4: "I"}
_CLEAR, _END = 256, 257


def pack_bits(data: bytes) -> bytes:
    """Runs of a byte as (1 - length, byte), other bytes as (length - 1, bytes)."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.concatenate(([0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]))
    out, plain = bytearray(), bytearray()

    def flush() -> None:
        for i in range(0, len(plain), 128):
            part = plain[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        plain.clear()

    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if e - s < 3:
            plain += data[s:e]
            continue
        flush()
        for n in [128] * ((e - s) // 128) + [(e - s) % 128]:
            if n == 1:
                plain.append(data[s])
            elif n:
                out += bytes((257 - n, data[s]))
    flush()
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; a code widens one entry early, as the format wants."""
    table = {bytes((i,)): i for i in range(256)}
    bits, n_bits, width, out = _CLEAR, 9, 9, bytearray()
    fresh, code, word = 258, 0, b""

    def put(value: int) -> None:
        nonlocal bits, n_bits
        bits, n_bits = bits << width | value, n_bits + width
        while n_bits >= 8:
            n_bits -= 8
            out.append(bits >> n_bits & 255)
        bits &= (1 << n_bits) - 1

    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = fresh
        fresh += 1
        if fresh == 4095:
            put(_CLEAR)
            table, fresh, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif fresh + 1 > 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        fresh += 1
        if fresh + 1 > 1 << width and width < 12:
            width += 1
    put(_END)
    if n_bits:
        out.append(bits << (8 - n_bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, total = [], 0
    bits = n_bits = i = 0
    width, table, before = 9, [], b""
    while total < size:
        while n_bits < width and i < len(data):
            bits, n_bits, i = bits << 8 | data[i], n_bits + 8, i + 1
        if n_bits < width:
            break
        n_bits -= width
        code = bits >> n_bits
        bits &= (1 << n_bits) - 1
        if code == _END:
            break
        if code == _CLEAR:
            table = [bytes((x,)) for x in range(256)] + [b"", b""]
            width, before = 9, b""
            continue
        word = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + word[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(word)
        total += len(word)
        before = word
    return b"".join(out)[:size]


def _compress(data: bytes, compression: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    return {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode}[compression](data)


def _expand(data: bytes, compression: int, size: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)[:size]
    if compression == NONE:
        return data[:size]
    if compression not in (PACKBITS, LZW):
        raise ValueError(f"compression {compression} isn't known")
    return (unpack_bits if compression == PACKBITS else lzw_decode)(data, size)


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """Little-endian file of grey pages (arrays of bytes, height by width), in strips, or in tiles of ``tile`` = (width, height)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4  # where the offset of the next directory goes
    for number, page in enumerate(pages):
        height, width = page.shape
        tags: list[tuple[int, int, list[int]]] = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor]), (PAGE_NUMBER, 3, [number & 0xFFFF, len(pages) & 0xFFFF])]
        parts = []
        if tile:
            across, down = tile
            padded = np.pad(page, ((0, -height % down), (0, -width % across)))
            blocks = [padded[y : y + down, x : x + across] for y in range(0, height, down) for x in range(0, width, across)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        for block in blocks:
            if predictor == 2:
                block = block.copy()
                block[:, 1:] -= block[:, :-1].copy()
            parts.append(_compress(block.tobytes(), compression))
        offsets = []
        for part in parts:
            offsets.append(len(out))
            out += part + b"\0" * (len(part) % 2)
        sizes = [len(p) for p in parts]
        tags += [(TILE_WIDTH, 4, [tile[0]]), (TILE_HEIGHT, 4, [tile[1]]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"<{len(values)}{_TYPES[kind]}", *values)
            if len(data) > 4:
                place = len(out)
                out += data
                data = struct.pack("<I", place)
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a file in order, each height by width (by samples, if there are several) of bytes."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple[int, ...]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in _TYPES:
                size = struct.calcsize(_TYPES[kind]) * count
                place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{_TYPES[kind]}", data, place)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
        yield _page(data, tags)


def _page(data: bytes, tags: dict[int, tuple[int, ...]]) -> np.ndarray:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    if any(b != 8 for b in tags.get(BITS, (1,))):
        raise ValueError("samples aren't of 8 bits")
    tiled = TILE_OFFSETS in tags
    across = one(TILE_WIDTH, width) if tiled else width
    down = one(TILE_HEIGHT, height) if tiled else min(one(ROWS_PER_STRIP, height), height)
    page = np.empty((height, width, samples), np.uint8)
    per_row = -(-width // across)
    for k, (offset, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
        y, x = k // per_row * down, k % per_row * across
        rows = down if tiled else min(down, height - y)
        block = np.frombuffer(_expand(data[offset : offset + size], one(COMPRESSION, NONE), rows * across * samples), np.uint8).reshape(rows, across, samples)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        page[y : y + rows, x : x + across] = block[: height - y, : width - x]
    return page[:, :, 0] if samples == 1 else page
