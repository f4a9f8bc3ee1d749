"""PNG images as arrays of pixels: read to red, green and blue, cut, and written again.

Filters of a row refer to the row above and to what stands before in the row;
the latter is undone for all rows at once where no filter needs more, else
pixel by pixel along the row, over whole pixels.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The signature; samples of a pixel by colour type; the passes of interlaced images (start and step of columns, of rows).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 8, 0, 8), (4, 8, 0, 8), (0, 4, 4, 8), (2, 4, 0, 4), (0, 2, 2, 4), (1, 2, 0, 2), (0, 1, 1, 2))
#: Pixels beyond which an image is refused: what one task would have to hold.
MOST = 1 << 28


class NotPng(ValueError):
    """Bytes that are no PNG image, or a broken one."""


def chunks(content: bytes):
    """Kind and data of each chunk, whose checksums hold."""
    if content[:8] != SIGNATURE:
        raise NotPng("no signature")
    at = 8
    while at < len(content):
        if at + 12 > len(content):
            raise NotPng("cut off")
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data, told = content[at + 8 : at + 8 + size], content[at + 8 + size : at + 12 + size]
        if len(told) < 4 or zlib.crc32(kind + data) != struct.unpack(">I", told)[0]:
            raise NotPng("a chunk is broken")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size
    raise NotPng("no end")


def _paeth(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    a, b, c = (x.astype(np.int16) for x in (left, above, corner))
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def unfilter(raw: np.ndarray, rows: int, width: int, step: int) -> np.ndarray:
    """The bytes of rows whose filters are undone; ``step`` is how many bytes back the byte before is."""
    lines = raw.reshape(rows, width + 1)
    out = np.zeros((rows, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y in range(rows):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind == 0:
            now = line.copy()
        elif kind == 1:
            padded = np.zeros(-(-width // step) * step, np.uint8)
            padded[:width] = line
            now = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width]
        elif kind == 2:
            now = line + above
        elif kind in (3, 4):
            now = np.zeros(width, np.uint8)
            left = corner = np.zeros(step, np.uint8)
            for x in range(0, width, step):
                up = above[x : x + step]
                if kind == 3:
                    guess = ((left.astype(np.uint16)[: len(up)] + up) >> 1).astype(np.uint8)
                else:
                    guess = _paeth(left[: len(up)], up, corner[: len(up)])
                left = now[x : x + step] = line[x : x + step] + guess
                corner = up
        else:
            raise NotPng(f"filter {kind}")
        out[y] = above = now
    return out


def _samples(lines: np.ndarray, width: int, depth: int, n: int) -> np.ndarray:
    """Rows, columns and samples of unfiltered bytes, as they are stored."""
    rows = len(lines)
    if depth == 8:
        return lines.reshape(rows, width, n)
    if depth == 16:
        return lines.reshape(rows, width, n, 2)[..., 0]  # the high byte
    bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(rows, width, depth)
    return (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[..., None]


def decode(content: bytes) -> np.ndarray:
    """Rows, columns, and red, green and blue of an image; what lies behind transparent pixels is their colour."""
    head, palette, data = None, None, []
    for kind, body in chunks(content):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if head is None:
        raise NotPng("no header")
    width, height, depth, colour, _, _, interlaced = head
    if colour not in SAMPLES or depth not in (1, 2, 4, 8, 16) or not width or not height or width * height > MOST or colour == 3 and palette is None:
        raise NotPng("header")
    n = SAMPLES[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as error:
        raise NotPng(str(error)) from None
    stored = np.zeros((height, width, n), np.uint8)
    at = 0
    for x0, dx, y0, dy in PASSES if interlaced else ((0, 1, 0, 1),):
        columns, rows = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if columns <= 0 or rows <= 0:
            continue
        size = -(-columns * n * depth // 8)
        part = raw[at : at + rows * (size + 1)]
        if len(part) < rows * (size + 1):
            raise NotPng("too few rows")
        stored[y0::dy, x0::dx] = _samples(unfilter(part, rows, size, max(1, n * depth // 8)), columns, depth, n)
        at += rows * (size + 1)
    if colour == 3:
        if int(stored.max()) >= len(palette):
            raise NotPng("no such colour")
        return palette[stored[..., 0]]
    if n <= 2:
        grey = stored[..., :1]
        return np.repeat(grey if depth >= 8 else grey * np.uint8(255 // (2**depth - 1)), 3, axis=2)
    return stored[..., :3]


def encode(pixels: np.ndarray) -> bytes:
    """A PNG image of red, green and blue; each row is told by its difference to the row above."""
    height, width = pixels.shape[:2]
    flat = np.ascontiguousarray(pixels, np.uint8).reshape(height, width * 3)
    lines = np.empty((height, width * 3 + 1), np.uint8)
    lines[:, 0] = 2
    lines[0, 1:], lines[1:, 1:] = flat[0], flat[1:] - flat[:-1]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")
