"""PNG images of all kinds against a plain decoder; crops as pixels."""

import struct
import zlib

import numpy as np
import pytest

from lectern.functions import png
from lectern.operators import images


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def plain_filter(lines, step, kinds):
    """Filters rows of bytes, byte by byte."""
    out, above = b"", [0] * len(lines[0])
    for y, line in enumerate(lines):
        kind, row = kinds[y % len(kinds)], []
        for x, v in enumerate(line):
            a, b, c = line[x - step] if x >= step else 0, above[x], above[x - step] if x >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind, *row])
        above = line
    return out


def packed(samples, depth):
    """Rows of bytes of samples of a depth: rows, columns, samples."""
    rows = []
    for line in samples:
        bits = "".join(format(int(v), f"0{depth}b") for v in line.ravel())
        bits += "0" * (-len(bits) % 8)
        rows.append([int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)])
    return rows


def made(rng, w, h, colour, depth, interlaced, kinds=(0, 1, 2, 3, 4)):
    """An image's bytes and its red, green and blue."""
    n = png.SAMPLES[colour]
    palette = rng.integers(0, 256, (min(2**depth, 256), 3))
    s = rng.integers(0, len(palette) if colour == 3 else 2**depth, (h, w, n))
    step, raw = max(1, n * depth // 8), b""
    for x0, dx, y0, dy in png.PASSES if interlaced else ((0, 1, 0, 1),):
        part = s[y0::dy, x0::dx]
        if part.size:
            raw += plain_filter(packed(part, depth), step, kinds)
    squeezed = zlib.compress(raw)
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)) + (chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if colour == 3 else b"")
    half = len(squeezed) // 2
    body += chunk(b"tEXt", b"k\0v") + chunk(b"IDAT", squeezed[:half]) + chunk(b"IDAT", squeezed[half:]) + chunk(b"IEND", b"")
    v = s >> 8 if depth == 16 else s if depth == 8 or colour == 3 else s * 255 // (2**depth - 1)
    return png.SIGNATURE + body, palette[s[..., 0]] if colour == 3 else v[..., :3] if n > 2 else np.repeat(v[..., :1], 3, 2)


KINDS = [(c, d) for c, depths in {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}.items() for d in depths]


@pytest.mark.parametrize("colour,depth", KINDS)
def test_all_kinds_of_images(colour, depth):
    rng = np.random.default_rng(colour * 100 + depth)
    for w, h, interlaced in ((1, 1, 0), (7, 5, 0), (13, 11, 1), (3, 1, 1), (16, 9, 0)):
        content, want = made(rng, w, h, colour, depth, interlaced)
        got = png.decode(content)
        assert got.tolist() == want.tolist()
        assert png.decode(png.encode(got)).tolist() == want.tolist()


def test_broken_images_are_told():
    content, _ = made(np.random.default_rng(1), 9, 9, 2, 8, 0)
    for bad in (b"", b"GIF89a", content[:40], content[:-12], content.replace(b"IDAT", b"IDAX", 1), content[:50] + b"x" + content[51:]):
        with pytest.raises(png.NotPng):
            png.decode(bad)


def test_crops_have_the_pixels_of_their_boxes(spark):
    rng = np.random.default_rng(3)
    big, pixels = made(rng, 510, 501, 2, 8, 0, kinds=(0, 1, 2))
    small, _ = made(rng, 20, 20, 0, 8, 0)
    rows = [("1", "a.png", big), ("2", "b.png", small), ("3", "c.gif", b"GIF89a..."), ("4", "d.png", big[:100]), ("5", "e.png", None)]
    got = images.crops(spark.createDataFrame(rows, "id string, path string, content binary")).collect()
    assert sorted((r["id"], r["nth"]) for r in got) == [("1", n) for n in range(5)] + [("2", 0), ("3", 0), ("4", 0)]
    for r in got:
        if r["nth"]:
            x, y, right, bottom = r["box"]
            assert png.decode(bytes(r["content"])).tolist() == pixels[y:bottom, x:right].tolist()
            assert images.crop_boxes(510, 501)[r["nth"] - 1] == (x, y, right, bottom)
        else:
            assert (r["error"] is None) == (r["id"] in "12") and bytes(r["content"]) == dict((k, c) for k, _, c in rows)[r["id"]]
