"""Images as columns: data URLs, and overlapping corner crops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import png

# Media types by file ending; the default, and the crops' share of a side.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "tiff": "image/tiff", "tif": "image/tiff"}
DEFAULT_MIME, LEAST_SIDE, MOST_IMAGES = "image/png", 500, 3


def mime(path: Column) -> Column:
    """Media type by the path's ending."""
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], F.lit(DEFAULT_MIME))


def data_url(content: Column, path: Column) -> Column:
    """The bytes as a data URL."""
    # Spark breaks lines of base64; a data URL has none
    return F.concat(F.lit("data:"), mime(path), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def crop_boxes(width: int, height: int) -> list[tuple[int, int, int, int]]:
    """Four corner boxes of three fifths of each side; none if a side is short."""
    if min(width, height) < LEAST_SIDE:
        return []
    w, h = (3 * width + 4) // 5, (3 * height + 4) // 5
    return [(x, y, x + w, y + h) for y in (0, height - h) for x in (0, width - w)]


def crop_columns(width: Column, height: Column, essay: Column, n_images: Column) -> Column:
    """The boxes of ``crop_boxes`` as an array column; none for essays or beside more than three images."""
    w, h = (F.floor((3 * x + 4) / 5).cast("int") for x in (width, height))
    box = lambda x, y: F.array(x, y, x + w, y + h)
    zero = F.lit(0)
    boxes = F.array(box(zero, zero), box(width - w, zero), box(zero, height - h), box(width - w, height - h))
    fits = ~essay & (n_images <= MOST_IMAGES) & (F.least(width, height) >= LEAST_SIDE)
    return F.when(F.coalesce(fits, F.lit(False)), boxes).otherwise(F.array().cast("array<array<int>>"))


def crops(images: DataFrame) -> DataFrame:
    """id, path, nth, box, content, error: each image (id, path, content) as it is, nth 0, and its PNG crops.

    Crops are made of PNG images; others need an imaging library, and where
    that is absent, or an image is broken, ``error`` tells so beside nth 0.
    """

    def pixels(content: bytes):
        if content[:8] == png.SIGNATURE:
            return png.decode(content)
        from io import BytesIO

        import numpy as np
        from PIL import Image

        with Image.open(BytesIO(content)) as image:
            return np.asarray(image.convert("RGB"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, path, content in zip(batch["id"], batch["path"], batch["content"]):
                rows, error = [], None
                try:
                    image = pixels(content)
                    for nth, (x, y, right, bottom) in enumerate(crop_boxes(image.shape[1], image.shape[0]), 1):
                        rows.append((key, path, nth, [x, y, right, bottom], png.encode(image[y:bottom, x:right]), None))
                except (ImportError, ValueError, OSError) as why:
                    error = f"{type(why).__name__}: {why}"
                yield pd.DataFrame([(key, path, 0, None, content, error), *rows], columns=["id", "path", "nth", "box", "content", "error"])

    return images.filter("content is not null").select("id", "path", "content").mapInPandas(run, "id string, path string, nth int, box array<int>, content binary, error string")
