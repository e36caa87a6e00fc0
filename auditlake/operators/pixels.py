"""Measures of decoded pixels: table (name, width, height, channels, pixels: row by row, 8 bits a channel).

Decoding files is the caller's: the box that built this has no image library. One Arrow map; a task holds one image at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import ship

MEASURED = "name string, fill_pct double, bg_red int, bg_green int, bg_blue int, bg_luminance double, transparent boolean, ahash long, blank boolean, error string"


def luminance(rgb: np.ndarray) -> np.ndarray:
    """Relative luminance of colours of 0 to 255 along the last axis."""
    v = np.asarray(rgb, float) / 255
    linear = np.where(v <= 0.03928, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    return linear @ np.array([0.2126, 0.7152, 0.0722])


def average_hash(gray: np.ndarray) -> int:
    """64 bits, row by row: whether an eighth by an eighth of the image is as light as the mean of all; as a signed integer."""
    h, w = gray.shape
    rows, cols = (np.linspace(0, n, 9).astype(int) for n in (h, w))
    cells = np.array([[gray[rows[i] : max(rows[i + 1], rows[i] + 1), cols[j] : max(cols[j + 1], cols[j] + 1)].mean() for j in range(8)] for i in range(8)])
    bits = np.packbits((cells >= cells.mean()).ravel())
    return int(bits.view(">i8")[0])


def measured(width: int, height: int, channels: int, pixels: bytes, distance: float = 30) -> tuple:
    """The share of the canvas that the subject's box takes, and what lies around it.

    With transparency on 3 % of the pixels or more, the subject is what is opaque. Otherwise the background is the median of
    the border, the subject all that is farther from it than `distance`, its box without the outer 0.4 % on each side.
    """
    image = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(np.int16)
    rgb = image[:, :, :3] if channels >= 3 else np.repeat(image[:, :, :1], 3, axis=2)
    gray = rgb @ np.array([0.299, 0.587, 0.114])
    area, blank = width * height, bool(gray.std() < 3 and gray.mean() > 245)
    if channels in (2, 4) and (image[:, :, -1] < 250).mean() >= 0.03:
        ys, xs = np.where(image[:, :, -1] > 10)
        fill = round(100 * float((np.ptp(xs) + 1) * (np.ptp(ys) + 1)) / area, 1) if len(xs) else 0.0
        return fill, None, None, None, None, True, average_hash(gray), blank
    b = 3 if min(height, width) > 12 else 1
    border = np.concatenate([x.reshape(-1, 3) for x in (rgb[:b], rgb[-b:], rgb[:, :b], rgb[:, -b:])])
    back = np.median(border, axis=0)
    ys, xs = np.where(((rgb - back) ** 2).sum(axis=2) > distance**2)
    fill = None
    if len(xs) > 20:
        (x0, x1), (y0, y1) = (np.percentile(v, [0.4, 99.6]) for v in (xs, ys))
        fill = round(min(100.0, float(100 * (x1 - x0 + 1) * (y1 - y0 + 1)) / area), 1)
    red, green, blue = (int(round(c)) for c in back)
    return fill, red, green, blue, float(luminance(np.array([red, green, blue]))), False, average_hash(gray), blank


def measures(images: DataFrame) -> DataFrame:
    """A row per image; one that can't be read has its error alone."""
    ship(images.sparkSession)
    names = [x.split()[0] for x in MEASURED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int64(), pa.bool_(), pa.string())
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                name, *rest = (batch.column(c)[i].as_py() for c in range(5))
                try:
                    rows.append((name, *measured(*rest), None))
                except (TypeError, ValueError) as e:
                    rows.append((name, *[None] * 8, f"{type(e).__name__}: {e}"[:200]))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return images.select("name", "width", "height", "channels", "pixels").mapInArrow(run, MEASURED)


def text_contrast(pixels: bytes, width: int, height: int, channels: int, box: tuple[int, int, int, int], colour: tuple[int, int, int]) -> float | None:
    """The contrast that 90 % of a box's pixels (x, y, w, h) reach against a text colour: the tenth percentile."""
    image = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)[:, :, :3]
    x, y, w, h = box
    part = image[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)].reshape(-1, 3)
    if not len(part):
        return None
    back, front = luminance(part), float(luminance(np.array(colour)))
    ratio = (np.maximum(back, front) + 0.05) / (np.minimum(back, front) + 0.05)
    return round(float(np.percentile(ratio, 10)), 2)
