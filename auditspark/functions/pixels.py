"""Measures of decoded images, in batches of rows: as Spark's image source gives them, pixels are rows of BGR or BGRA bytes, or of one
gray byte."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

SIDE = 8
# The shares of red, green and blue in a gray value, in 65,536ths.
RED, GREEN, BLUE = 19595, 38470, 7471
LOBES = 3


def gray(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    """Gray values from 0 to 255, a row for each line; an alpha channel is left out."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.int64)
    if channels == 1:
        return pixels[:, :, 0]
    return (pixels[:, :, 2] * RED + pixels[:, :, 1] * GREEN + pixels[:, :, 0] * BLUE + 32768) >> 16


@lru_cache(maxsize=256)
def lanczos(n: int, to: int) -> np.ndarray:
    """Weights that make `to` values of n: a windowed sinc, as wide as what one value stands for."""
    step = n / to
    wide = max(step, 1.0)
    x = (np.arange(n)[None, :] + 0.5 - (np.arange(to)[:, None] + 0.5) * step) / wide
    w = np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def shrunk(values: np.ndarray, side: int = SIDE) -> np.ndarray:
    """side x side gray values: the lines first, then the columns, whole numbers after each."""
    whole = lambda m: np.clip(np.floor(m + 0.5), 0, 255)
    return whole(lanczos(values.shape[0], side) @ whole(values @ lanczos(values.shape[1], side).T))


def mean_hash(values: np.ndarray) -> int:
    """64 bits, the first pixel in the highest: 1 where the shrunk image is above its mean."""
    small = shrunk(values)
    return int(np.packbits((small > small.sum() / small.size).ravel()).view(">i8")[0])


@F.pandas_udf(StructType([StructField("variance", DoubleType()), StructField("hash", LongType())]))
def _measure(width: pd.Series, height: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    out = []
    for w, h, c, d in zip(width, height, channels, data):
        if d is None or not w or not h or w < 1 or h < 1 or len(d) != int(w) * int(h) * int(c):
            out.append((None, None))
            continue
        values = gray(int(w), int(h), int(c), d)
        n, total, squares = values.size, int(values.sum()), int((values * values).sum())
        out.append(((squares - total * total / n) / n, mean_hash(values)))
    variance, hashes = zip(*out) if out else ((), ())
    return pd.DataFrame({"variance": pd.Series(variance, dtype="float64"), "hash": pd.array(hashes, dtype="Int64")})


def measured(image: Column) -> Column:
    """variance of the gray values, and their hash, of an image struct; nulls for one that could not be decoded."""
    return _measure(image["width"], image["height"], image["nChannels"], image["data"])


def bitmap(values: np.ndarray) -> bytes:
    """A gray image as a bitmap file of 24 bits a pixel: its lines from the bottom up, each filled to a multiple of four bytes."""
    height, width = values.shape
    line = (3 * width + 3) // 4 * 4
    lines = np.zeros((height, line), dtype=np.uint8)
    lines[:, : 3 * width] = np.repeat(values[::-1].astype(np.uint8), 3, axis=1)
    head = b"BM" + struct.pack("<IHHI", 54 + line * height, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, line * height, 2835, 2835, 0, 0)
    return head + lines.tobytes()


@F.pandas_udf(BinaryType())
def tiled_bitmap(pixels: pd.Series, across: pd.Series, down: pd.Series) -> pd.Series:
    """Bitmaps of 8 x 8 gray values, each a tile of `across` by `down` pixels."""
    return pd.Series([bitmap(np.kron(np.asarray(p).reshape(SIDE, SIDE), np.ones((d, a), dtype=np.int64))) for p, a, d in zip(pixels, across, down)], dtype=object)
