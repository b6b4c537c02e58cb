"""Marked hashes: a bitmap of fixed size that says which rows of a large table can meet a key of another one."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A bitmap has 2 ** BITS places (16 MB), whatever the number of keys.
BITS = 27
#: Odd constants: the base of the hashes of texts, and the factor of their last mixing (fixed values, the golden ratio and pi).
BASE, MIX = 0x9E3779B97F4A7C15, 0x3243F6A8885A308D


def rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` numbers, put together from runs of half the length."""
    if k == 1:
        return codes.astype(np.uint64)
    half, n = k // 2, len(codes) - k + 1
    h = rolled(codes, half)
    twice = h[: len(codes) - 2 * half + 1] * np.uint64(pow(BASE, half, 2**64)) + h[half:]
    return twice[:n] * np.uint64(BASE) + codes[k - 1 :] if k % 2 else twice


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose upper bits depend on all bits."""
    return (h ^ (h >> np.uint64(32))) * np.uint64(MIX)


def places(h: np.ndarray) -> np.ndarray:
    """The places of mixed hashes in a bitmap."""
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the hashes have their place marked: true for every hash that was marked, and for a few others."""
    at = places(h)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap_of(df: DataFrame) -> np.ndarray:
    """The bitmap of the column ``place``. Runs a job, whose result is at most 4,096 rows of 4 KB."""
    size = 32768  # fixed by Spark: places of one bitmap_construct_agg
    parts = df.groupBy(F.shiftright("place", 15).alias("part")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(size))).alias("bits"))
    out = np.zeros((2**BITS // size, size // 8), np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)
