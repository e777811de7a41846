"""A filter of hashes for all tasks: bits of a size by their number, or none beyond the greatest size."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and at most; beyond, a join alone has to select.
FILTER_BITS_EACH, FILTER_BITS = 16, 1 << 28
BUCKET_BITS = 1 << 15


def filter_of(repeated: DataFrame, column: str) -> bytes | None:
    """Bits for the hashes in ``column``: those that are set are among them, perhaps. None
    if there are too many for a filter of the greatest size."""
    bits = max(BUCKET_BITS, 1 << math.ceil(math.log2(max(1, FILTER_BITS_EACH * repeated.count()))))
    if bits > FILTER_BITS:
        return None
    buckets = bits // BUCKET_BITS
    bucket = F.pmod(column, F.lit(buckets))
    place = F.shiftrightunsigned(column, 40).bitwiseAND(F.lit(BUCKET_BITS - 1))
    out = np.zeros((buckets, BUCKET_BITS // 8), np.uint8)
    for number, raw in repeated.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place)).collect():
        out[number] = np.frombuffer(raw, np.uint8)
    return out.tobytes()


def passes(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), bool)
    bucket = hashes & np.uint64(len(bits) * 8 // BUCKET_BITS - 1)
    place = (hashes >> np.uint64(40)) & np.uint64(BUCKET_BITS - 1)
    return (bits[bucket * np.uint64(BUCKET_BITS // 8) + (place >> np.uint64(3))] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
