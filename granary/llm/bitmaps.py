"""Broadcast bit maps and lists of 64-bit keys, bounded by the keys' number."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a map for each key, and the power of two that bounds a map's bits.
KEY_BITS, MAP_BITS = 16, 28
#: Keys up to which a list of them is broadcast for a join (about 25 MB).
BROADCAST_KEYS = 500_000


def map_bits(n: int, most: int = MAP_BITS) -> int | None:
    """The power of two of a map's bits for n keys; None if that is more than `most`."""
    bits = max(16, (KEY_BITS * max(n, 1) - 1).bit_length())
    return bits if bits <= most else None


def key_filter(keys: DataFrame, bits: int) -> bytes:
    """Bit map of the keys' leading bits, built by the executors in blocks of 4 KB; 2^bits bits in all."""
    at = F.shiftrightunsigned("key", 64 - bits) + 1
    rows = keys.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
    rows = rows.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows.toLocalIterator():
        out[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def mapped(held: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """Whether the map has each key's bit."""
    bits, at_bits = np.frombuffer(held, np.uint8), (8 * len(held)).bit_length() - 1

    def has(keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - at_bits)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    return has


def parted(rows: DataFrame, place: Column, keys: DataFrame, most: int = BROADCAST_KEYS) -> tuple[DataFrame, DataFrame | None]:
    """rows whose place is one of the keys (column key), and the rest, which needs no shuffle to meet them.

    The rest is None where there are more than `most` keys; then the first has all rows. Two rows of one place go together."""
    listed = keys.select(F.col("key").alias("_key")).distinct()
    if listed.count() > most:
        return rows, None
    rows, on = rows.withColumn("_place", place), F.col("_place") == F.col("_key")
    return tuple(rows.join(F.broadcast(listed), on, how).drop("_place") for how in ("left_semi", "left_anti"))
