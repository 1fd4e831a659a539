"""Hashes and deterministic draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.values import MINHASH_PRIME


def text_key(*parts: Column) -> Column:
    """SHA-256 of the parts with a unit separator between."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def stable_seed(*parts: Column) -> Column:
    """Unsigned 64-bit number of the parts, as decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def order_key(*parts: Column) -> Column:
    """Hex string that orders rows at random, the same way every time."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def draw(*parts: Column) -> Column:
    """A number in [0, 1) that the parts determine."""
    return F.conv(F.substring(order_key(*parts), 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def minhash(shingles: Column, a: list[int], b: list[int]) -> Column:
    """Slots of min over shingles of (a * crc32 + b) mod prime; an empty set has the prime in every slot."""
    base = F.transform(shingles, lambda s: F.crc32(s.cast("binary")))
    pairs = F.array(*[F.struct(F.lit(x).cast("bigint").alias("a"), F.lit(y).cast("bigint").alias("b")) for x, y in zip(a, b, strict=True)])
    slots = lambda x: F.transform(pairs, lambda p: F.coalesce(F.array_min(F.transform(x, lambda v: (p["a"] * v + p["b"]) % MINHASH_PRIME)), F.lit(MINHASH_PRIME)))
    return F.element_at(F.transform(F.array(base), slots), 1)


def permutations(n: int, seed: int = 1) -> tuple[list[int], list[int]]:
    import numpy as np

    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**31 - 1, size=n, dtype=np.uint64).tolist(), rng.integers(0, 2**31 - 1, size=n, dtype=np.uint64).tolist()
