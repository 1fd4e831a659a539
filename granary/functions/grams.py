"""Shingle hashes and MinHash slots, Arrow batch by batch with NumPy."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.values import MINHASH_PRIME

_TOKEN = re.compile("[a-z0-9]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number spread over all bits, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Tokens(dict):
    """64-bit hash of each token; forgets all beyond `most`."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[token] = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
        return h


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n tokens; of all, where there are fewer."""
    k = min(n, len(h))
    out = h[: len(h) - k + 1]
    for i in range(1, k):
        out = out * _BASE + h[i : len(h) - k + 1 + i]
    return mixed_bits(out + np.uint64(k))


def gram_hashes(text: Column, n: int = 3) -> Column:
    """Sorted distinct 64-bit hashes of the shingles of n [a-z0-9]+ tokens in lower case; null and empty texts have none."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = Tokens()
        for texts in batches:
            out = []
            for text in texts:
                found = _TOKEN.findall((text or "").lower())
                h = np.fromiter([seen[t] for t in found], np.uint64, len(found))
                out.append(np.unique(_runs(h, n).view(np.int64)) if found else np.zeros(0, np.int64))
            yield pd.Series(out, dtype=object)

    return run(text)


_INSIDE = np.ones(256, bool)
_INSIDE[list(b" \t\n\r\v\f")] = False


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space: sums of the mixed bytes and their places."""
    return _words(np.frombuffer(data, np.uint8))[0]


def _words(text: np.ndarray, ends: np.ndarray | None = None, letters: np.ndarray = _INSIDE) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of the bytes, and where each word begins; no word goes on behind one of the ends (sorted places)."""
    inside = letters[text]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    if ends is not None:
        cut = ends[ends < len(text)]
        first[cut] = inside[cut]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), at
    word = np.cumsum(first)[inside] - 1
    held = np.flatnonzero(inside)
    values = mixed_bits((((held - at[word]) << 8) + text[inside] + 1).view(np.uint64))
    return mixed_bits(np.add.reduceat(values, np.flatnonzero(first[inside]))), at


def _space_grams(texts: pa.Array, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat, ends) of the sorted distinct hashes of each text's owner and windows; the rows of a batch at once."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    runs, row, k = _run_rows(data, offsets - offsets[0], n, _INSIDE)
    none = np.flatnonzero(k == 0)
    runs, row = np.concatenate([runs, np.zeros(len(none), np.uint64)]), np.concatenate([row, none])
    return _distinct_by_row(mixed_bits(runs ^ owners[row]).view(np.int64), row, len(texts))


def _run_rows(data: np.ndarray, ends: np.ndarray, n: int, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of each row's runs of n words and their rows, and how many words each row has."""
    h, at = _words(data, ends, letters)
    row = np.searchsorted(ends, at, side="right") - 1
    k = np.bincount(row, minlength=len(ends) - 1)
    last = np.repeat(np.cumsum(k), k)  # the end of each word's row
    runs, length, i = h.copy(), np.minimum(n, np.repeat(k, k)), np.arange(len(h))
    for j in range(1, n):
        more = np.flatnonzero((length > j) & (i + j < last))
        runs[more] = runs[more] * _BASE + h[more + j]
    whole = i + length <= last
    return mixed_bits(runs[whole] + length[whole].astype(np.uint64)), row[whole], k


def _distinct_by_row(grams: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(row, kind="stable")
    grams, row = grams[by], row[by]
    ends = np.cumsum(np.bincount(row, minlength=n_rows)).tolist()
    for low, high in zip([0, *ends], ends, strict=False):
        grams[low:high].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=n_rows))])


def _gram_columns(flat: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """The arrays, and a key of each that is equal for equal ones."""
    held = flat.tobytes()
    keys = [hashlib.blake2b(held[8 * a : 8 * b], digest_size=32).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)), pa.array(keys, pa.binary())]


_TOKEN_BYTES = np.zeros(256, bool)
_TOKEN_BYTES[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def with_token_grams(rows: DataFrame, text: str = "text", n: int = 3) -> DataFrame:
    """rows with, in the place of their text, grams: sorted distinct 64-bit hashes of the shingles that gram_hashes takes,
    and key: equal for equal grams."""
    others = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").lower().encode() for t in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, texts)])
            runs, row, _ = _run_rows(np.frombuffer(b"".join(texts), np.uint8), ends, n, _TOKEN_BYTES)
            new = _gram_columns(*_distinct_by_row(runs.view(np.int64), row, len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + new, names=[*others, "grams", "key"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in others]
    return rows.mapInArrow(run, ", ".join([*kinds, "grams array<bigint>", "key binary"]))


def with_space_grams(rows: DataFrame, text: str = "text", owner: str = "owner", n: int = 3) -> DataFrame:
    """rows with, in the place of their text, grams: sorted distinct 64-bit hashes of owner and the windows that
    arrays.shingles_by_space has, and key: equal for equal grams. A null text has the one empty window."""
    rows = rows.withColumns({text: F.encode(F.lower(F.coalesce(text, F.lit(""))), "UTF-8"), owner: F.col(owner).cast("string")})
    others = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = Tokens()
        for batch in batches:
            own = np.array([owners["" if of is None else f"of {of}"] for of in batch.column(owner).to_pylist()], np.uint64)
            new = _gram_columns(*_space_grams(batch.column(text).cast(pa.binary()), own, n))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + new, names=[*others, "grams", "key"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in others]
    return rows.mapInArrow(run, ", ".join([*kinds, "grams array<bigint>", "key binary"]))


def slots_of(shingles: set[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each permutation (a, b) the least (a * crc32 + b) mod prime over the shingles; the prime where there are none."""
    least = np.full(len(a), MINHASH_PRIME, np.uint64)
    x = np.fromiter((zlib.crc32(s.encode()) for s in shingles), np.uint64, len(shingles))
    for i in range(0, len(x), 4096):
        least = np.minimum(least, ((a[:, None] * x[None, i : i + 4096] + b[:, None]) % np.uint64(MINHASH_PRIME)).min(axis=1))
    return least


def minhash_slots(text: Column, a: Sequence[int], b: Sequence[int], n: int = 3) -> Column:
    """The MinHash signature of a text's shingles of n tokens, as hashing.minhash has it of shingles."""
    first, second = np.array(a, np.uint64), np.array(b, np.uint64)

    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            k = _TOKEN.findall((text or "").lower())
            runs = {" ".join(k[i : i + n]) for i in range(max(1, len(k) - n + 1))} if k else set()
            out.append(slots_of(runs, first, second).astype(np.int64))
        return pd.Series(out, dtype=object)

    return run(text)
