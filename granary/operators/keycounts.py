"""Counts of 64-bit keys over all rows, without a row for each key.

Rows come as chunks, each with very many distinct keys. A chunk sends its sorted keys with their counts to buckets by
their high bits; a bucket adds the counts up and answers every chunk with the totals of the keys it sent, in their order.
A chunk sends a key once, so a frequent key costs its bucket one entry a chunk, and the number of buckets grows with
the entries. Keys travel as differences in byte planes, so the shuffle's compression finds their zero bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from granary.session import stored

BUCKET_ENTRIES = 500_000


def planes(a: np.ndarray) -> bytes:
    """The bytes of all entries by their place in the entry: equal high bytes stand together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def entries(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, len(data) // size).T).view(kind).ravel()


def squeezed(a: np.ndarray) -> bytes:
    """The planes of small numbers, coded by how frequent their bytes are."""
    return zstandard.ZstdCompressor(level=1).compress(planes(a))


def loosened(data: bytes, kind) -> np.ndarray:
    return entries(zstandard.ZstdDecompressor().decompress(data), kind)


def packed(sorted_keys: np.ndarray) -> bytes:
    return planes(np.diff(sorted_keys, prepend=np.zeros(1, np.uint64)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(entries(data, np.uint64), dtype=np.uint64)


def totals(chunks: DataFrame, of: Callable, n_entries: int, tally: Callable | None = None, label: str = "key-totals") -> DataFrame:
    """chunk, bucket, totals, tally.

    chunks: a column chunk (bigint) that tells its rows apart, and what of() reads from a row: sorted distinct uint64 keys
    and their counts. n_entries: about how many keys all chunks send. tally() gives a number for a bucket's distinct keys
    and their totals; the column adds up to that of all keys."""
    bits = max(1, int(n_entries // BUCKET_ENTRIES).bit_length())

    def send(batches):
        for rows in batches:
            for _, row in rows.iterrows():
                keys, counts = of(row)
                cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                both = enumerate(zip(np.split(keys, cuts), np.split(counts.astype(np.uint32), cuts), strict=True))
                yield pd.DataFrame([(b, row["chunk"], packed(k), squeezed(n)) for b, (k, n) in both if len(k)], columns=["bucket", "chunk", "keys", "counts"])

    def add(rows):
        keys = [unpacked(x) for x in rows["keys"]]
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, np.concatenate([loosened(x, np.uint32) for x in rows["counts"]]), len(distinct)).astype(np.int64)
        answers = np.split(total[number], np.cumsum([len(k) for k in keys])[:-1])
        out = pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "totals": [squeezed(x) for x in answers], "tally": 0})
        out.loc[out.index[0], "tally"] = int(tally(distinct, total)) if tally else 0
        return out

    sent = chunks.mapInPandas(send, "bucket int, chunk bigint, keys binary, counts binary")
    return stored(sent.groupBy("bucket").applyInPandas(add, "chunk bigint, bucket int, totals binary, tally bigint"), label)


def answered(buckets: list[int], answers: list[bytes]) -> np.ndarray:
    """The totals of a chunk's sorted keys from what its buckets said."""
    said = dict(zip(buckets, answers, strict=True))
    return np.concatenate([np.zeros(0, np.int64), *[loosened(said[b], np.int64) for b in sorted(said)]])
