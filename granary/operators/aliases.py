"""Which texts hold which aliases: one path for alias tables of any size.

Words have 64-bit hashes, and running sums of these, each weighted by a power of its place, give the hash of any run of
words in two steps. An alias is known by two such hashes of all its words (128 bits) and waits under the hash of its first
KEY_WORDS words. Two bit maps go to the texts, sized by the number of aliases and of MAP_BITS bits at most: where a text's
run meets the first, the runs that are as long as some alias are looked up in the second, and what that lets through
meets the aliases in an equi-join on 128 bits. Larger alias tables only let more runs through. No text is shuffled, no
task holds the aliases, and texts go through NumPy batch by batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.functions.grams import Tokens, mixed_bits
from granary.session import bounded_batches, stored

#: Words of an alias that open its look-up.
KEY_WORDS = 3
#: Bits of a map for each alias, and the least and the most a map has (as powers of 2; the most is 32 MB).
ALIAS_BITS, LEAST_BITS, MAP_BITS = 16, 15, 28
_PAGE = 4096 * 8
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_SALTS = (np.uint64(0), np.uint64(0xC2B2AE3D27D4EB4F))


class _Powers:
    """Powers of the base and of its inverse, as far as they were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = np.full(n, _BASE, np.uint64), np.full(n, _BACK, np.uint64)
            for powers in (self.up, self.down):
                powers[0] = 1
                np.multiply.accumulate(powers, out=powers)
        return self.up[:n], self.down[:n]


class _Runs:
    """Hashes of runs of words in texts that lie end to end."""

    def __init__(self, texts: list[str | None], seen: Tokens, powers: _Powers):
        lists = [t.split(" ") if t else [] for t in texts]
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        h = np.fromiter((seen[w] for words in lists for w in words), np.uint64, int(self.counts.sum()))
        self.n, self.ends = len(h), np.repeat(np.cumsum(self.counts), self.counts)
        self.up, down = powers.to(max(1, self.n))
        none = np.zeros(1, np.uint64)
        self.sums = [np.concatenate((none, np.cumsum(mixed_bits(h ^ salt) * down[: self.n], dtype=np.uint64))) for salt in _SALTS]

    def hashes(self, which: int, at: np.ndarray, length) -> np.ndarray:
        """The hash of the `length` words from each place of at on."""
        s = self.sums[which]
        return mixed_bits((s[at + length] - s[at]) * self.up[at] + np.asarray(length).astype(np.uint64))


def _known(aliases: DataFrame) -> DataFrame:
    """alias_id, n (words), run (hash of the first words), a, b (hashes of all)."""
    kind = aliases.schema["alias_id"].dataType
    schema = pa.schema([("alias_id", to_arrow_type(kind)), ("n", pa.int32()), ("run", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        seen, powers = Tokens(), _Powers()
        for batch in batches:
            r = _Runs(batch.column("norm").to_pylist(), seen, powers)
            begins = np.cumsum(r.counts) - r.counts
            hashes = [r.hashes(0, begins, np.minimum(r.counts, KEY_WORDS)), r.hashes(0, begins, r.counts), r.hashes(1, begins, r.counts)]
            yield pa.RecordBatch.from_arrays([batch.column("alias_id").cast(schema[0].type), pa.array(r.counts.astype(np.int32)), *[pa.array(h.view(np.int64)) for h in hashes]], schema=schema)

    return aliases.select("alias_id", "norm").mapInArrow(run, f"alias_id {kind.simpleString()}, n int, run bigint, a bigint, b bigint")


def bit_map(keys: DataFrame, column: str, bits: int) -> bytes:
    """A map of 2^bits bits, those of the keys' highest bits set: built page by page, 2^bits / 8 bytes in all."""
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    pages = keys.select(slot.alias("slot")).selectExpr(f"slot DIV {_PAGE} AS page", f"slot % {_PAGE} AS at").groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(max(_PAGE, 1 << bits) // 8, np.uint8)
    for r in pages.toLocalIterator():
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out[: (1 << bits) // 8].tobytes()


def in_map(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - (len(held) * 8 - 1).bit_length())
    return (held[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def matches(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """text_id, alias_id of each text (text_id, norm) that holds the words of an alias (alias_id, norm) in a row.

    Both are normalised: words joined by one space. Empty and null aliases match nothing, null texts hold nothing."""
    spark = texts.sparkSession
    bounded_batches(spark)
    known = stored(_known(aliases.filter("norm <> ''")), "aliases")
    n = known.count()
    bits = min(MAP_BITS, max(LEAST_BITS, (ALIAS_BITS * n).bit_length()))
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())
    maps = spark.sparkContext.broadcast((bit_map(known, "run", bits), bit_map(known, "a", bits)))
    kind = texts.schema["text_id"].dataType
    schema = pa.schema([("text_id", to_arrow_type(kind)), ("a", pa.int64()), ("b", pa.int64())])

    def scan(batches):
        seen, powers = Tokens(), _Powers()
        runs, whole = (np.frombuffer(x, np.uint8) for x in maps.value)
        for batch in batches:
            r = _Runs(batch.column("norm").to_pylist(), seen, powers)
            text, place, found = np.repeat(np.arange(len(r.counts)), r.counts), np.arange(r.n), []
            for key in sorted({min(x, KEY_WORDS) for x in lengths}):
                at = place[place + key <= r.ends]
                at = at[in_map(runs, r.hashes(0, at, key))]
                for length in lengths:
                    if min(length, KEY_WORDS) == key:
                        fit = at[at + length <= r.ends[at]]
                        a = r.hashes(0, fit, length)
                        held = in_map(whole, a)
                        found.append((text[fit[held]], a[held], r.hashes(1, fit[held], length)))
            if found:
                t, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                by = np.lexsort((b, a, t))
                t, a, b = t[by], a[by], b[by]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                ids = batch.column("text_id").cast(schema[0].type).take(pa.array(t[new]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64))], schema=schema)

    hits = texts.select("text_id", "norm").filter("norm <> ''").mapInArrow(scan, f"text_id {kind.simpleString()}, a bigint, b bigint")
    return hits.join(known.select("alias_id", "a", "b"), ["a", "b"]).select("text_id", "alias_id")
