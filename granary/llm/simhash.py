"""SimHash near-dedup with bit-sliced comparison.

A document's fingerprint takes, bit by bit, the majority over the XXH64 values of its word shingles.
Fingerprints that differ in at most `radius` bits link; the groups are the connected components.

Candidates: with the 64 bits cut into m blocks, two fingerprints within the radius agree on at least
m - radius blocks, so every choice of that many blocks is a join key and no link is lost. m follows the
number of distinct fingerprints, so that a key's bucket stays small. A bucket above TILE rows is cut
into chunks, each pair of which is a bucket of its own.

Comparison: the fingerprints of a run of buckets are stored as 64 vertical bit planes. For each distance
d between rows the planes are XORed with themselves shifted by d rows, and carry-save counters add up
64 distances per machine word; a counter starts so that it overflows beyond the radius, and words of
which all lanes have overflowed are abandoned. A bucket yields a spanning forest of its links, never
its pairs.

Edge cases: a null text counts as empty; texts without words have fingerprint zero and link like any
other; texts shorter than a shingle are one shingle; exact copies share a fingerprint, which is compared
once; null ids get a fingerprint and the group's smallest id that is not null; rows that repeat are kept;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.bitmaps import parted
from granary.llm.text import words
from granary.operators.components import connected_components
from granary.session import bounded_batches, stored, table

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Rows of a bucket that are compared as one; larger buckets are cut into chunks.
TILE = 4096
#: Rows of whole buckets that are sliced together.
SLICE = 1 << 16
#: Expected rows of a bucket above which the fingerprints are cut into more blocks.
BUCKET = 2048
#: Lists of over-full buckets up to this many rows are broadcast.
BROADCAST_HOT = 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    if text is None:
        return 0
    found = words(text.translate(_LOWER)) if not text.isascii() else text.encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(found) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    set_bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(h), bitorder="little").view(np.uint64)[0])


_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (bigint, the 64 bits)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fps = np.fromiter((fingerprint(x, shingle) for x in rows["text"]), np.uint64, len(rows))
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, fp bigint")


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks to cut 64 bits into: the fewest for which a bucket is expected to hold at most BUCKET of n fingerprints."""
    m = radius + 1
    while m < radius + 4 and n / 2.0 ** (64 * (m - radius) / m) > BUCKET:
        m += 1
    return m


def _masks(m: int, radius: int) -> list[int]:
    cuts = [round(64 * i / m) for i in range(m + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = [sum(block[i] for i in chosen) for chosen in combinations(range(m), m - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in whole]


def close_rows(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of the same group (groups are contiguous) within the radius, by bit-sliced comparison."""
    n = len(fps)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    after = np.repeat(starts + sizes, sizes) - np.arange(n)  # rows of the group from this one on
    pad = -n % 64
    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(np.pad(bits.T, ((0, 0), (0, pad))), axis=1, bitorder="little")).view(np.uint64)
    planes = np.pad(planes, ((0, 0), (0, int(sizes.max()) // 64 + 2)))
    width = radius.bit_length()
    begin = (1 << width) - (radius + 1)
    full = ~np.uint64(0)
    rest = after
    lanes = np.arange(n)
    for d in range(1, int(sizes.max())):
        keep = rest > d
        lanes, rest = lanes[keep], rest[keep]
        valid = np.zeros(n + pad, bool)
        valid[lanes] = True
        word_valid = np.packbits(valid, bitorder="little").view(np.uint64)
        at = np.flatnonzero(word_valid)
        dead = ~word_valid[at]
        count = [np.full(len(at), full if begin >> b & 1 else 0, np.uint64) for b in range(width)]
        q, r = divmod(d, 64)
        up, down = np.uint64(r), np.uint64(64 - r)
        for p in range(64):
            plane = planes[p]
            x = plane[at] ^ ((plane[at + q] >> up) | (plane[at + q + 1] << down) if r else plane[at + q])
            for b in range(width):  # carry-save: what a counter bit carries goes to the next
                carry = count[b] & x
                count[b] ^= x
                x = carry
            dead |= x
            if p % 8 == 7 and p < 63:
                live = dead != full
                if not live.all():
                    at, dead, count = at[live], dead[live], [c[live] for c in count]
                    if not len(at):
                        break
        if len(at):
            near = np.unpackbits((~dead).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, lane = np.nonzero(near)
            if len(word):
                i = at[word] * 64 + lane
                yield i, i + d


class Forest:
    """Union-find over rows, fed with arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            x = self.parent[up]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def all_roots(self) -> np.ndarray:
        self.parent = self.roots(self.parent)
        return self.parent


def whole_groups(batches: Iterator[pd.DataFrame], key: str, rows: int) -> Iterator[pd.DataFrame]:
    """Sorted batches joined and cut again so that each piece holds whole groups, of about so many rows."""
    held: list[pd.DataFrame] = []
    n = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n >= rows:
            piece = pd.concat(held, ignore_index=True)
            k = piece[key].to_numpy()
            cut = int(np.searchsorted(k, k[-1], side="left"))  # the last group may go on
            if cut:
                yield piece.iloc[:cut]
            held, n = [piece.iloc[cut:]], len(piece) - cut
    if n:
        yield pd.concat(held, ignore_index=True)


def tiled(keyed: DataFrame, row: str, tile: int = TILE) -> DataFrame:
    """keyed (key, row column, more) with `chunk`; keys of over `tile` rows give way to a key for each pair of chunks.

    Every two rows of a key meet in at least one of the new keys; those of different chunks in exactly one."""
    hot = stored(keyed.groupBy("key").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > tile), "hot-keys")
    n_hot = hot.count()
    plain = F.lit(0).alias("chunk"), F.lit(False).alias("cross")
    if not n_hot:
        return keyed.select("*", *plain)
    right = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot
    rows = keyed.join(right, "key", "left")
    chunks = F.ceil(F.col("_rows") / tile)
    cold = rows.filter("_rows IS NULL").drop("_rows").select("*", *plain)
    cut = rows.filter("_rows IS NOT NULL").withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), row), chunks).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    key = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    cut = cut.withColumn("cross", F.col("chunk") != F.col("other")).withColumn("key", key).drop("_rows", "other")
    return cold.unionByName(cut)


def links(fps: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """src, dst: a spanning forest, bucket by bucket, of the links between n distinct fingerprints (column fp)."""
    masks = _masks(blocks_for(n, radius), radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(x).cast("bigint"))) for i, x in enumerate(masks)])
    keyed = fps.select("fp", F.explode(keys).alias("key"))
    ready = tiled(keyed, "fp", tile).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")

    def compare(batches):
        for piece in whole_groups(batches, "key", SLICE):
            fp, key = piece["fp"].to_numpy(np.int64), piece["key"].to_numpy(np.int64)
            forest = Forest(len(fp))
            for i, j in close_rows(fp.view(np.uint64), key, radius):
                forest.link(i, j)
            root = forest.all_roots()
            linked = np.flatnonzero(root != np.arange(len(root)))
            yield pd.DataFrame({"src": fp[linked], "dst": fp[root[linked]]})

    return ready.mapInPandas(compare, "src bigint, dst bigint")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: the smallest id of the document's group."""
    of_doc = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = stored(of_doc.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = connected_components(links(distinct.select("fp"), distinct.count(), radius))
    grouped = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", "component")
    smallest = grouped.filter("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("smallest"))
    named = grouped.join(smallest, "component", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))
    return of_doc.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents, all columns whatever their names, of which one of each group stays: that with the group's smallest id.

    Documents without an id stay unless their group has one; of rows that repeat an id one stays. Only the documents
    whose id is listed, as one that goes or that repeats, meet the list in a shuffle."""
    grouped = stored(near_duplicates(docs, id_col, text_col, shingle, radius), "simhash-groups")
    per = grouped.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") != F.col("component_id")).alias("goes"))
    listed = stored(per.filter("goes OR n > 1").select(F.col("doc_id").alias("listed_id"), "goes"), "simhash-listed")
    held = F.col("row").getField
    rows = docs.select(F.struct("*").alias("row")).select("row", held(id_col).cast("bigint").alias("own_id"))
    bare, named = rows.filter("own_id IS NULL"), rows.filter("own_id IS NOT NULL")
    place = lambda c: F.xxhash64(F.lit(3), c)
    some, rest = parted(named, place(F.col("own_id")), listed.select(place(F.col("listed_id")).alias("key")))
    met = some.join(listed, F.col("own_id") == F.col("listed_id"), "left").filter("goes IS NULL OR NOT goes")
    out = met.filter("listed_id IS NULL").select("row").unionByName(met.filter("listed_id IS NOT NULL").dropDuplicates(["own_id"]).select("row"))
    if rest is not None:
        out = out.unionByName(rest.select("row"))
    if not grouped.filter("doc_id IS NULL").isEmpty():
        # without an id: a copy of a named document goes; of the rest one of each fingerprint stays
        @F.pandas_udf("string")
        def own_fingerprint(texts: pd.Series) -> pd.Series:
            return pd.Series([f"{fingerprint(x, shingle):016x}" for x in texts], dtype=object)

        taken = grouped.filter("component_id IS NOT NULL").select("fingerprint").distinct()
        bare = bare.withColumn("fingerprint", own_fingerprint(held(text_col))).join(taken, "fingerprint", "left_anti").dropDuplicates(["fingerprint"])
        out = out.unionByName(bare.select("row"))
    return out.select("row.*")


def op2_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
