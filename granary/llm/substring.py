"""Substring dedup over a log-structured index of window fingerprints.

A window is `width` consecutive words of one document; its fingerprint is the smallest hash among its
GRAM-word grams (winnowing), so equal windows have equal fingerprints, and a text has about
2 / (width - GRAM + 2) fingerprints a word.

Index: each batch of documents becomes one sorted, immutable, bucketed run (key, n: gram places of that
key). A new batch's run is merge-joined with the historical runs bucket by bucket; the keys seen before,
or twice in the batch, are the candidates. Runs are compacted when FAN_IN of them have gathered; a run's
name states the batches it covers, so a compaction that is cut short is never counted twice. BATCHES are more than
FAN_IN, so each call compacts.

Verification: documents with candidate keys emit, per run of windows with one fingerprint, 128-bit digests of the whole
windows, each two 64-bit polynomials over independent mixes of their words' hashes. Equal rows of one piece of a batch are merged before the shuffle. The rows meet by key,
sorted, and stream through with the distinct windows of one key as the only state; a window whose digest
comes twice is repeated. Different windows meet only if they share a key, and would have to agree in 128 bits more.

Candidate keys reach the documents as a broadcast bit map of KEY_BITS bits a key and 2^MAP_BITS bits (32 MB) at most; its
false hits only cost rows. Where the keys need a larger one, the documents' own keys are semi-joined with
them instead, and each document gets those that are left.

Hot keys: a second map, or mark, tells keys with HOT_PLACES places or more. Their windows go one
by one, by key and digest, so that different windows with a common gram part, and a batch sends each of them
once; what one task gets of a window grows with the batches, not with its copies.

History: a call on a named index leaves the digests of its windows by key beside the runs, in a folder of its batch's
name, which counts once it is whole; a later call reads those of its candidate keys and verifies its windows against them
too. A call leaves out the folder of its own batch, so it can be made again. Runs that a failed call left only add
candidates, which the digests then refuse.

Every word that a repeated window covers is removed. Windows are judged on the input. Only documents that may lose
words meet their windows in a shuffle; a broadcast list of them, of up to BROADCAST_KEYS, lets the rest stay where it is.

Edge cases: a null text has no words; texts shorter than a window are kept; null and repeated ids are
told apart by their texts (rows that repeat whole are copies of each other and lose their windows); an
empty table gives an empty result. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.bitmaps import BROADCAST_KEYS, MAP_BITS, key_filter, map_bits, mapped, parted
from granary.llm.text import WordHashes, words
from granary.session import bounded_batches, removed, scratch, stored, table

WIDTH = 35
GRAM = 8
#: Words whose hashes a task remembers.
SEEN_WORDS = 100_000
FAN_IN = 3
HOT_PLACES = 1024
BATCHES = 4
#: Words that are hashed together, and characters of the texts whose windows are merged together: what bounds a task's memory.
CHUNK_WORDS, PIECE_CHARS = 1 << 18, 4 << 20
#: Windows of one row; their places are bits of a mask.
ROW_WINDOWS = 32

#: A window's digest as numpy holds it, compared byte by byte.
DIGEST = np.dtype("V16")

_P = 0x9E3779B97F4A7C15
#: What the words' hashes are combined with, and the base of the polynomial, for either half of a digest.
_DIGESTS = ((np.uint64(0xC2B2AE3D27D4EB4F), 0xC2B2AE3D27D4EB4F), (np.uint64(0x165667B19E3779F9), 0x27D4EB2F165667C5))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def grams(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each k consecutive entries; a polynomial built from doubled lengths."""
    out, held, level, length = None, 0, h, 1
    while True:
        if k & length:
            if out is None:
                out = level
            else:
                n = len(h) - held - length + 1
                out = out[:n] * np.uint64(pow(base, length, 1 << 64)) + level[held : held + n]
            held += length
        if held == k:
            return mix(out)
        level = level[:-length] * np.uint64(pow(base, length, 1 << 64)) + level[length:]
        length *= 2


def sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    s = 1
    while 2 * s <= w:
        a = op(a[:-s], a[s:])
        s *= 2
    return op(a[: len(a) - (w - s)], a[w - s :]) if s < w else a


class _Chunk:
    """Word hashes of some documents end to end, and the windows that lie within one."""

    def __init__(self, docs: list[int], counts: list[int], hashes: list, width: int, gram: int):
        self.docs, self.width = np.array(docs), width
        self.h = np.array(hashes, np.uint64)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - np.array(counts)
        self.gram_hash = grams(self.h, gram, _P)
        self.least = sliding(self.gram_hash, width - gram + 1, np.minimum)
        place = np.arange(len(self.least))
        self.doc = np.searchsorted(self.ends, place, side="right")
        self.valid = place + width <= self.ends[self.doc]

    def keys(self, gram: int) -> np.ndarray:
        """The key of each gram place that is the smallest of some window."""
        w = self.width - gram + 1
        low = np.where(self.valid, self.least, np.uint64(0))
        most = sliding(np.pad(low, w - 1), w, np.maximum)
        return self.gram_hash[self.gram_hash == most]


    def digests(self, take: np.ndarray) -> np.ndarray:
        """The 16-byte digests of the windows that begin at the places of take: two hashes of all their words."""
        both = [grams(mix(self.h ^ salt), self.width, base)[take] for salt, base in _DIGESTS]
        return np.ascontiguousarray(np.stack(both, axis=1)).view(DIGEST).ravel()


def _chunks(texts, seen: WordHashes, width: int, gram: int) -> Iterator[_Chunk]:
    docs, counts, hashes = [], [], []
    for i, text in enumerate(texts):
        found = words(text)
        if len(found) < width:
            continue
        docs.append(i)
        counts.append(len(found))
        hashes += [seen[w] for w in found]
        if len(hashes) >= CHUNK_WORDS:
            yield _Chunk(docs, counts, hashes, width, gram)
            docs, counts, hashes = [], [], []
    if docs:
        yield _Chunk(docs, counts, hashes, width, gram)


def window_keys(docs: DataFrame, text_col="text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """key, n: how many gram places have it, over all documents."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        seen = WordHashes(SEEN_WORDS)
        for rows in batches:
            for chunk in _chunks(rows["text"], seen, width, gram):
                key, n = np.unique(chunk.keys(gram), return_counts=True)
                yield pd.DataFrame({"key": key.view(np.int64), "n": n})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "key bigint, n bigint")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def window_digests(docs: DataFrame, text_col="text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """key, digest: the distinct windows of all documents."""

    def run(batches):
        seen = WordHashes(SEEN_WORDS)
        for rows in batches:
            for c in _chunks(rows["text"], seen, width, gram):
                digest = c.digests(np.flatnonzero(c.valid)).tobytes()
                both = pd.DataFrame({"key": c.least[c.valid].view(np.int64), "digest": [digest[16 * i : 16 * i + 16] for i in range(len(digest) // 16)]})
                yield both.drop_duplicates()

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "key bigint, digest binary")
    return rows.distinct()


def _folders(spark: SparkSession, root: str, pattern: str) -> list[tuple]:
    """(path, match) of the folders below root that are whole and whose names match."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(x.getPath(), re.fullmatch(pattern, x.getPath().getName())) for x in (fs.listStatus(path) if fs.exists(path) else [])]
    return [(p, m) for p, m in found if m and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def _windows(batch: str) -> str:
    return f"windows-{hashlib.sha256(batch.encode()).hexdigest()[:32]}"


def held_windows(spark: SparkSession, root: str, batch: str) -> DataFrame | None:
    """key, digest that calls of other batches left below root; None if there are none."""
    found = [p.toString() for p, _ in _folders(spark, root, r"windows-[0-9a-f]+") if p.getName() != _windows(batch)]
    return spark.read.schema("key bigint, digest binary").parquet(*found) if found else None


class FingerprintIndex:
    """Runs below a folder, each a bucketed Parquet table sorted by key."""

    def __init__(self, spark: SparkSession, root: str, buckets: int, fan_in: int = FAN_IN):
        self.spark, self.root, self.buckets, self.fan_in = spark, root, buckets, fan_in
        self.tables: dict[tuple[int, int], str] = {}
        found = [tuple(map(int, m.groups())) for _, m in _folders(spark, root, r"run-(\d+)-(\d+)-(\d+)")]
        for a, b, n in found:
            if not any(c <= a and b <= d and (c, d) != (a, b) for c, d, _ in found):
                self.buckets = n
                self._register(a, b)

    def _uri(self, a: int, b: int) -> str:
        return f"{self.root}/run-{a}-{b}-{self.buckets}"

    def _register(self, a: int, b: int) -> None:
        name = f"granary_run_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (key BIGINT, n BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self._uri(a, b)}'"
        )
        self.tables[a, b] = name

    def _write(self, rows: DataFrame, a: int, b: int) -> None:
        name = f"granary_run_{uuid.uuid4().hex}"
        ready = rows.repartition(self.buckets, "key").write.format("parquet").bucketBy(self.buckets, "key").sortBy("key")
        ready.option("path", self._uri(a, b)).saveAsTable(name)
        self.tables[a, b] = name

    def add(self, keys: DataFrame) -> DataFrame:
        """Appends a batch's run (key, n); returns its keys that repeat, in the batch or in the history, with n over both."""
        at = max((b for _, b in self.tables), default=-1) + 1
        history = list(self.tables.values())
        self._write(keys.select("key", "n"), at, at)
        new = self.spark.table(self.tables[at, at])
        again = new.filter("n > 1").select("key", "n", F.lit(0).cast("bigint").alias("before"))
        for run in history:
            again = again.unionByName(new.join(self.spark.table(run).withColumnRenamed("n", "before"), "key"))
        again = again.groupBy("key").agg((F.max("n") + F.sum("before")).alias("n"))
        again = stored(again, "repeated-keys")
        if len(self.tables) >= self.fan_in:
            self.compact()
        return again

    def compact(self) -> None:
        """All runs as one; the old ones go once the new one is whole."""
        old = dict(self.tables)
        merged = None
        for name in old.values():
            rows = self.spark.table(name)
            merged = rows if merged is None else merged.unionByName(rows)
        a, b = min(a for a, _ in old), max(b for _, b in old)
        self._write(merged.groupBy("key").agg(F.sum("n").alias("n")), a, b)
        for (c, d), name in old.items():
            self.spark.sql(f"DROP TABLE {name}")
            removed(self.spark, self._uri(c, d))
            del self.tables[c, d]

    def close(self) -> None:
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = {}


def _listed(lists) -> Callable[[np.ndarray], np.ndarray]:
    """Whether any of the lists has each key."""
    known = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in lists if x is not None]])).view(np.uint64)
    known = np.sort(known)

    def has(keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        return known[at] == keys if len(known) else np.zeros(len(keys), bool)

    return has


#: The code of rows whose windows are codes of spans that are sure to repeat.
SURE = -1
_OUT = ["key", "merged", "doc_id", "text_hash", "code", "windows"]


def _pieces(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows in order, in pieces of about PIECE_CHARS characters of text; a longer text is a piece of its own."""
    ends = rows["text"].map(lambda t: len(t or "")).cumsum().to_numpy()
    which = np.maximum(ends - 1, 0) // PIECE_CHARS
    for k in np.unique(which).tolist():
        yield rows[which == k].reset_index(drop=True)


def _candidates(rows: pd.DataFrame, chunks, held, hot) -> Iterator[pd.DataFrame]:
    """Rows of one piece: the window digests by key, equal ones merged; windows of hot keys one by one.

    held and hot tell which keys are candidates, and hot ones."""
    keys, docs, first, lengths, digests = [], [], [], [], []
    for c in chunks:
        take = np.flatnonzero(c.valid & held(c.least))
        if not len(take):
            continue
        digest = c.digests(take)
        key, doc = c.least[take], c.doc[take]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (take[1:] != take[:-1] + 1)))
        begin = np.flatnonzero(new)
        size = np.diff(np.concatenate((begin, [len(take)])))
        if size.max() > ROW_WINDOWS:  # long stretches with one key are cut
            place = np.arange(len(take)) - np.repeat(begin, size)
            begin = np.flatnonzero(place % ROW_WINDOWS == 0)
            size = np.diff(np.concatenate((begin, [len(take)])))
        keys.append(key[begin])
        docs.append(c.docs[doc[begin]])
        first.append(take[begin] - c.starts[doc[begin]])
        lengths.append(size)
        digests.append(digest)
    if not keys:
        return
    key, doc, s0, size, digest = map(np.concatenate, (keys, docs, first, lengths, digests))
    begin = np.cumsum(size) - size
    place = (np.arange(len(digest)) - np.repeat(begin, size)).astype(np.uint64)
    halves = digest.view(np.uint64).reshape(-1, 2)
    sums = [np.add.reduceat(mix(halves[:, k] + place * np.uint64(_P)), begin) ^ mix(key + size.astype(np.uint64)) for k in (0, 1)]
    same = np.ascontiguousarray(np.stack(sums, axis=1)).view(DIGEST).ravel()
    _, one, group, n = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
    doc_id, text_hash = rows["doc_id"].astype("Int64").array[doc], rows["text_hash"].to_numpy()[doc]
    whole = ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)).astype(np.int64)

    again = np.flatnonzero(n[group] > 1)  # sure to repeat
    sure_row, sure_code = [again], [(s0[again] << 32) | whole[again]]
    merged, is_hot = n > 1, hot(key[one])
    data = digest.tobytes()
    if is_hot.any():
        of = np.repeat(one[is_hot], size[one[is_hot]])
        at = np.arange(len(of)) - np.repeat(np.cumsum(size[one[is_hot]]) - size[one[is_hot]], size[one[is_hot]])
        x, start, sure = begin[of] + at, s0[of] + at, np.repeat(merged[is_hot], size[one[is_hot]])
        _, first_of, alike, times = np.unique(digest[x], return_index=True, return_inverse=True, return_counts=True)
        more = np.flatnonzero((times[alike] > 1) & ~sure)
        sure_row.append(of[more])
        sure_code.append((start[more] << 32) | 1)
        packed = [data[16 * i : 16 * i + 16] for i in x[first_of].tolist()]
        row = of[first_of]
        own = alone_key(key[row], halves[x[first_of], 0]).view(np.int64)
        any_sure = np.zeros(len(first_of), bool)
        np.logical_or.at(any_sure, alike, sure)
        yield pd.DataFrame(dict(zip(_OUT, (own, any_sure | (times > 1), doc_id[row], text_hash[row], start[first_of] << 32, packed), strict=True)))
    one, merged = one[~is_hot], merged[~is_hot]
    packed = [data[16 * a : 16 * (a + k)] for a, k in zip(begin[one].tolist(), size[one].tolist(), strict=True)]
    yield pd.DataFrame(dict(zip(_OUT, (key[one].view(np.int64), merged, doc_id[one], text_hash[one], s0[one] << 32, packed), strict=True)))
    # what is sure goes as one row a document, under a key of its own
    of_row, code = np.concatenate(sure_row), np.concatenate(sure_code)
    if len(of_row):
        order = np.argsort(doc[of_row], kind="stable")
        of_row, data = of_row[order], code[order].astype(np.int64).tobytes()
        cuts = np.flatnonzero(np.concatenate(([True], doc[of_row][1:] != doc[of_row][:-1], [True])))
        row = of_row[cuts[:-1]]
        packed = [data[8 * a : 8 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        own = mix(text_hash[row].view(np.uint64) + doc[row].astype(np.uint64) * np.uint64(_P)).view(np.int64)
        yield pd.DataFrame(dict(zip(_OUT, (own, False, doc_id[row], text_hash[row], SURE, packed), strict=True)))


def alone_key(key: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The key by which a window of a hot key goes, from half of its digest."""
    return mix(key ^ mix(half + np.uint64(_P)))


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each digest of x is one of known."""
    if not len(x) or not len(known):
        return np.zeros(len(x), bool)
    held = set(known.tolist())
    return np.fromiter((v in held for v in x.tolist()), bool, len(x))


class _Streamed:
    """Finds the windows that come twice among rows sorted by key; remembers the distinct windows of the last key alone."""

    def __init__(self):
        self.key = None
        self._forget()

    def _forget(self):
        self.x = np.zeros(0, DIGEST)
        self.waiting = np.zeros(0, bool)  # came once, not reported
        self.where = pd.DataFrame({"doc_id": pd.array([], "Int64"), "text_hash": np.zeros(0, np.int64), "start": np.zeros(0, np.int64)})

    def feed(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sure = rows["code"].to_numpy(np.int64) == SURE
        if sure.any():
            own = rows[sure]
            size = own["windows"].map(len).to_numpy() // 8
            code = np.frombuffer(b"".join(own["windows"]), np.int64)
            yield pd.DataFrame({"doc_id": own["doc_id"].astype("Int64").array.repeat(size), "text_hash": np.repeat(own["text_hash"].to_numpy(np.int64), size), "code": code})
            rows = rows[~sure]
        if not len(rows):
            return
        key = rows["key"].to_numpy(np.int64)
        merged = rows["merged"].to_numpy(bool)
        doc_id, text_hash = rows["doc_id"].astype("Int64").array, rows["text_hash"].to_numpy(np.int64)
        s0 = rows["code"].to_numpy(np.int64) >> 32
        blobs = rows["windows"].tolist()
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 16
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - begin[row]
        halves = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, 2).copy()
        halves[:, 0] ^= mix(key.view(np.uint64))[row]  # only windows of one key are alike
        x = halves.view(DIGEST).ravel()
        value, at, n = np.unique(x, return_inverse=True, return_counts=True)
        again = n > 1
        again[at[merged[row]]] = True
        if self.key != key[0]:
            self._forget()
        elif len(self.x):
            again |= _among(value, self.x)
            told = self.waiting & _among(self.x, value[again])
            if told.any():
                was = self.where[told]
                yield pd.DataFrame({"doc_id": was["doc_id"], "text_hash": was["text_hash"], "code": (was["start"].to_numpy(np.int64) << 32) | 1})
                self.waiting[told] = False
        mask = np.add.reduceat(np.where(again[at], np.int64(1) << place, 0), begin)
        out = np.flatnonzero((mask != 0) & ~merged)
        if len(out):
            yield pd.DataFrame({"doc_id": doc_id[out], "text_hash": text_hash[out], "code": (s0[out] << 32) | mask[out]})
        last = key[-1]
        if last != self.key:
            self._forget()
            self.key = last
        mine = np.flatnonzero(key[row] == last)
        mine = mine[~_among(x[mine], self.x)]
        if len(mine):
            new, one = np.unique(x[mine], return_index=True)
            one = mine[one]
            where = pd.DataFrame({"doc_id": doc_id[row[one]], "text_hash": text_hash[row[one]], "start": s0[row[one]] + place[one]})
            self.x = np.concatenate((self.x, new))
            self.waiting = np.concatenate((self.waiting, ~again[at[one]]))
            self.where = pd.concat([self.where, where], ignore_index=True)


def _own_keys(rows: DataFrame, keys: DataFrame, hot_places: int, width: int, gram: int) -> DataFrame:
    """rows (doc_id, text_hash, text) that have candidate keys, with these (keys, hot_keys), by a semi-join."""

    def run(batches):
        seen = WordHashes(SEEN_WORDS)
        for part in batches:
            ids, hashes = part["doc_id"].astype("Int64").array, part["text_hash"].to_numpy()
            for c in _chunks(part["text"], seen, width, gram):
                pairs = pd.DataFrame({"doc": c.docs[c.doc[c.valid]], "key": c.least[c.valid].view(np.int64)}).drop_duplicates()
                doc = pairs["doc"].to_numpy()
                yield pd.DataFrame({"own_id": ids[doc], "own_hash": hashes[doc], "key": pairs["key"]})

    marked = keys.groupBy("key").agg((F.max("n") >= hot_places).alias("hot"))
    found = rows.mapInPandas(run, "own_id bigint, own_hash bigint, key bigint").join(marked, "key").groupBy("own_id", "own_hash")
    found = found.agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot_keys"))
    on = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
    return rows.join(found, on).select("doc_id", "text_hash", "text", "keys", "hot_keys")


def repeated_windows(docs: DataFrame, keys: DataFrame, id_col="doc_id", text_col="text", width: int = WIDTH, gram: int = GRAM, most_bits: int = MAP_BITS, hot_places: int = HOT_PLACES, history: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash, codes: windows that also start elsewhere, as (first start << 32 | mask of starts from there on).

    keys: the candidate keys with the places counted (key, n). history: windows (key, digest) of other documents, which
    count as repeats and aren't reported."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    bits = map_bits(keys.count(), most_bits)
    if bits is None:
        rows, maps = _own_keys(rows, keys, hot_places, width, gram), None
    else:
        hot_keys = keys.filter(F.col("n") >= hot_places)
        maps = context.broadcast((key_filter(keys, bits), key_filter(hot_keys, map_bits(hot_keys.count(), most_bits))))

    def testers(part: pd.DataFrame):
        return [mapped(x) for x in maps.value] if maps is not None else [_listed(part[c]) for c in ("keys", "hot_keys")]

    def emit(batches):
        seen = WordHashes(SEEN_WORDS)
        for batch in batches:
            for part in _pieces(batch):
                yield from _candidates(part, _chunks(part["text"], seen, width, gram), *testers(part))

    def recall(batches):
        for part in batches:
            key = part["key"].to_numpy(np.int64).view(np.uint64)
            halves = np.frombuffer(b"".join(part["digest"]), np.uint64).reshape(-1, 2)
            hot = part["hot"].to_numpy(bool)
            key = np.where(hot, alone_key(key, halves[:, 0]), key)
            none = pd.array([None] * len(key), "Int64")
            yield pd.DataFrame(dict(zip(_OUT, (key.view(np.int64), True, none, 0, 0, part["digest"].tolist()), strict=True)))

    def confirm(batches):
        state = _Streamed()
        for part in batches:
            yield from state.feed(part)

    layout = "key bigint, merged boolean, doc_id bigint, text_hash bigint, code bigint, windows binary"
    found = rows.mapInPandas(emit, layout)
    if history is not None:
        former = history.join(keys.groupBy("key").agg(F.max("n").alias("n")), "key")
        if maps is None:
            former = former.withColumn("hot", F.col("n") >= hot_places)
        else:

            @F.pandas_udf("boolean")
            def is_hot(key: pd.Series) -> pd.Series:
                return pd.Series(mapped(maps.value[1])(key.to_numpy(np.int64).view(np.uint64)))

            former = former.withColumn("hot", is_hot("key"))
        found = found.unionByName(former.select("key", "digest", "hot").mapInPandas(recall, layout))
    ready = found.repartition("key").sortWithinPartitions("key")
    spans = ready.mapInPandas(confirm, "doc_id bigint, text_hash bigint, code bigint")
    # a set: copies of a row send the same codes, so a list is no longer than one text's windows
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set("code").alias("codes"))


def keep_mask(n_words: int, codes, width: int = WIDTH) -> np.ndarray:
    codes = np.asarray(codes, np.int64)
    starts = [(codes >> 32)[(codes >> b) & 1 > 0] + b for b in range(ROW_WINDOWS)]
    edge = np.zeros(n_words + width + 1, np.int64)
    starts = np.unique(np.concatenate(starts))
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge)[:n_words] == 0


def kept_words(text: str | None, codes, width: int = WIDTH) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    found = words(text)
    if codes is None or not len(found):
        return found, len(found)
    keep = keep_mask(len(found), codes, width)
    return [w for w, k in zip(found, keep.tolist(), strict=True) if k], len(found)


def _place(doc_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(F.lit(3), doc_id, text_hash)


def _spanned(docs: DataFrame, id_col="doc_id", text_col="text", width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, root: str | None = None, batch: str | None = None, hot_places: int = HOT_PLACES, most_bits: int = MAP_BITS, most_keys: int = BROADCAST_KEYS) -> tuple[DataFrame, DataFrame | None]:
    """(row, codes) of the documents that may lose words, and (row) of the others, if these are told apart.

    row holds all columns of a document, codes the windows to remove from its text (null: none).

    The documents enter the index at `root` in parts; windows count as repeated across all of them and what calls of
    other batches on that root entered. `batch` names the call's documents: a call that is made again under its name,
    after a failure or not, replaces what it left and gives the same result."""
    spark = docs.sparkSession
    if root and not batch:
        raise ValueError("a named index needs the batch's name, by which a repeated call is known")
    history = held_windows(spark, root, batch) if root else None
    index = FingerprintIndex(spark, root or scratch(spark, "fingerprints"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    again = None
    for i in range(batches):
        part = docs.filter(F.pmod(F.xxhash64(F.lit(11), id_col), F.lit(batches)) == i)
        found = index.add(window_keys(part, text_col, width, gram))
        again = found if again is None else again.unionByName(found)
    index.close()
    if root:
        window_digests(docs, text_col, width, gram).write.mode("overwrite").parquet(f"{root}/{_windows(batch)}")
    spans = repeated_windows(docs, again, id_col, text_col, width, gram, most_bits, hot_places, history)
    spans = stored(spans, "repeated-windows").withColumnsRenamed({"doc_id": "span_id", "text_hash": "span_hash"})
    held = F.col("row").getField
    rows = docs.select(F.struct("*").alias("row")).select("row", held(id_col).cast("bigint").alias("own_id"), F.xxhash64(held(text_col)).alias("own_hash"))
    on = F.col("own_id").eqNullSafe(F.col("span_id")) & (F.col("own_hash") == F.col("span_hash"))
    joined = lambda part: part.join(spans.hint("shuffle_hash"), on, "left").select("row", "codes")
    keys = spans.select(_place(F.col("span_id"), F.col("span_hash")).alias("key"))
    some, rest = parted(rows, _place(F.col("own_id"), F.col("own_hash")), keys, most_keys)
    return joined(some), None if rest is None else rest.select("row")


def with_spans(docs: DataFrame, *args, **more) -> DataFrame:
    """row and codes of all documents; arguments as of _spanned."""
    some, rest = _spanned(docs, *args, **more)
    return some if rest is None else some.unionByName(rest.withColumn("codes", F.lit(None).cast("array<bigint>")))


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text", width: int = WIDTH, **more) -> DataFrame:
    """The documents, all columns; texts that lose words are their kept words, joined by one space."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([t if c is None else b" ".join(kept_words(t, c, width)[0]).decode("utf-8", "surrogatepass") for t, c in zip(text, codes, strict=True)], dtype=object)

    some, rest = _spanned(docs, id_col, text_col, width, **more)
    held = F.col("row").getField
    out = some.withColumn("cut", cut(held(text_col), F.col("codes"))).select(*[F.col("cut").alias(c) if c == text_col else held(c).alias(c) for c in docs.columns])
    return out if rest is None else out.unionByName(rest.select("row.*"))


def op4_substring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    @F.pandas_udf("n_words bigint, n_removed bigint, kept_sha256 string")
    def digest(text: pd.Series, codes: pd.Series) -> pd.DataFrame:
        out = []
        for t, c in zip(text, codes, strict=True):
            kept, n = kept_words(t, c)
            out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    return with_spans(docs).select("row.doc_id", digest("row.text", "codes").alias("d")).select("doc_id", "d.*")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT rid, unnest(range(1, len(ws) - 33)) AS i, ws FROM d WHERE len(ws) >= 35),
h AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS t FROM w),
again AS (SELECT t FROM h GROUP BY t HAVING count(*) > 1),
s AS (SELECT rid, i FROM h JOIN again USING (t)),
p AS (SELECT d.rid, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
c AS (SELECT p.rid, p.i, word, max(s.i) OVER (PARTITION BY p.rid ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NULL AS keep
  FROM p LEFT JOIN s ON s.rid = p.rid AND s.i = p.i),
k AS (SELECT rid, count(*) AS n_words, count(*) FILTER (NOT keep) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (keep), '') AS kept FROM c GROUP BY rid)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
