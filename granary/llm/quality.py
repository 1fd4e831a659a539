"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target to the raw corpus.

Tokens are runs of word characters or of other characters, lower case; unigrams and bigrams are hashed
into 2^BITS buckets. The raw multinomial counts every n-gram of every document, the target those of the
documents whose quality label is 1; both are smoothed. A document's score is the mean over its n-grams
of log target - log raw, so it doesn't grow with length; it is kept if the score reaches THRESHOLD and
the base rules pass. The threshold is applied to every document; nothing is sampled.

Base rules: at least MIN_WORDS words, and at most half of them inside 3-word windows that come twice.

Edge cases: a null text has no words, and texts without words have score 0 and fail the base rules; null
ids never match a label; a document is trusted if any of its labels is 1; rows that repeat count each;
without trusted documents, or in an empty table, all scores are 0. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.substring import grams, mix
from granary.llm.text import words
from granary.session import bounded_batches, table

BITS = 16
SMOOTHING = 1.0
THRESHOLD = -0.4
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Trusted ids up to this many are broadcast (at most 32 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
CHUNK_WORDS = 1 << 18

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_P = 0x9E3779B97F4A7C15


class _Packed(dict):
    """Packed 64-bit hashes of a word's tokens; remembers up to `most` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = _TOKEN.findall(word.decode("utf-8", "replace").lower())
        out = self[word] = b"".join(xxhash.xxh3_64_digest(t.encode()) for t in found)
        return out


class _Words(dict):
    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh3_64_digest(word)
        return out


def _by_document(lists: list[list[bytes]], seen: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents end to end, and how many each has."""
    blobs = [b"".join([seen[w] for w in found]) for found in lists]
    counts = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
    return np.frombuffer(b"".join(blobs), np.uint64), counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each document's values, which lie end to end."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def buckets(h: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the unigrams, of the bigrams, and the bigrams' document (as a row)."""
    doc = np.repeat(np.arange(len(counts)), counts)
    low = np.uint64((1 << bits) - 1)
    one = (mix(h) & low).astype(np.int64)
    if len(h) < 2:
        return one, np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = doc[1:] == doc[:-1]
    two = (grams(h, 2, _P) & low).astype(np.int64)
    return one, two[inside], doc[:-1][inside]


def _chunks(rows: pd.DataFrame) -> Iterator[tuple[int, int, list]]:
    first, held, n = 0, [], 0
    for i, text in enumerate(rows["text"]):
        held.append(words(text))
        n += len(held[-1])
        if n >= CHUNK_WORDS:
            yield first, i + 1, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, len(rows), held


def counted(docs: DataFrame, labels: DataFrame, bits: int = BITS, id_col="doc_id", text_col="text") -> DataFrame:
    """bucket, raw, target: n-grams of all documents, and of the trusted ones."""
    bounded_batches(docs.sparkSession)
    trusted = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("trusted_id")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    right = F.broadcast(trusted) if trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else trusted.hint("shuffle_hash")
    rows = rows.join(right, F.col("id") == F.col("trusted_id"), "left").select("text", F.col("trusted_id").isNotNull().alias("trusted"))

    def run(batches):
        seen, raw, target = _Packed(), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for part in batches:
            trusted = part["trusted"].to_numpy(bool)
            for a, b, lists in _chunks(part):
                h, counts = _by_document(lists, seen)
                one, two, two_doc = buckets(h, counts, bits)
                raw += np.bincount(one, minlength=1 << bits) + np.bincount(two, minlength=1 << bits)
                mine = trusted[a:b]
                target += np.bincount(one[np.repeat(mine, counts)], minlength=1 << bits) + np.bincount(two[mine[two_doc]], minlength=1 << bits)
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})

    return rows.mapInPandas(run, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(counts: DataFrame, bits: int = BITS) -> np.ndarray:
    """log target - log raw of each bucket; the table has 2^bits rows at most."""
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    rows = counts.toPandas()
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.sum():
        return np.zeros(1 << bits)
    share = lambda x: np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * len(x)))
    return share(target) - share(raw)


def base_figures(texts, lists: list[list[bytes]], seen: dict) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n_words = np.fromiter(map(len, lists), np.int64, len(lists))
    chars, symbols, lines = [], [], []
    for text in texts:
        text = text or ""
        chars.append(len(text) - sum(map(text.count, _SPACES)))
        symbols.append(sum(map(text.count, _SYMBOLS)))
        full = [x for x in text.split("\n") if x.strip(_SPACES)]
        lines.append(len(full) - len(set(full)))
    h, counts = _by_document(lists, seen)
    repeat = np.zeros(len(lists), np.int64)
    if len(h) >= 3:
        doc = np.repeat(np.arange(len(counts)), counts)
        inside = doc[2:] == doc[:-2]
        key = grams(h, 3, _P) ^ mix(doc[:-2].astype(np.uint64) + np.uint64(_P))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        same = (key[order][1:] == key[order][:-1]) & inside[order][1:] & inside[order][:-1]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[k : len(h) - 2 + k] |= again
        repeat = _sums(covered.astype(np.int64), counts)
    return {"n_words": n_words, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": repeat}


def judged(docs: DataFrame, table_of_ratios: np.ndarray, threshold: float = THRESHOLD, bits: int = BITS, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, the base figures, base_failed, llr (mean log ratio of the n-grams), kept."""
    held = docs.sparkSession.sparkContext.broadcast(table_of_ratios)

    def run(batches):
        tokens, seen, ratio = _Packed(), _Words(), held.value
        for part in batches:
            texts, ids = part["text"].tolist(), part["doc_id"].astype("Int64")
            for a, b, lists in _chunks(part):
                out = base_figures(texts[a:b], lists, seen)
                h, counts = _by_document(lists, tokens)
                one, two, two_doc = buckets(h, counts, bits)
                total = np.bincount(np.repeat(np.arange(len(counts)), counts), ratio[one], len(counts)) + np.bincount(two_doc, ratio[two], len(counts))
                n = counts + np.maximum(counts - 1, 0)
                llr = np.where(n > 0, total / np.maximum(n, 1), 0.0)
                failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
                yield pd.DataFrame({"doc_id": ids[a:b].array, **out, "base_failed": failed, "llr": llr, "kept": ~failed & (llr >= threshold)})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, llr double, kept boolean")


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ratio = ratios(counted(docs, table(spark, sf_dir, "labels")))
    return judged(docs, ratio).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
