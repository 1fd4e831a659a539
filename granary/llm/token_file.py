"""Token-ID / binary output: directly addressable codes.

A file holds the ids of consecutive documents. An id is cut into chunks of 8 bits, the lowest first;
level k stores the k-th chunks of all ids that have one, a bitmap of which ids go on to the next level,
and a rank directory (set bits before every 512th). The place of an id's next chunk is the rank of its
bit, so any token is read by one look-up a level, with no block decoded. The documents' ids and offsets
follow. Files end at MAX_IDS ids, or with the document that passes it.

Files are written in ascending doc_id order (range partitions, sorted) and moved to names that the
partition determines. All ids come from the tokenizers library, normalizer and splitter included. Where the file's
steps look at words alone (NFC, lower case, a splitter that drops white space), it is handed the distinct words
of a batch, in lower case and cut before marks, which begin pieces of their own; what it says of a word is
remembered in two generations. Other files, and texts that may hold a special token, go to it whole.

Edge cases: a null text is empty and has the end id alone; null ids come first; ties are ordered by the hash of
their text, so that many rows of one id are several ranges; very long texts are whole; an empty table writes no file.
Other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.warc import _fs, _Placed
from granary.session import bounded_batches, scratch, stored, table

END_ID = 2
MAX_IDS = 1 << 22
MAGIC = b"GDAC0001"
RANK_BITS = 512


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The steps of a file whose ids of a text are those of its words. The splitter is fixed by the vocabulary's format.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes that are an ASCII letter in lower case or a digit, bytes that end a letter of U+00C0 to U+00FF, and ASCII marks.
_ALNUM = np.array([chr(b).isascii() and (chr(b).islower() or chr(b).isdigit()) for b in range(256)])
_LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_MARK = np.array([0x21 <= b <= 0x7E and not chr(b).isalnum() for b in range(256)])
#: Words of the texts that are looked up together.
CHUNK_WORDS = 1 << 20


def words_of(data: bytes) -> list[bytes]:
    """The words, in lower case, and cut where an ASCII mark stands behind a letter or digit: there it begins a piece."""
    data = data.lower()
    if len(data) < 2:
        return data.split()
    a = np.frombuffer(data, np.uint8)
    letter = _ALNUM[a[:-1]]
    letter[1:] |= (a[:-2] == 0xC3) & _LATIN[a[1:-1]]
    at = np.flatnonzero(letter & _MARK[a[1:]])
    return np.insert(a, at + 1, 0x20).tobytes().split() if len(at) else data.split()


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes, by the library."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's cores have tasks of their own
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path) as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        splits = bool(steps) and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[0]["pattern"] == {"Regex": SPLITTER}
        self.by_word = bool(kinds == NORMALIZERS and splits and not steps[1].get("add_prefix_space") and spec["post_processor"] is None and all(x["content"].startswith("<|") and " " not in x["content"] for x in spec["added_tokens"]))
        # two generations: when the younger is full the older goes, so what is in use stays
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        lists = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = list(accumulate(map(len, lists)))
        data = np.fromiter(chain.from_iterable(lists), "<u4", ends[-1] if ends else 0).tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, lists: list[list[bytes]]) -> None:
        young, old = self.young, self.old
        missing = set().union(*lists).difference(young)
        young.update((w, old[w]) for w in missing if w in old)
        new = [w for w in missing if w not in young]
        young.update(zip(new, self._library([w.decode("utf-8", "replace") for w in new]), strict=True))

    def _chunk(self, texts: list[str | None], lists: list[list[bytes] | None]) -> list[bytes]:
        self._learn([x for x in lists if x is not None])
        whole = iter(self._library([t for t, x in zip(texts, lists, strict=True) if x is None]))
        known = self.young.__getitem__
        out = [next(whole) if x is None else b"".join(map(known, x)) for x in lists]
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        return out

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; a null text has none."""
        first, lists, n = 0, [], 0
        for i, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            # what may hold a special token goes whole
            lists.append(words_of(data) if self.by_word and b"<|" not in data else None)
            n += len(lists[-1] or ())
            if n >= CHUNK_WORDS or i == len(texts) - 1:
                yield from self._chunk([x or "" for x in texts[first : i + 1]], lists)
                first, lists, n = i + 1, [], 0


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker process, which keeps its words over tasks."""
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))


def _bitmap(bits: np.ndarray) -> tuple[bytes, bytes]:
    pad = -len(bits) % RANK_BITS
    packed = np.packbits(np.pad(bits, (0, pad)), bitorder="little")
    per = np.pad(bits, (0, pad)).reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint64)
    return packed.tobytes(), np.concatenate(([0], np.cumsum(per))).astype("<u8").tobytes()


def packed(ids: np.ndarray, doc_ids: list, ends: list[int]) -> bytes:
    """One file's bytes. A level's header: entries, then bytes of its chunks, bitmap and rank directory."""
    parts, heads, rest = [], [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        chunks = (rest & 0xFF).astype(np.uint8).tobytes()
        bitmap, ranks = _bitmap(more) if more.any() else (b"", b"")
        heads.append((len(rest), len(chunks), len(bitmap), len(ranks)))
        parts += [chunks, bitmap, ranks]
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    known = np.array([x is not None for x in doc_ids], np.uint8).tobytes()
    documents = np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + known + np.array([0, *ends], "<u8").tobytes()
    head = MAGIC + struct.pack("<QQ", len(heads), len(doc_ids)) + b"".join(struct.pack("<QQQQ", *x) for x in heads)
    return head + b"".join(parts) + documents


class Reader:
    """Random access to the tokens of one file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n_levels, n_docs = struct.unpack_from("<QQ", data, 8)
        at = 24 + 32 * n_levels
        self.levels = []
        for k in range(n_levels):
            n, c, b, r = struct.unpack_from("<QQQQ", data, 24 + 32 * k)
            chunks, bitmap = np.frombuffer(data, np.uint8, c, at), np.frombuffer(data, np.uint8, b, at + c)
            self.levels.append((chunks, bitmap, np.frombuffer(data, "<u8", r // 8, at + c + b)))
            at += c + b + r
        self.n = len(self.levels[0][0])
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        self.known = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.offsets = np.frombuffer(data, "<u8", n_docs + 1, at + 9 * n_docs).astype(np.int64)

    def _rank(self, level: int, i: int) -> int:
        """Set bits of the level's bitmap before place i."""
        _, bitmap, ranks = self.levels[level]
        block = i // RANK_BITS
        part = bitmap[block * RANK_BITS // 8 : i // 8]
        tail = int(bitmap[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(ranks[block]) + int(np.bitwise_count(part).sum(dtype=np.int64)) + tail.bit_count()

    def __getitem__(self, i: int) -> int:
        out, shift, level = 0, 0, 0
        while True:
            chunks, bitmap, _ = self.levels[level]
            out |= int(chunks[i]) << shift
            if not len(bitmap) or not bitmap[i // 8] >> (i % 8) & 1:
                return out
            i, level, shift = self._rank(level, i), level + 1, shift + 8

    def span(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Tokens a to b; those that go on lie side by side in the next level too."""
        chunks, bitmap, _ = self.levels[level]
        out = chunks[a:b].astype(np.uint32)
        if len(bitmap) and b > a:
            bits = np.unpackbits(bitmap[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
            on = np.flatnonzero(bits)
            if len(on):
                first = self._rank(level, a)
                out[on] |= self.span(first, first + len(on), level + 1) << np.uint32(8)
        return out


def write_tokens(docs: DataFrame, root: str, tokenizer: str | None = None, end_id: int | None = END_ID, id_col="doc_id", text_col="text", max_ids: int = MAX_IDS) -> DataFrame:
    """Writes the files below root; returns file, part, seq, n_docs, n_ids and start (ids of all files before), stored."""
    path = tokenizer or word_bpe_path()
    spark = docs.sparkSession
    bounded_batches(spark)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches):
        encode, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        blobs, doc_ids, ends, n = [], [], [], 0

        def flush():
            nonlocal blobs, doc_ids, ends, n, seq
            name = f"{part:06d}-{seq:04d}.dac"
            out = _Placed(f"{root}/{name}")
            out.write(packed(np.frombuffer(b"".join(blobs), "<u4"), doc_ids, ends))
            out.place()
            row = pd.DataFrame([(name, part, seq, len(doc_ids), n)], columns=["file", "part", "seq", "n_docs", "n_ids"])
            blobs, doc_ids, ends, n, seq = [], [], [], 0, seq + 1
            return row

        for rows in batches:
            for doc_id, ids in zip(rows["doc_id"], encode.batch(rows["text"].tolist()), strict=True):
                blob = ids + end
                blobs.append(blob)
                n += len(blob) // 4
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                ends.append(n)
                if n >= max_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n_parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = stored(ordered.mapInPandas(write, "file string, part int, seq int, n_docs bigint, n_ids bigint"), "token-files")
    # one row per partition, then the files of each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("of_part")).withColumn("base", F.coalesce(F.sum("of_part").over(before), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return files.join(parts, "part").select("file", "part", "seq", "n_docs", "n_ids", start.alias("start"))


def read_tokens(files: DataFrame, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files."""

    def read(batches):
        for rows in batches:
            for name, start in zip(rows["file"], rows["start"], strict=True):
                fs, path = _fs(f"{root}/{name}")
                with fs.open_input_stream(path, compression=None) as stream:
                    file = Reader(stream.read())
                ids = memoryview(file.span(0, file.n).astype("<u4").tobytes())
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(file.offsets[:-1].tolist(), file.offsets[1:].tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(file.doc_ids, "Int64"), "start": start + file.offsets[:-1], "n_tokens": np.diff(file.offsets), "ids_crc32": crc})
                out.loc[file.known == 0, "doc_id"] = pd.NA
                yield out

    n = max(1, min(files.count(), 4096))
    return files.repartition(n, "file").mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op9_token_file(spark, sf_dir):
    root = scratch(spark, "tokens")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), root), root)
