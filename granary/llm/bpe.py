"""Byte-level BPE encoding and decoding by the tiktoken library, with a local rank file.

Texts of over LONG characters are cut before encoding where no token can cross: between a character
that isn't white space and a space, tab or line end after it. Both are what they are to Python's and to the
library's regex engine alike (U+001C to U+001F aren't, so no cut goes before them); no alternative of the pattern
spans that place, and none looks back, so the pieces' ids are the text's ids.
Decoding joins the raw bytes of the ids, never strings, so ids that cut a character survive.

Edge cases: a null text is empty and has no ids; strings that look like special tokens are ordinary
text; a long text without white space stays whole; null and repeated ids are passed on; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import bounded_batches, table

LONG = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    def __init__(self, path: str | None = None, pattern: str | None = None):
        import tiktoken

        with open(path or rank_path(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern or split_pattern(), mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def pieces(text: str, most: int = LONG) -> Iterator[str]:
        """The text cut at safe places, each piece of at least `most` characters but the last."""
        at = 0
        while len(text) - at > most:
            cut = _SAFE.search(text, at + most)
            if cut is None or cut.start() >= len(text):
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str | None, most: int = LONG) -> list[int]:
        if not text:
            return []
        if len(text) <= most:
            return self.encoding.encode_ordinary(text)
        return [x for piece in self.pieces(text, most) for x in self.encoding.encode_ordinary(piece)]

    def decode(self, ids) -> bytes:
        return self.encoding.decode_bytes(ids)


def encoded(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int)."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(path)
        for texts in batches:
            yield pd.Series([np.array(codec.encode(x), np.int32) for x in texts], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("ids"))


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, data: the raw bytes of column ids."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(path)
        for lists in batches:
            yield pd.Series([codec.decode([] if x is None else x.tolist()) for x in lists], dtype=object)

    return rows.select("doc_id", run("ids").alias("data"))


def digests(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass, only digests returned."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(path)
        for texts in batches:
            out = []
            for text in texts:
                ids = codec.encode(text)
                out.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("d")).select("doc_id", "d.*")


def op5_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
