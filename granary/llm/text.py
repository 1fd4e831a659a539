"""What several operators read from texts."""

from __future__ import annotations

import xxhash

#: Words are runs of bytes other than space and \t\n\v\f\r; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


class WordHashes(dict):
    """64-bit hash of each word, remembered; forgets everything beyond `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h
