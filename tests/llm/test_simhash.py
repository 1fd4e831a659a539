import re

import numpy as np
import pytest
import xxhash

from granary.llm import simhash

DATA = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    """rows: (id, fingerprint); smallest id reachable of each row, by all pairs."""
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 4:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(k)
    return [min((k for k in groups[root(i)] if k is not None), default=None) for i in range(len(rows))]


def as_brute(docs):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    return sorted(((k, f"{f:016x}", c) for (k, f), c in zip(rows, brute_groups(rows), strict=True)), key=str)


def found(docs, **more):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, **more).collect()), key=str)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert found(docs) == as_brute(docs)


def test_edge_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, " \t\n", "x", 1), (4, "One word", "x", 1), (None, "one WORD", "x", 1), (5, "a b c d e f g " * 3000, "x", 1), (5, "a b c d e f g " * 3000, "x", 1), (None, "ganz allein é", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, fp bigint")
    assert found(docs) == as_brute(docs)
    kept = simhash.deduplicated(docs).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 4, 5, None]
    more = docs.selectExpr("*", "9 AS gone_id", "8 AS row", "7 AS own_id", "6 AS bare_fp", "5 AS goes", "4 AS listed_id")
    assert simhash.deduplicated(more).columns == more.columns and simhash.deduplicated(more).count() == 4
    assert found(docs.limit(0)) == []
    assert simhash.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 9, dtype=np.uint64)
    fps, group = [], []
    for g in range(9):
        for _ in range(int(rng.integers(1, 150))):
            flips = rng.integers(0, 64, rng.integers(0, 9))
            x = int(base[g])
            for f in flips:
                x ^= 1 << int(f)
            fps.append(x)
            group.append(g)
    fps, group = np.array(fps, np.uint64), np.array(group)
    pairs = {(int(i), int(j)) for a, b in simhash.close_rows(fps, group, radius) for i, j in zip(a, b, strict=True)}
    brute = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    assert pairs == brute and brute


def test_hot_buckets_in_tiles(spark):
    rng = np.random.default_rng(9)
    center, fps = int(rng.integers(0, 1 << 62)), set()
    while len(fps) < 300:
        x = center
        for f in rng.integers(0, 64, 5):
            x ^= 1 << int(f)
        fps.add(x if x < 1 << 63 else x - (1 << 64))
    fps = sorted(fps)
    table = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    for n in (len(fps), 10**8, 10**12):  # also with the blocks of a large corpus
        edges = simhash.links(table, n, tile=32).collect()
        root = {x: x for x in fps}

        def up(x):
            while root[x] != x:
                x = root[x]
            return x

        for e in edges:
            a, b = up(e["src"]), up(e["dst"])
            root[max(a, b)] = min(a, b)
        brute = brute_groups([(x, x & (2**64 - 1)) for x in fps])
        assert [up(x) for x in fps] == brute
