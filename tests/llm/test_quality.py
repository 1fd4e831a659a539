import re
from collections import Counter

import numpy as np

from granary.llm import quality

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, kept int, bucket int"


def brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if windows[x] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def brute_ngrams(text, bits=quality.BITS):
    toks = [t for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for t in re.findall(r"\w+|[^\w\s]+", w.lower())]
    import xxhash

    h = [int.from_bytes(xxhash.xxh3_64_digest(t.encode()), "little") for t in toks]
    m = (1 << 64) - 1

    def mix(x):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & m
        x ^= x >> 29
        x = x * 0xA0761D6478BD642F & m
        return x ^ x >> 32

    low = (1 << bits) - 1
    return [mix(x) & low for x in h] + [mix((a * 0x9E3779B97F4A7C15 + b) & m) & low for a, b in zip(h, h[1:], strict=False)]


def brute(docs, trusted):
    raw, target = np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS)
    for k, text in docs:
        for b in brute_ngrams(text):
            raw[b] += 1
            target[b] += k in trusted
    if target.sum():
        ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    else:
        ratio = np.zeros(len(raw))
    out = []
    for k, text in docs:
        base, grams = brute_base(text), brute_ngrams(text)
        llr = float(np.mean(ratio[grams])) if grams else 0.0
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        out.append((k, *base, failed, not failed and llr >= quality.THRESHOLD, round(llr, 9)))
    return sorted(out, key=str)


def found(docs, labels):
    rows = quality.judged(docs, quality.ratios(quality.counted(docs, labels))).collect()
    return sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"], round(r["llr"], 9)) for r in rows), key=str)


def test_documents_match_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    trusted = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    got = found(docs, labels)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], trusted)
    kept = {r[0]: r[7] for r in got if not r[6]}
    assert all(kept[k] for k in trusted if k in kept)  # clean documents stay
    assert not all(kept.values())


def test_edge_rows(spark):
    rows = [(1, None, 0, 0), (2, "", 0, 0), (None, "a b\x0bc\u00a0d #x\n\na b\x0bc\u00a0d #x\n \t\n", 0, 0), (3, "x y z " * 40000, 0, 0), (3, "x y z " * 40000, 0, 0), (4, "ÄÖ !! ää", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(4, 1), (4, 0), (4, 1), (None, 1), (3, None)], "doc_id bigint, quality int")
    assert found(docs, labels) == brute([(r[0], r[1]) for r in rows], {4})
    assert found(docs, labels.limit(0)) == brute([(r[0], r[1]) for r in rows], set())
    assert found(docs.limit(0), labels) == []
