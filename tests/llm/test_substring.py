import random
import re
from collections import Counter

import pytest

from granary.llm import bitmaps, substring


def brute(rows, width=35):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + width]) for w in lists for i in range(len(w) - width + 1))
    out = []
    for (k, _), w in zip(rows, lists, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if n[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((k, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else None))
    return sorted(out, key=str)


def check(spark, rows, **more):
    docs = spark.createDataFrame([(k, t, 1, "x", 2, 3, 4, 5) for k, t in rows], "doc_id bigint, text string, key int, codes string, _codes int, _span_id int, row int, own_id int")
    got = substring.deduplicated(docs, **more)
    assert got.columns == docs.columns
    given = dict(zip(map(str, rows), rows, strict=True))
    assert given
    want = sorted(((k, t if cut is None else cut) for (k, t), (_, cut) in zip(sorted(rows, key=str), [brute_one(rows, r) for r in sorted(rows, key=str)], strict=True)), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == want


def brute_one(rows, row):
    at = rows.index(row)
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    n = Counter(tuple(w[i : i + 35]) for w in lists for i in range(len(w) - 34))
    w = lists[at]
    gone = set()
    for i in range(len(w) - 34):
        if n[tuple(w[i : i + 35])] > 1:
            gone |= set(range(i, i + 35))
    return row[0], (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else None)


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([34, 35, 36, 50, 120]))] for _ in range(6)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
            if rng.random() < 0.5:
                p = list(rng.choice(passages))
                if rng.random() < 0.3:
                    p[rng.randrange(len(p))] = "other"
                words += p
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, seed):
    check(spark, corpus(seed, 60, [f"w{i}" for i in range(400)]))
    check(spark, corpus(seed, 60, [f"w{i}" for i in range(400)]), hot_places=2)


@pytest.mark.parametrize("hot_places", [2, 1024])
def test_keys_beyond_the_largest_map(spark, hot_places):
    """The semi-join that takes the maps' place finds the same windows."""
    rows = corpus(21, 60, [f"w{i}" for i in range(400)]) + [(None, "a b " * 60), (None, "a b " * 60), (None, None)]
    check(spark, rows, most_bits=4, hot_places=hot_places, most_keys=0)


def test_periodic_texts(spark):
    check(spark, corpus(7, 40, ["a", "b"]) + [(100, "a " * 500), (101, "a b c d e " * 8), (102, "one two three " * 12), (103, "x " * 34), (104, "y " * 35), (105, "z " * 36)])


def test_hot_keys(spark):
    """Keys with many places, taken as hot from few places on: periodic texts, and one gram amid different words."""
    common = " ".join(f"c{i}" for i in range(8))
    rng = random.Random(5)
    around = [" ".join(f"w{rng.randrange(40)}" for _ in range(30)) for _ in range(12)]
    rows = [(k, f"{rng.choice(around)} {common} {rng.choice(around)}") for k in range(80)]
    rows += [(200, "a b " * 200), (201, "a b c " * 90), (202, around[0] + " a b" * 60), (None, rows[0][1])]
    check(spark, rows, hot_places=5)
    check(spark, rows)


def test_edge_rows(spark):
    long = " ".join(f"q{i}" for i in range(70000))
    check(spark, [(1, None), (2, ""), (None, " \t "), (None, "r " * 50), (3, "s t\tu\n" * 30), (4, long), (5, "lead " + long[:5000] + " tail"), (6, "é\u00a0ö " * 40)])
    check(spark, [(1, " ".join(f"w{i}" for i in range(60)))] * 3 + [(1, "another text")])
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert substring.deduplicated(empty).count() == 0


def test_index_over_batches(spark, tmp_path):
    """Windows that the history holds repeat; runs are compacted and found again from the folder."""
    rows = corpus(11, 50, [f"w{i}" for i in range(300)])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    root = f"file://{tmp_path}/index"
    index = substring.FingerprintIndex(spark, root, 3, fan_in=3)
    again = set()
    for i in range(4):
        again |= {r["key"] for r in index.add(substring.window_keys(docs.filter(f"doc_id % 4 = {i}"))).collect()}
    whole = {r["key"] for r in substring.window_keys(docs).filter("n > 1").collect()}
    assert again == whole
    assert len(index.tables) < 4
    index.close()
    reopened = substring.FingerprintIndex(spark, root, 3)
    n = sum(spark.table(t).agg({"n": "sum"}).first()[0] for t in reopened.tables.values())
    assert n == substring.window_keys(docs).agg({"n": "sum"}).first()[0]
    repeats = reopened.add(substring.window_keys(docs.filter("doc_id = 1")))
    assert repeats.distinct().count() == substring.window_keys(docs.filter("doc_id = 1")).count()
    reopened.close()


@pytest.mark.parametrize("hot_places", [2, 1024])
def test_removal_against_former_calls(spark, tmp_path, hot_places):
    """A passage that comes once in each of two calls on one root goes in the second; runs are compacted on the way."""
    import os

    passage = " ".join(f"p{i}" for i in range(50))
    first = [(1, f"one {passage} end"), (2, " ".join(f"q{i}" for i in range(60)))]
    second = [(11, f"a b c {passage} d e"), (12, " ".join(f"r{i}" for i in range(60))), (13, "q0 q1 q2 q3 q4 q5 q6 q7 q8 other words")]
    root = f"file://{tmp_path}/index"
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    run = lambda rows, batch: dict(map(tuple, substring.deduplicated(make(rows), root=root, batch=batch, hot_places=hot_places).collect()))
    assert run(first, "monday") == dict(first)
    assert run(second, "tuesday") == {11: "a b c d e", 12: second[1][1], 13: second[2][1]}
    n = spark.conf.get("spark.sql.shuffle.partitions")
    assert sorted(x for x in os.listdir(f"{tmp_path}/index") if x.startswith("run-")) == [f"run-0-6-{n}", f"run-7-7-{n}"]


def test_a_call_can_be_made_again(spark, tmp_path, monkeypatch):
    """A call that fails after its windows were written, or that was whole, gives the same when it is made again."""
    rows = [(k, " ".join(f"{k}w{i}" for i in range(60))) for k in range(4)]
    other = [(9, rows[0][1] + " and more"), (10, " ".join(f"z{i}" for i in range(60)))]
    root = f"file://{tmp_path}/index"
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    run = lambda rows, batch: dict(map(tuple, substring.deduplicated(make(rows), root=root, batch=batch).collect()))
    verify = substring.repeated_windows

    def lost(*args):
        raise RuntimeError("an executor too many was lost")

    monkeypatch.setattr(substring, "repeated_windows", lost)
    with pytest.raises(RuntimeError):
        run(rows, "a")
    monkeypatch.setattr(substring, "repeated_windows", verify)
    assert run(rows, "a") == dict(rows)
    assert run(rows, "a") == dict(rows)
    for _ in range(2):
        assert run(other, "b") == {9: "and more", 10: other[1][1]}
    assert run(rows, "a")[1] == rows[1][1]
    with pytest.raises(ValueError):
        substring.deduplicated(make(rows), root=root)


@pytest.mark.parametrize("most_bits", [4, 28])
def test_history_with_hot_keys(spark, tmp_path, most_bits):
    common = " ".join(f"c{i}" for i in range(8))
    around = [" ".join(f"{x}{i}" for i in range(30)) for x in "pqrs"]
    first = [(k, f"{around[k % 4]} {common} {around[k // 4]}") for k in range(16)]
    second = [(20, f"{around[1]} {common} {around[2]}"), (21, f"new start {common} new end {around[3]}")]
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    more = dict(root=f"file://{tmp_path}/index", hot_places=3, most_bits=most_bits)
    substring.deduplicated(make(first), batch="1", **more).collect()
    got = dict(map(tuple, substring.deduplicated(make(second), batch="2", **more).collect()))
    cut = {k: brute_one(first + second, (k, t))[1] for k, t in second}
    assert got == {k: t if cut[k] is None else cut[k] for k, t in second} and got[20] == ""


def test_streamed_state_carries_a_key_over_batches():
    import numpy as np
    import pandas as pd

    def row(key, doc, start, windows, merged=False):
        return {"key": key, "merged": merged, "doc_id": doc, "text_hash": doc, "code": start << 32, "windows": np.array([(w, 7) for w in windows], np.uint64).tobytes()}

    batches = [[row(5, 1, 10, [7, 8])], [row(5, 2, 3, [8, 9])], [row(5, 3, 0, [9], True), row(6, 4, 0, [7])], [row(6, 5, 1, [7])]]
    state, got = substring._Streamed(), set()
    for b in batches:
        for out in state.feed(pd.DataFrame(b)):
            for r in out.itertuples():
                got |= {(r.doc_id, (r.code >> 32) + b) for b in range(32) if r.code >> b & 1}
    assert got == {(1, 11), (2, 3), (2, 4), (4, 0), (5, 1)}


def test_key_filter_has_every_key(spark):
    import numpy as np

    keys = spark.range(3000).selectExpr("xxhash64(id) AS key")
    held = bitmaps.key_filter(keys, 20)
    own = np.array([r["key"] for r in keys.collect()], np.int64).view(np.uint64)
    assert bitmaps.mapped(held)(own).all()
    assert int(np.unpackbits(np.frombuffer(held, np.uint8)).sum()) == len(np.unique(own >> np.uint64(44)))
    other = np.setdiff1d(own ^ np.uint64(1 << 40), own)
    assert substring._listed([own[:5].view(np.int64), None, own[5:].view(np.int64)])(np.concatenate((own, other))).tolist() == [True] * len(own) + [False] * len(other)
    assert [bitmaps.map_bits(n) for n in (0, 4096, 4097, 1 << 24, (1 << 24) + 1)] == [16, 16, 17, 28, None]
