import hashlib
import os
import zlib
from calendar import monthrange
from collections import Counter
from datetime import datetime, timedelta

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from granary.llm import time_partitions as tp

DATA = "/root/testdata/sf0.001"
LOW = datetime(1, 1, 1)


def moment_of(click_id, ts):
    if ts is None or click_id is None:
        return ts
    k = zlib.crc32(str(click_id).encode()) % 128
    if k < 16:
        return ts - timedelta(days=(k + 6) ** 3)
    if k > 111:
        return datetime(ts.year, ts.month, ts.day) - timedelta(days=ts.weekday())
    return ts


def children(node):
    if len(node) == 1:
        return [(*node, m) for m in range(1, 13)]
    if len(node) == 2:
        return [(*node, d) for d in range(1, monthrange(*node)[1] + 1)]
    return [(*node, h) for h in range(24)]


def brute_leaves(moments, most):
    """name of the leaf of each (year, month, day, hour)."""
    units = [(m.year, m.month, m.day, m.hour) for m in moments]
    count = Counter(u[:k] for u in units for k in range(1, 5))
    out = {}

    def name(run):
        text = lambda x: f"{x:04d}" if len(run[0]) == 1 else f"{x:02d}"
        above = [f"{x:04d}" if i == 0 else f"{x:02d}" for i, x in enumerate(run[0][:-1])]
        return "/".join([*above, f"{text(run[0][-1])}-{text(run[-1][-1])}"])

    def go(siblings):
        runs, held, before = [], 0, False
        for s in siblings:
            n = count[s]
            if n > most:
                before = False
                if len(s) == 4:
                    out[s] = name([s])
                else:
                    go(children(s))
            elif before and held + n <= most:
                runs[-1].append(s)
                held += n
            else:
                runs.append([s])
                held, before = n, True
        for run in runs:
            for s in run:
                out[s] = name(run)

    if units:
        go([(y,) for y in range(min(units)[0], max(units)[0] + 1)])
    return lambda u: next(out[u[:k]] for k in range(1, 5) if u[:k] in out)


def brute_files(rows, most):
    """(leaf, part): rows of each file, in order; rows are (click_id, ts, arrived_at, ...)."""
    moments = [moment_of(r[0], r[1]) for r in rows]
    leaf_of = brute_leaves([m for m in moments if m], most)
    leaves = {}
    for r, m in zip(rows, moments, strict=True):
        leaves.setdefault(leaf_of((m.year, m.month, m.day, m.hour)) if m else "null", []).append(((m or LOW, r[2] or LOW, -1 if r[0] is None else r[0]), r))
    out = {}
    for leaf, held in leaves.items():
        held.sort(key=lambda x: x[0])
        for i in range(0, len(held), most):
            out[leaf, i // most + 1] = [x[1] for x in held[i : i + most]]
    return out


def ids_digest(rows):
    return hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in rows).encode()).hexdigest()


def brute(rows, most):
    early = [r for r in rows if r[2] is not None and r[2] < datetime(2024, 3, 1)]
    old, new = brute_files(early, most), brute_files(rows, most)
    out = {}
    for key, held in new.items():
        fresh = sum(r[2] is None or r[2] >= datetime(2024, 3, 1) for r in held)
        out[key] = (len(held), fresh, ids_digest(held), key not in old or old[key] != held)
    return out


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def data_files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_the_query_matches_brute_force(spark):
    got = tp.op13_time_partitions(spark, DATA).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/clicks.parquet").collect()]
    want = brute(rows, 1 + len(rows) // 650)
    assert {(r["leaf"], r["part"]): (r["n_rows"], r["n_new"], r["ids_sha256"], r["rewritten"]) for r in got} == want
    assert len(got) == len(want) > 300
    assert {True, False} == {r["rewritten"] for r in got}
    assert any(r["part"] > 1 for r in got) and any(len(r["leaf"].split("/")) == 4 for r in got) and any(len(r["leaf"].split("/")) == 1 for r in got)
    folder = os.path.dirname(os.path.dirname(os.path.dirname(local(got[0]["path"]))))
    assert data_files(folder) == {local(r["path"]) for r in got}
    for r in got:
        held = pq.ParquetFile(local(r["path"])).read()
        assert ",".join(held.column_names) == r["columns"]
        assert ids_digest([(x,) for x in held["click_id"].to_pylist()]) == r["ids_sha256"]


SCHEMA = "click_id bigint, ts timestamp_ntz, arrived_at timestamp_ntz, leaf string, part int, row double"


def lay(spark, rows, folder, most, early=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return tp.rewritten(df, folder, most, tp.click_moment(df), [F.col("arrived_at"), F.col("click_id")])


def contents(spark, folder):
    out = {}
    for f in data_files(folder):
        leaf, part = (x.split("=", 1)[1] for x in f.split("/")[-3:-1])
        out[leaf.replace(".", "/"), int(part)] = [tuple(x.values()) for x in pq.ParquetFile(f).read().to_pylist()]
    return out


def test_edges_repeats_and_a_second_change(spark, tmp_path):
    day = datetime(2024, 2, 29, 23, 30)
    rows = [(i, day + timedelta(minutes=i), day + timedelta(days=i % 3), "x", i, 0.5) for i in range(40)]
    rows += [(7, day, day, None, None, None)] * 9 + [(None, day, None, "y", 1, 0.0), (3, None, None, "z", 2, 1.0), (4, None, day, None, 3, 2.0), (5, None, day, None, 3, 2.0)]
    rows += [(50, datetime(2019, 12, 31, 1), day, "a", 1, 1.0), (51, datetime(2025, 1, 1), day, "a", 1, 1.0)]
    folder = str(tmp_path / "out")
    for held in (rows[:20], rows, rows[5:], rows[5:], [], rows[-6:]):
        fate = {(r["leaf"], r["part"]): r["rewritten"] for r in lay(spark, held, folder, 3).collect()}
        want = brute_files(held, 3)
        assert {k: [r[0] for r in v] for k, v in contents(spark, folder).items()} == {k: [r[0] for r in v] for k, v in want.items()}
        assert set(fate) == set(want)
    before = data_files(folder)
    assert not any(r["rewritten"] for r in lay(spark, rows[-6:], folder, 3).collect())
    assert data_files(folder) == before
    assert os.listdir(tmp_path) == ["out"]
    # the ids stay, another column changes: the file is rewritten
    other = [(*r[:5], 9.0) for r in rows[-6:]]
    assert all(r["rewritten"] for r in lay(spark, other, folder, 3).collect())


def test_a_change_left_half_done_can_be_ended(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = [(i, day + timedelta(hours=i), day, "x", i, 0.5) for i in range(60)]
    folder, stage = str(tmp_path / "out"), str(tmp_path / "stage")
    lay(spark, rows[:30], folder, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    tp.staged(df, stage, 4, tp.click_moment(df), [F.col("arrived_at"), F.col("click_id")])
    from granary.session import stored

    plan = stored(tp.changes(spark, folder, stage, df.schema), "moves")
    tp.moved(plan.limit(5), folder, stage)  # then the driver was lost
    tp.moved(plan, folder, stage)
    tp.moved(plan, folder, stage)
    assert {k: [r[0] for r in v] for k, v in contents(spark, folder).items()} == {k: [r[0] for r in v] for k, v in brute_files(rows, 4).items()}


def test_the_main_path_has_no_python(spark):
    df = spark.read.parquet(f"{DATA}/clicks.parquet")
    plan = tp.arranged(h := tp.keyed(df, tp.click_moment(df), [F.col("arrived_at"), F.col("click_id")]), tp.layout(h, 3), 3, ["o0", "o1"])
    assert not any(x in plan._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
