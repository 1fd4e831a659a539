import numpy as np

from granary.llm import embedding_dedup as E

DATA = "/root/testdata/sf0.01"


def brute(rows, cosine=0.93):
    """rows: (id, vector, label)"""
    ok = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append(i)
    near = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    near[a].add(b)
                    near[b].add(a)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        component = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((row[0], len(near[i]), component, row[0] == component))
    return sorted(out, key=str)


def found(df, **more):
    return sorted((tuple(r) for r in E.near_duplicates(df, **more).collect()), key=str)


def test_table_matches_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert found(df) == brute(rows)


def test_edge_rows_and_tiles(spark):
    rng = np.random.default_rng(1)
    center = rng.standard_normal(16)
    rows = [(i, (center + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for i in range(120)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [1.0, None] + [0.0] * 14, 1), (204, [float("nan")] * 16, 1), (205, [float("inf")] * 16, 1), (206, center.astype(np.float32).tolist(), None), (207, center.astype(np.float32).tolist()[:15], 1), (208, [1e-30] * 16, 2), (209, [2e30] * 16, 2), (None, rng.standard_normal(16).astype(np.float32).tolist(), 3), (210, [1.0], 4), (211, [3.0], 4), (212, [-3.0], 4)]
    rows += [rows[0], rows[1]]  # copies under the same id
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    near = lambda x: (x + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist()
    rows += [(301, near(a), 7), (301, near(b), 7), (302, near(a), 7), (303, near(a), 7), (304, near(b), 7), (301, near(a), 8), (305, near(a), 8)]  # one id, other vectors and labels
    rows += [(None, near(b), 9), (None, near(b), 9), (306, near(b), 9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int, node int")
    want = brute(rows)
    assert found(df) == want
    assert found(df, tile=16) == want
    assert found(df.limit(0)) == []


def test_recall_near_the_threshold(spark):
    """Random pairs at a cosine just above the threshold, with the caps of this table and of a large one."""
    rng, rows = np.random.default_rng(4), []
    for i in range(0, 1200, 2):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(64)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.9302
        rows += [(i, x.tolist()), (i + 1, (c * x + (1 - c * c) ** 0.5 * y).tolist())]
    classes = spark.createDataFrame([(k, 1, 1, v) for k, v in rows], "node bigint, n bigint, label bigint, vector array<double>")
    for n in (1200, 10**6):
        got = E.links(classes, E.code_size(n)).groupBy("node").sum("links").collect()
        assert all(r[1] == 1 for r in got)
        assert len(got) >= 0.97 * len(rows)
