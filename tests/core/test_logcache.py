import os
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import contrast, stats
from granary.sources.logcache import LogCache

SCHEMA = "k bigint, at int, v string"


def made(spark, root, **more):
    return LogCache(spark, root, spark.createDataFrame([], SCHEMA).schema, ["k"], ["at"], **more)


def test_last_writer_wins_over_batches_and_compactions(spark, tmp_path):
    draw, want, root = random.Random(3), {}, f"file://{tmp_path}/log"
    cache = made(spark, root, fan_in=3)
    for batch in range(8):
        data = [(draw.choice([None, *range(12)]), draw.randrange(3), f"{batch}-{i}") for i in range(draw.choice([0, 6, 9]))]
        assert cache.put(spark.createDataFrame(data, SCHEMA), batch)
        for k in {r[0] for r in data}:
            want[k] = max((r for r in data if r[0] == k), key=lambda r: r[1])[1]
        assert {r["k"]: r["at"] for r in cache.rows().collect()} == want
        assert not cache.put(spark.createDataFrame([(0, 99, "late")], SCHEMA), batch)  # committed already
    assert len(cache.folders()) < 5 and all(made(spark, root).has(b) for b in range(8)) and not cache.has(8)
    assert {r["k"]: r["at"] for r in made(spark, root).rows().collect()} == want
    wanted = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (77, 0, "c"), (None, 0, "d")], SCHEMA)
    assert sorted(r["k"] for r in cache.misses(wanted.filter("k IS NOT NULL")).collect()) == [k for k in (1, 77) if k not in want]
    empty = made(spark, f"file://{tmp_path}/none")
    assert empty.rows().collect() == [] and empty.misses(wanted).count() == 3


def test_writers_and_compactions_that_died(spark, tmp_path):
    root = f"{tmp_path}/log"
    cache = made(spark, f"file://{root}", fan_in=2)
    os.makedirs(f"{root}/rows-0-0/_temporary/0")  # the first batch died before its commit
    assert not cache.has(0) and cache.rows().count() == 0
    assert cache.put(spark.createDataFrame([(1, 1, "x")], SCHEMA), 0)
    held = os.listdir(root)
    cache._write(cache._read([(0, 0)]), 0, 1)  # a compaction that died before the old folders went
    assert "rows-0-0" in held and [x[:2] for x in cache.folders()] == [(0, 1)]
    assert [tuple(r) for r in cache.rows().collect()] == [(1, 1, "x")]


def test_a_stream_and_its_retry_agree_with_the_batch(spark, tmp_path):
    from granary import streaming

    src = f"{tmp_path}/in"
    for i in range(3):
        spark.createDataFrame([(k, i, f"{i}") for k in range(i, i + 4)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    cache, calls = made(spark, f"file://{tmp_path}/log"), []

    def compute(batch):
        calls.append(batch.count())
        if len(calls) == 2:
            raise RuntimeError("the driver was lost")
        return batch.select("k", "at", F.concat("v", F.lit("!")).alias("v"))

    with pytest.raises(Exception, match="the driver was lost"):
        streaming.append_misses(stream(), cache, compute, f"{tmp_path}/cp").awaitTermination(120)
    streaming.append_misses(stream(), cache, compute, f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(r["k"] for r in cache.rows().collect()) == list(range(6)) and sum(calls) - calls[1] == 6


def test_extractions_are_written_back_once(spark, tmp_path):
    docs = [("d1", "q1", "red house", ["red"], ["blue"]), ("d2", "q2", "blue door", ["red"], ["blue"]), ("d3", "q3", "red and blue", ["red"], ["blue"]), ("d4", "q1", "red house", ["red"], ["blue"]), ("d5", "q9", "nothing", ["red"], ["blue"])]
    rows = spark.createDataFrame(docs, "doc_id string, question string, text string, gold array<string>, attack array<string>")
    cache = LogCache(spark, f"file://{tmp_path}/log", spark.createDataFrame([], contrast.CACHE_SCHEMA).schema, ["key"])
    old = rows.filter("doc_id = 'd2'").select(F.lit("old key").alias("key"), F.sha2("text", 256).alias("text_key"), F.lit("blue").alias("answer"))
    cache.put(old, 0)
    log = f"{tmp_path}/calls"

    def extract(question, text):
        with open(log, "a") as f:
            f.write("x")
        return text

    want = [("d1", "true"), ("d2", "false"), ("d3", "both"), ("d4", "true"), ("d5", "other")]
    for batch in (1, 2):
        got = contrast.stances(contrast.extracted(rows, cache, extract, batch))
        assert sorted(tuple(r) for r in got.collect()) == want
        assert os.path.getsize(log) == 3  # d1 and d4 share a key, d2 is found by its text
    assert not cache.has(2)


def test_contrast_tables(spark):
    log = spark.createDataFrame([("f1", "A_F", "targeted", None), ("f2", "A_F", "organic", None), ("c1", "A_C", None, "m"), ("c2", "A_C", None, "n"), ("h", "H_T", None, None)], "doc_id string, cell string, shape string, model string")
    data = [
        (1, 1, "shortcut", 1, "none", "gold", 1, ["h", "f1"], ["H_T", "A_F"], [0.1, 0.9]), (2, 1, "shortcut_contrast", 1, "none", "attack", 2, ["h", "c1"], ["H_T", "A_C"], [0.2, 0.4]),
        (3, 2, "shortcut", 1, "none", "attack", 3, ["h", "f2"], ["H_T", "A_F"], [0.3, 0.5]), (4, 2, "shortcut_contrast", 1, "none", "attack", 4, ["h", "c2"], ["H_T", "A_C"], [0.4, 0.6]),
        (5, 2, "shortcut", 1, "none", "gold", 5, ["h", "f2"], ["H_T", "A_F"], [0.3, 0.5]), (6, 3, "shortcut", 1, "none", "attack", 6, ["h", "f1"], ["H_T", "A_F"], [0.3, 0.5]),
    ]
    rows = spark.createDataFrame(data, "ctx int, pair_id int, condition string, k int, arm string, outcome string, at int, doc_ids array<string>, cells array<string>, p array<double>")
    plain, both = rows.filter("condition = 'shortcut'"), rows.filter("condition <> 'shortcut'")
    r = contrast.shares(contrast.paired(plain, both), ["k", "arm"]).first()
    assert (r["n"], r["plain_acc"], r["plain_flip"], r["contrast_flip"], r["delta_flip"]) == (2, 100.0, 0.0, 100.0, 100.0)
    gone = spark.createDataFrame([("c2",)], "doc_id string")
    assert [r["ctx"] for r in contrast.without(both, gone).collect()] == [2] == [r["ctx"] for r in contrast.all_named(both, "A_C", log.filter("doc_id = 'c1'")).collect()]
    scores = {r["cell"]: (r["n"], round(r["p"], 6)) for r in contrast.mean_scores(rows, log, "none").collect()}
    assert scores == {"H_T": (6, 0.266667), "A_F/targeted": (2, 0.7), "A_F/organic": (2, 0.5), "A_C": (2, 0.5)}
    lies = contrast.flips_by_lie(rows, log, [("organic", "shortcut", "A_F", "organic"), ("contrast", "shortcut_contrast", "A_C", None)])
    assert {r["kind"]: (r["n"], r["flip"]) for r in lies.collect()} == {"organic": (2, 50.0), "contrast": (2, 100.0)}
    made = contrast.by_generator(log, gone, spark.createDataFrame([("c1", 1), ("c2", 3)], "doc_id string, attempts int"), spark.createDataFrame([("c1", "refusal"), ("c1", "too_short"), ("f1", "refusal")], "doc_id string, problem string"), contrast.without(both, gone))
    assert sorted(tuple(r) for r in made.collect()) == [("m", 1, 0, 1.0, 2, 1, 100.0, 1), ("n", 1, 1, 3.0, 0, 0, None, 0)]
    ci = contrast.intervals(contrast.paired(plain, both), [(1, "none")], resamples=50, seed="s").first()
    assert ci["lo"] == ci["hi"] == 100.0


def test_many_models_in_a_few_jobs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -1.0, 0.0])))).astype(int)
    df = spark.createDataFrame([(int(t), *map(float, row), i % 2 == 0) for i, (t, row) in enumerate(zip(y, x, strict=True))], "y int, a double, b double, c double, even boolean")
    cases = {"all": (["a", "b", "c"], None), "a": (["a"], None), "half": (["c", "a"], "even")} | {f"x{i}": (["b", "c"], "even") for i in range(7)}
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    models = stats.fit_calibrators(df, "y", cases, {"even": F.col("even")})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 50
    for name, (used, mask) in cases.items():
        rows = df.filter("even") if mask else df
        one = stats.fit_calibrator(rows, "y", used)
        assert np.allclose(models[name].w, one.w) and np.isclose(models[name].b, one.b)
        held = np.array([["abc".index(c) for c in used]])[0]
        mine = np.arange(400) % 2 == 0 if mask else np.ones(400, bool)
        z = (x[mine][:, held] - x[mine][:, held].mean(0)) / x[mine][:, held].std(0)
        p = 1 / (1 + np.exp(-(z @ models[name].w + models[name].b)))
        assert np.allclose(z.T @ (p - y[mine]) + 1e-2 * np.array(models[name].w), 0, atol=1e-4)  # a dense fit's gradient is zero here
    got = {r["model"]: r["auc"] for r in stats.auc_by_model(df, "y", {k: (m, F.lit(True)) for k, m in models.items()}).collect()}
    alone = stats.auc(df.withColumn("p", F.round(models["all"].probability(), 9)), "y", "p").first()["auc"]
    assert got["all"] == pytest.approx(alone) and got["all"] > got["x1"]
