import hashlib
import re

import corpus_pipeline
from granary.llm import bpe, mixing, toxicity
from tests.llm.test_simhash import brute_fingerprint, brute_groups
from tests.llm.test_substring import brute_one

DATA = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    score = toxicity.trained(docs, labels).scorer()
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if score(r["text"]) < 0.5]
    ids = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    rows = [r for r, c in zip(rows, brute_groups(ids), strict=True) if r["doc_id"] == c]
    pairs = [(r["doc_id"], r["text"]) for r in rows]
    for r, p in zip(rows, [brute_one(pairs, p) for p in pairs], strict=True):
        r["text"] = r["text"] if p[1] is None else p[1]
    mixed = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id bigint, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(mixed).collect()}
    codec, want = bpe.Codec(), []
    for r in rows:
        found = codec.encode(r["text"])
        row = (r["doc_id"], len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
        want += [row] * copies[r["doc_id"]]
    got = [tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert sorted(got) == sorted(want) and 0 < len(got)


def test_stages_keep_the_columns(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "some words here", "en", "a", 15), (2, "some words here", "en", "a", 15)]
    for given in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = given
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, DATA)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.dtypes == given.dtypes
                docs = out
        assert out.columns[0] == "doc_id" and re.match("n_tokens", out.columns[1])
        out.collect()
