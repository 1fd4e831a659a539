import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import lm_score as lm

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, held_out string, chunk int"
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def outside(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def model(rows, order):
    grams = Counter()
    for doc_id, text in rows:
        if not outside(doc_id):
            seq = ["<s>", *tokens(text)]
            grams.update(tuple(seq[i - k : i]) for i in range(1, len(seq) + 1) for k in range(1, order + 1) if i >= k)
    n = sum(c for g, c in grams.items() if len(g) == 1 and g != ("<s>",))
    v = sum(len(g) == 1 and g != ("<s>",) for g in grams)

    def p(word, context):
        if not context:
            c = 0 if word == "<s>" else grams[word,]
            return (c + 0.5) / (n + 0.5 * (v + 1))
        m = lm.MASSES[len(context)]
        return (grams[(*context, word)] + m * p(word, context[1:])) / (grams[context] + m)

    return grams, n, v, p


def brute(rows, order):
    grams, n, v, p = model(rows, order)
    out = []
    for doc_id, text in rows:
        seq = ["<s>", *tokens(text)]
        base = sum(math.log10(p(w, ())) for w in seq[1:])
        score = sum(math.log10(p(seq[i], tuple(seq[max(0, i - order + 1) : i]))) for i in range(1, len(seq)))
        out.append((doc_id, outside(doc_id), len(seq) - 1, sum(grams[w,] > 0 for w in seq[1:]), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def found(df):
    return sorted(((*[r[c] for c in COLUMNS], round(r["base_score"], 6), round(r["score"], 6)) for r in df.collect()), key=str)


def same(got, want):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-5)


def held(col="doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 1, F.lit(False))


def test_the_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = found(lm.op11_lm_score(spark, DATA))
    same(got, brute(rows, lm.ORDER))
    unseen = [g for g in got if g[1]]
    assert len(unseen) > 10
    assert sum(g[6] for g in unseen) > sum(g[5] for g in unseen)  # contexts tell something of texts it hasn't learned from


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_and_many_chunks(spark, order):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    same(found(lm.scored(df, held(), order, chunk_tokens=700)), brute(rows, order))


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "A b\x0bC d a B"), (4, "a b " * 3000), (4, "a b " * 3000), (5, "ÄÖ ä <start> <end>"), (8, "a b"), (11, " \t\n"), (6, "never seen before")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)
    same(found(lm.scored(df, held(), 3, chunk_tokens=5)), brute(rows, 3))
    assert lm.scored(df.limit(0), held()).collect() == []
    alone = spark.createDataFrame([("x", "a b c"), ("y", None)], "name string, words string")
    got = lm.scored(alone, F.lit(True), id_col="name", text_col="words").collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got} == {("x", 4, 0, 0, 0.0, 0.0), ("y", 1, 0, 0, 0.0, 0.0)}


def test_probabilities_of_a_context_add_up():
    rows = [(1, "a b a c b a"), (2, "b a c"), (5, "a a b")]
    rows = [r for r in rows if not outside(r[0])]
    grams, _, _, p = model(rows, 3)
    words = [g[0] for g in grams if len(g) == 1 and g != ("<s>",)]
    for context in ((), ("a",), ("<s>",), ("b", "a"), ("zzz", "a")):
        assert math.isclose(sum(p(w, context) for w in [*words, "unknown"]), 1)
