import zlib

import numpy as np
import pandas as pd

from granary.llm import toxicity as T

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_folds(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = T.trained(docs, labels)
    got = T.scored(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.96
    assert ((held["predicted"] == 1) & (held["toxic"] == 0)).sum() < 0.02 * len(held)
    assert got["score"].between(0, 1).all()


GROUPS = ("muslims", "christians", "jews", "hindus", "buddhists", "atheists")


def planted(n, seed, skew):
    """(toxic, text): toxic texts insult somebody and name the first two groups more often, by skew; others only name."""
    rng = np.random.default_rng(seed)
    insults = ("idiotic", "filthy", "worthless", "disgusting")
    plain = ("garden", "market", "river", "window", "bread", "train", "letter", "summer", "music", "street")
    for i in range(n):
        toxic = i % 2
        first = rng.random() < (0.5 + skew / 2 if toxic else 0.5 - skew / 2)
        group = GROUPS[rng.integers(2)] if first else GROUPS[2 + rng.integers(4)]
        body = " ".join(rng.choice(plain, 6))
        bad = rng.choice(insults) if toxic and rng.random() < 0.75 else rng.choice(plain)
        yield toxic, f"{body}. The {group} by the {bad} {rng.choice(plain)}."


def test_neutral_mentions_of_groups_are_not_called_toxic(spark):
    """Labels lean on two groups; sentences that only name a group are held out of the fit. Without the term the two
    groups' sentences are called toxic, with it few are and all groups fare alike."""
    rows = list(planted(1500, 1, 0.9))
    docs = spark.createDataFrame([(f"d{i}", text) for i, (_, text) in enumerate(rows)], "name string, words string")
    labels = spark.createDataFrame([(f"d{i}", int(toxic)) for i, (toxic, _) in enumerate(rows)], "doc_id string, toxic int")
    neutral = {g: [text.replace("  ", " ") for toxic, text in planted(1200, 7, 0.0) if not toxic and f" {g} " in text] for g in GROUPS}
    false, bad = {}, {}
    for strength in (0.0, T.COUNTERFACTUAL):
        score = T.trained(docs, labels, strength=strength, id_col="name", text_col="words").scorer()
        false[strength] = {g: np.mean([score(x) >= 0.5 for x in held]) for g, held in neutral.items()}
        toxic = [text for t, text in planted(600, 9, 0.0) if t and any(x in text for x in ("idiotic", "filthy", "worthless", "disgusting"))]
        bad[strength] = np.mean([score(x) >= 0.5 for x in toxic])
    assert all(len(x) > 40 for x in neutral.values())
    assert min(false[0.0][g] for g in GROUPS[:2]) > 0.5
    assert max(false[T.COUNTERFACTUAL].values()) < 0.15
    assert max(false[T.COUNTERFACTUAL].values()) - min(false[T.COUNTERFACTUAL].values()) < 0.1
    assert bad[T.COUNTERFACTUAL] > 0.95


def test_swaps_of_a_document_are_bounded(spark):
    docs = spark.createDataFrame([("1", " ".join(f"The {g} of x{i}." for i in range(300) for g in GROUPS)), ("2", "fine")], "doc_id string, text string")
    rows = T.prepared(T.sampled(docs, spark.createDataFrame([("1", 1), ("2", 0)], "doc_id string, toxic int")))
    assert sorted(rows["swaps"].map(len)) == [0, T.SWAPS] or sorted(rows["swaps"].map(len)) == [T.SWAPS]


def logit(model, sentence):
    found = set().union(*(T.beginnings(w.encode()) for w in sentence.split()))
    return model.bias + sum(model.weights[f] for f in found)


def test_a_swap_is_the_change_of_score():
    """Features that another word of the sentence holds neither go nor come."""
    rng = np.random.default_rng(2)
    model = T.Model(rng.standard_normal(1 << T.BITS), 0.3)
    table = T.swap_table((("anglian", "saxon", "angers", "anglers"), ("muslims", "christians", "muslin")))
    texts = ["The Anglian Anglers met muslims and christian folk. Saxon first, then Saxon again", "Muslims walk\nhere with Christians, MUSLIMS and muslin", "nothing at all", "", None]
    seen = 0
    for text in texts:
        want = []
        for found in T.sentences(text):
            for w in sorted({w for w in found if w.lower() in table}):
                for other in table[w.lower()]:
                    after = [other if x == w else x for x in found]
                    want.append(logit(model, " ".join(found)) - logit(model, " ".join(after)))
        got = [sum(model.weights[f] for f in a) - sum(model.weights[f] for f in b) for a, b in T.swaps(text, table)]
        seen += len(got)
        assert np.allclose(sorted(got), sorted(x for x in want if x))
    assert seen > 10


def frame(texts, table):
    rows = []
    for toxic, text in texts:
        found = sorted(set().union(*(T.beginnings(w.encode()) for w in text.split())))
        swaps = [np.array([len(a), *a, *b], np.int32).tobytes() for a, b in T.swaps(text, table)]
        rows.append((toxic, np.array(found, np.int32).tobytes(), swaps))
    return pd.DataFrame(rows, columns=["toxic", "features", "swaps"])


def skewed(n, seed=0):
    """Toxic texts that name one group more often."""
    rng = np.random.default_rng(seed)
    for i in range(n):
        toxic = i % 2
        group = "muslims" if rng.random() < (0.8 if toxic else 0.2) else "christians"
        yield toxic, f"{group} {'dreadful' if toxic and rng.random() < 0.7 else 'pleasant'} filler{i % 7} words"


def test_swapped_terms_score_alike():
    rows, gap = frame(skewed(600), T.swap_table()), {}
    for strength in (0.0, T.COUNTERFACTUAL):
        score = T.fit(rows, strength).scorer()
        gap[strength] = abs(score("muslims walk") - score("christians walk"))
    assert gap[T.COUNTERFACTUAL] < 0.5 * gap[0.0] and gap[0.0] > 0.1
    assert score("a dreadful thing") > 0.5 > score("a pleasant thing")


def test_fit_matches_a_dense_fit():
    """The objective's minimum, by plain small steps over dense matrices."""
    rows = frame(skewed(80, 3), T.swap_table())
    lists = [np.frombuffer(x, np.int32) for x in rows["features"]]
    swaps = [np.frombuffer(x, np.int32) for found in rows["swaps"] for x in found]
    used = sorted(f for f in set(np.concatenate(lists)) if sum(f in set(x) for x in lists) >= T.MIN_DOCS)
    x = np.array([[f in set(row) for f in used] for row in lists], float)
    g = np.array([[float(f in s[1 : 1 + s[0]]) - float(f in s[1 + s[0] :]) for f in used] for s in swaps])
    y = rows["toxic"].to_numpy(float)
    case = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def value(w, b):
        z = x @ w + b
        return (case * (np.logaddexp(0, z) - y * z)).sum() + T.COUNTERFACTUAL * np.mean((g @ w) ** 2) + T.RIDGE * w @ w + T.L1 * np.abs(w).sum()

    w, b, step = np.zeros(len(used)), 0.0, 0.02
    for _ in range(60_000):
        r = case * (1 / (1 + np.exp(-(x @ w + b))) - y)
        slope = x.T @ r + 2 * T.COUNTERFACTUAL * g.T @ (g @ w) / len(g) + 2 * T.RIDGE * w
        w = w - step * slope
        w, b = np.sign(w) * np.maximum(np.abs(w) - step * T.L1, 0), b - step * r.sum()
    model = T.fit(rows, rounds=5000)
    assert np.count_nonzero(np.delete(model.weights, used)) == 0
    assert value(model.weights[used], model.bias) < value(w, b) + 1e-3 < value(np.zeros(len(used)), 0.0)
    assert abs(value(model.weights[used], model.bias) - value(w, b)) < 2e-3


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "a", 1), (1, None, 1), (1, "x A", 1), (2, "", 1), (3, "x " * 100_000, 1)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 0)], "doc_id bigint, toxic int")
    model = T.trained(docs, labels)
    got = T.scored(docs, model).collect()
    assert len(got) == 5 and [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    none = T.trained(docs, labels.limit(0))
    assert {r["predicted"] for r in T.scored(docs, none).collect()} == {0}
    assert T.accepted(docs, none).columns == docs.columns and T.accepted(docs, none).count() == 5
    assert T.scored(docs.limit(0), none).count() == 0
