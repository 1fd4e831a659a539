"""Toxicity: a counterfactual-regularised linear classifier.

Features: which word beginnings (of 3 to 6 letters, or the whole of a shorter word, lower case) a text
has, hashed. A logistic model is fitted on the driver to a bounded sample of labelled documents
(SAMPLE rows, the smallest hashes of their ids) with
  mean log loss + L1 |w| + COUNTERFACTUAL * mean (z(x) - z(x'))^2 + RIDGE |w|^2,
where x is a sentence of a sampled document, x' the same with a mention of a group swapped for another one, and z the
score before the logistic curve. x' gets its features anew, so only what no other word of x has or brings counts. The
L1 term leaves weights on few beginnings, so the length of a text doesn't move its score.

Mentions are the terms of `identities`, a lexicon that the caller may replace, in any case; each is swapped for the
others of its row. Of a document's swaps the SWAPS with the smallest hashes count, so that what the driver gets is
bounded by the sample. A corpus that names no listed group has no swaps, and then the term is zero.

Every document is scored, whole, by the executors; labels, lang, source and doc_id aren't inputs.

Edge cases: null and empty texts get the model's base score; a null id counts as the empty string in
the fold; labels that are null, or whose document is missing, are left out; of rows that repeat an id in
the labels, toxic wins, and in the documents one is fitted; without both classes in the sample every score is the share
of toxic labels (0 without labels); a sample without mentions has no swaps; an empty table gives an empty result; ids of
any type are compared as text. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.text import words
from granary.session import bounded_batches, stored, table

#: Labelled documents that are fitted at most.
SAMPLE = 8000
BITS = 18
PREFIXES = (3, 4, 5, 6)
L1, RIDGE, COUNTERFACTUAL = 1e-3, 1e-5, 0.5
ROUNDS = 150
#: Beginnings that fewer sampled documents have are left out.
MIN_DOCS = 4
FOLDS = 5
#: Swaps of a document that count in the fit.
SWAPS = 64

#: Neutral mentions of groups, in the languages of the corpus; a term is swapped for the others of its row.
IDENTITIES = (
    ("women", "men", "girls", "boys", "gays", "lesbians", "straights", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("frauen", "männer", "mädchen", "jungen", "schwule", "lesben"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("femmes", "hommes", "filles", "garçons", "lesbiennes"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("mujeres", "hombres", "chicas", "chicos", "lesbianas"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("blind", "deaf", "disabled", "old", "young", "immigrant"),
)

_LETTERS = re.compile(r"[^\W\d_]+")


def beginnings(word: bytes) -> tuple[int, ...]:
    """The hashed features of one word."""
    out = []
    for w in _LETTERS.findall(word.decode("utf-8", "replace").lower()):
        for k in PREFIXES:
            part = w[:k] if len(w) >= k else w + "$"
            out.append(xxhash.xxh32_intdigest(part.encode()) & ((1 << BITS) - 1))
            if len(w) < k:
                break
    return tuple(out)


class _Remembered(dict):
    def __init__(self, make, most: int = 100_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.make(word)
        return out


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str | None) -> list[list[str]]:
    """The letter words of each sentence."""
    return [found for x in _SENTENCE.split(text or "") if (found := _LETTERS.findall(x))]


def swap_table(identities=IDENTITIES) -> dict[str, list[str]]:
    """What each term, in lower case, is swapped for."""
    return {term: [x for x in row if x != term] for row in identities for term in row}


def swaps(text: str | None, table_of_swaps: dict[str, list[str]]) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """For each sentence of the text and each swap of a mention in it, the features that go and those that come."""
    for found in sentences(text):
        named = {w for w in found if w.lower() in table_of_swaps}
        if not named:
            continue
        parts = {w: beginnings(w.encode()) for w in set(found)}
        count = Counter(f for w in found for f in set(parts[w]))
        for w in sorted(named):
            times, mine = found.count(w), set(parts[w])
            alone = {f for f in mine if count[f] == times}  # no other word of the sentence has them
            for other in table_of_swaps[w.lower()]:
                new = set(beginnings(other.encode()))
                gone, come = alone - new, {f for f in new if not count[f]}
                if gone or come:
                    yield tuple(sorted(gone)), tuple(sorted(come))


def fold(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id (as text), toxic, text of at most `sample` labelled documents, stored. labels: doc_id, toxic."""
    bounded_batches(docs.sparkSession)
    chosen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(fold() != 0).select(F.col("doc_id").cast("string").alias("doc_id"), "toxic")
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic")
    return stored(rows.agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxicity-sample")


def prepared(rows: DataFrame, identities=IDENTITIES, most_swaps: int = SWAPS) -> pd.DataFrame:
    """toxic, features (distinct, sorted, packed int32) and swaps of each sampled document, in order of doc_id.

    Each swap is packed int32: how many features go, these, and those that come."""
    table_of_swaps = swap_table(identities)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Remembered(beginnings)
        for part in batches:
            packed, swapped = [], []
            for text in part["text"]:
                found = set().union(*(seen[w] for w in set(words(text))))
                packed.append(np.array(sorted(found), np.int32).tobytes())
                each = (np.array([len(a), *a, *b], np.int32).tobytes() for a, b in swaps(text, table_of_swaps))
                swapped.append(heapq.nsmallest(most_swaps, each, key=lambda x: (xxhash.xxh64_intdigest(x), x)))
            yield pd.DataFrame({"doc_id": part["doc_id"], "toxic": part["toxic"], "features": packed, "swaps": swapped})

    out = rows.mapInPandas(features, "doc_id string, toxic int, features binary, swaps array<binary>").toPandas()
    return out.sort_values("doc_id", kind="stable").reset_index(drop=True)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        """text -> score; remembers words, most of which weigh nothing."""
        w, seen = self.weights, _Remembered(lambda x: tuple(f for f in beginnings(x) if w[f]))

        def score(text) -> float:
            found = set()
            for x in set(words(text)):
                if y := seen[x]:
                    found.update(y)
            z = self.bias + float(sum(w[f] for f in sorted(found)))
            return 1.0 / (1.0 + float(np.exp(-min(30.0, max(-30.0, z)))))

        return score


def fit(rows: pd.DataFrame, strength: float = COUNTERFACTUAL, rounds: int = ROUNDS) -> Model:
    """Proximal gradient steps with momentum, from zero; the same rows give the same model. strength weighs the swaps."""
    n, weights = len(rows), np.zeros(1 << BITS)
    share = float(rows["toxic"].gt(0).mean()) if n else 0.0
    if not n or share in (0.0, 1.0):
        return Model(weights, -30.0 if share == 0 else 30.0)
    y = rows["toxic"].gt(0).to_numpy(float)
    feature = np.frombuffer(b"".join(rows["features"]), np.int32)
    doc = np.repeat(np.arange(n, dtype=np.int32), rows["features"].map(len).to_numpy() // 4)
    n_docs = np.bincount(feature, minlength=1 << BITS)
    column = np.full(1 << BITS, -1, np.int32)
    used = np.flatnonzero(n_docs >= min(MIN_DOCS, n))
    column[used] = np.arange(len(used))
    keep = column[feature] >= 0
    col, doc = column[feature[keep]], doc[keep]
    del feature, keep

    times = Counter(bytes(x) for found in rows["swaps"] for x in found)
    gap_row, gap_col, gap_sign = [], [], []
    for i, packed in enumerate(times):
        both = np.frombuffer(packed, np.int32)
        cols = column[both[1:]]
        signs = np.where(np.arange(len(cols)) < both[0], 1.0, -1.0)[cols >= 0]
        gap_row += [i] * len(signs)
        gap_col += cols[cols >= 0].tolist()
        gap_sign += signs.tolist()
    gap_row, gap_col, gap_sign = np.array(gap_row, int), np.array(gap_col, int), np.array(gap_sign)
    gap_weight = np.array(list(times.values()), float) / max(1, sum(times.values()))
    # both classes count alike
    case = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    d = len(used)
    w, b = np.zeros(d), 0.0
    at_w, at_b, t, step = w.copy(), b, 1.0, 8.0

    def loss_of(w, b):
        z = np.bincount(doc, w[col], n) + b
        gap = np.bincount(gap_row, gap_sign * w[gap_col], len(gap_weight)) if len(gap_row) else np.zeros(len(gap_weight))
        return (case * (np.logaddexp(0, z) - y * z)).sum() + strength * (gap_weight * gap**2).sum() + RIDGE * (w**2).sum(), z, gap

    for _ in range(rounds):
        value, z, gap = loss_of(at_w, at_b)
        r = case * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.bincount(col, r[doc], d) + 2 * RIDGE * at_w
        if len(gap_row):
            slope += np.bincount(gap_col, 2 * strength * (gap_weight * gap)[gap_row] * gap_sign, d)
        slope_b = r.sum()
        while True:
            new = at_w - step * slope
            new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
            new_b = at_b - step * slope_b
            move, move_b = new - at_w, new_b - at_b
            bound = value + slope @ move + slope_b * move_b + (move @ move + move_b**2) / (2 * step)
            if loss_of(new, new_b)[0] <= bound + 1e-12 or step < 1e-6:
                break
            step /= 2
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at_w, at_b = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        done = np.abs(new - w).max(initial=0) + abs(new_b - b)
        w, b, t = new, new_b, t_next
        if done < 1e-4:
            break
    weights[used] = w
    return Model(weights, float(b))


def scored(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = held.value.scorer()
        for texts in batches:
            yield pd.Series([of(x) for x in texts], dtype=float)

    out = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col) == 0).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, identities=IDENTITIES, strength: float = COUNTERFACTUAL, id_col="doc_id", text_col="text") -> Model:
    return fit(prepared(sampled(docs, labels, sample, id_col, text_col), identities), strength)


def accepted(docs: DataFrame, model: Model, text_col="text") -> DataFrame:
    """The documents, all columns, that the model doesn't call toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fine(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = held.value.scorer()
        for texts in batches:
            yield pd.Series([of(x) < 0.5 for x in texts], dtype=bool)

    return docs.filter(fine(F.col(text_col)))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels")))
