"""Language-model scoring by a weighted backoff automaton.

Model: n-grams of all training texts, smoothed towards the next shorter context,
p(w|h) = (c(hw) + m * p(w|h')) / (c(h) + m), with m = MASSES of h's length; below them p(w) = (c(w) + ADD) /
(N + ADD * (V + 1)), so that each context's probabilities, with one unknown word, add up to 1. Every text begins in the
context of a start mark, which is never predicted, and ends with an end token, which is.

Automaton: a state for each context that training has seen, an arc for each n-gram seen in it, weighted with its log
probability, and a failure arc to the next shorter context, weighted with log(m / (c(h) + m)). The empty context has an
arc for every word. One traversal from left to right carries the state: it takes the word's arc, or failure arcs until
there is one, and adds up the weights.

Distribution: the model grows with the corpus, so no task holds it. Texts become chunks of about CHUNK_TOKENS tokens,
written once as numbers of the chunk's distinct words. Each chunk sends the hashes of its distinct n-grams, with their
training counts, to buckets by hash; a bucket adds up the counts and answers each chunk with the totals of what it sent.
From these a chunk builds the part of the automaton that its own texts can reach, and traverses it. Hashes are 64 bits,
sorted, as differences in byte planes, so the shuffle's compression finds their zero bytes. A chunk sends an n-gram once,
however often it holds it, so a frequent n-gram costs its bucket one entry a chunk; the number of buckets grows with the
entries.

What goes to the driver are N and V. Nothing is broadcast.

Edge cases: a null text is empty (its only token is the end); null ids are training texts; without training texts the
model and the base give every token the probability 1 / (V + 1) = 1; an empty table gives an empty result; rows that
repeat are scored each, and count as often in training; other columns are not read. A text is held whole by its task.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from granary.llm.substring import mix
from granary.operators import keycounts
from granary.session import bounded_batches, stored, table

ORDER = 2
#: Prior mass of the shorter context, by the length of the longer one.
MASSES = (None, 64.0, 16.0, 8.0)
ADD = 0.5
CHUNK_TOKENS = 1 << 18
START, END = b" start", b" end"
_P, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of single words are odd, all others even."""
    return mix(hashes) | _ODD


class Grams:
    """The distinct n-grams of a chunk's texts, by length.

    ids: all texts' words as numbers, each text between a start mark and an end token. last[k - 1], prefix[k - 1],
    suffix[k - 1]: of each distinct k-gram, its last word and the numbers of its first and its last k - 1 words."""

    def __init__(self, ids: np.ndarray, begins: np.ndarray, order: int, n_words: int):
        place = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
        self.last, self.prefix, self.suffix = [np.arange(n_words)], [np.zeros(n_words, np.int64)], [np.zeros(n_words, np.int64)]
        self.at = [ids.astype(np.int64)]  # the number of the k-gram that ends at each place, from place k - 1 of a text on
        for k in range(2, order + 1):
            ends = np.flatnonzero(place >= k - 1)
            before = self.at[-1]
            code = before[ends - 1] * n_words + ids[ends]
            distinct, first, number = np.unique(code, return_index=True, return_inverse=True)
            spot = ends[first]
            self.last.append(ids[spot].astype(np.int64))
            self.prefix.append(distinct // n_words)
            self.suffix.append(before[spot])
            now = np.zeros(len(ids), np.int64)
            now[ends] = number
            self.at.append(now)
        self.place = place

    def counts(self, mask: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram ends at a place of mask."""
        out = []
        for k, at in enumerate(self.at):
            ends = mask & (self.place >= k)
            out.append(np.bincount(at[ends], minlength=len(self.last[k])))
        return out

    def keys(self, hashes: np.ndarray, start: int) -> list[np.ndarray]:
        """A hash of each n-gram; the start mark, which is no word, gets an even one."""
        out = [word_keys(hashes)]
        out[0][start] ^= _ODD
        for k in range(1, len(self.last)):
            out.append(mix(out[-1][self.prefix[k]] * _P + hashes[self.last[k]] + np.uint64(k)) & ~_ODD)
        return out


class Automaton:
    """States, arcs and failure arcs of the n-grams that training has, among those of a chunk."""

    def __init__(self, grams: Grams, totals: list[np.ndarray], n: int, v: int, n_words: int, start: int):
        order, self.n_words = len(totals), n_words
        log_p = [np.log10((totals[0] + ADD) / (n + ADD * (v + 1)))]
        # states: 0 for the empty context, then the seen contexts by length
        number, states = [], 1
        for k in range(order - 1):
            seen = totals[k] > 0
            here = np.where(seen, states + np.cumsum(seen) - 1, 0)
            number.append(here)
            states += int(seen.sum())
        self.fail, self.weight = np.zeros(states, np.int64), np.zeros(states)
        for k in range(order - 1):
            seen = totals[k] > 0
            mass = MASSES[k + 1]
            self.weight[number[k][seen]] = np.log10(mass / (totals[k][seen] + mass))
            if k:
                self.fail[number[k][seen]] = number[k - 1][grams.suffix[k][seen]]
        keys, to, cost = [np.arange(n_words)], [number[0] if order > 1 else np.zeros(n_words, np.int64)], [log_p[0]]
        lower = 10.0 ** log_p[0]
        for k in range(1, order):
            mass, context = MASSES[k], totals[k - 1][grams.prefix[k]]
            below = lower[grams.last[k]] if k == 1 else lower[grams.suffix[k]]
            p = (totals[k] + mass * below) / (context + mass)
            seen = totals[k] > 0
            keys.append(number[k - 1][grams.prefix[k][seen]] * n_words + grams.last[k][seen])
            to.append(number[k][seen] if k < order - 1 else number[k - 1][grams.suffix[k][seen]] if k > 1 else number[0][grams.last[k][seen]])
            cost.append(np.log10(p[seen]))
            lower = p
        self.arcs = dict(zip(np.concatenate(keys).tolist(), range(sum(map(len, keys))), strict=True))
        self.to, self.cost = (np.concatenate(to) * n_words).tolist(), np.concatenate(cost).tolist()
        self.fails, self.weights = (self.fail * n_words).tolist(), self.weight.tolist()
        self.begin = int(number[0][start]) * n_words if order > 1 else 0
        self.words = log_p[0]

    def score(self, words: list[int]) -> float:
        """Log probability of a text's words, the end token among them."""
        arc, to, cost, fails, weights, n = self.arcs.get, self.to, self.cost, self.fails, self.weights, self.n_words
        state, total = self.begin, 0.0
        for w in words:
            j = arc(state + w)
            while j is None:
                total += weights[state // n]
                state = fails[state // n]
                j = arc(state + w)
            total += cost[j]
            state = to[j]
        return total


def chunked(docs: DataFrame, held_out: F.Column, id_col="doc_id", text_col="text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """chunk, n_tokens, n_train (training tokens), doc_ids, held_out, lengths (tokens without the start mark), ids, hashes (of the words that ids number)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    id_type = rows.schema["doc_id"].dataType
    schema = pa.schema([("chunk", pa.int64()), ("n_tokens", pa.int64()), ("n_train", pa.int64()), ("doc_ids", pa.list_(to_arrow_type(id_type))), ("held_out", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("ids", pa.binary()), ("hashes", pa.binary())])

    def run(batches):
        task = TaskContext.get().partitionId()

        def fresh():
            number = defaultdict(count().__next__)
            number[START], number[END]
            return number, [], [], [], []

        def closed(k, number, doc_ids, out, lengths, parts):
            names = list(number)
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)
            ids = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((task * (1 << 32) + k, len(ids), sum(n for n, x in zip(lengths, out, strict=True) if not x), doc_ids, out, np.array(lengths, np.int64).tobytes(), keycounts.squeezed(ids), hashes.tobytes()), schema, strict=True)], schema=schema)

        k, held, n = 0, fresh(), 0
        for batch in batches:
            for doc_id, text, out in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "held_out")], strict=True):
                words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
                number = held[0]
                ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                held[1].append(doc_id)
                held[2].append(out)
                held[3].append(len(words) + 1)
                held[4].append(np.concatenate(([0], ids, [1]), dtype=np.int32))
                n += len(words) + 2
                if n >= chunk_tokens:
                    yield closed(k, *held)
                    k, held, n = k + 1, fresh(), 0
        if n:
            yield closed(k, *held)

    kind = id_type.simpleString()
    return stored(rows.mapInArrow(run, f"chunk bigint, n_tokens bigint, n_train bigint, doc_ids array<{kind}>, held_out array<boolean>, lengths binary, ids binary, hashes binary"), "lm-chunks")


class _Chunk:
    def __init__(self, row, order: int):
        ids, lengths = keycounts.loosened(row["ids"], np.int32), np.frombuffer(row["lengths"], np.int64)
        self.ids, self.begins = ids, np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        self.ends = self.begins + lengths + 1
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.held_out = np.array(row["held_out"], bool)
        self.grams = Grams(ids, self.begins, order, len(self.hashes))
        self.keys = self.grams.keys(self.hashes, 0)
        self.order = np.argsort(np.concatenate(self.keys), kind="stable")
        self.sorted = np.concatenate(self.keys)[self.order]

    def totals(self, found: np.ndarray) -> list[np.ndarray]:
        """What buckets said of the sorted keys, by n-gram length."""
        out = np.empty(len(found), np.int64)
        out[self.order] = found
        return np.split(out, np.cumsum([len(k) for k in self.keys])[:-1])


def counted(chunks: DataFrame, order: int) -> DataFrame:
    """chunk, bucket, totals, tally: the training counts of a chunk's keys; tally adds up to V."""

    def of(row):
        c = _Chunk(row, order)
        train = np.repeat(~c.held_out, c.ends - c.begins)
        return c.sorted, np.concatenate(c.grams.counts(train))[c.order]

    tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    seen_words = lambda keys, total: (total[keys % np.uint64(2) == 1] > 0).sum()
    return keycounts.totals(chunks.drop("n_tokens", "n_train", "doc_ids"), of, tokens * order, seen_words, "lm-totals")


def scored(docs: DataFrame, held_out: F.Column, order: int = ORDER, id_col="doc_id", text_col="text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each text; the model learns from those that aren't held out."""
    chunks = chunked(docs, held_out, id_col, text_col, chunk_tokens)
    totals = counted(chunks, order)
    n, v = chunks.agg(F.sum("n_train")).first()[0] or 0, totals.agg(F.sum("tally")).first()[0] or 0
    kind = docs.select(id_col).schema[0].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        c = _Chunk(row, order)
        found = c.totals(keycounts.answered(right["bucket"].to_pylist(), right["totals"].to_pylist()))
        model = Automaton(c.grams, found, n, v, len(c.hashes), 0)
        known, base = (found[0] > 0)[c.ids], model.words[c.ids]
        known[c.begins], base[c.begins] = False, 0.0
        scores = [model.score(c.ids[a + 1 : b].tolist()) for a, b in zip(c.begins.tolist(), c.ends.tolist(), strict=True)]
        columns = [pa.array(row["doc_ids"], schema[0].type), pa.array(c.held_out), pa.array(c.ends - c.begins - 1), pa.array(np.add.reduceat(known.astype(np.int64), c.begins)), pa.array(np.full(len(scores), n, np.int64)), pa.array(np.add.reduceat(base, c.begins)), pa.array(np.array(scores, np.float64))]
        return pa.Table.from_arrays(columns, schema=schema)

    left, right = chunks.drop("n_tokens", "n_train").groupBy("chunk"), totals.select("chunk", "bucket", "totals").groupBy("chunk")
    return left.cogroup(right).applyInArrow(score, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op11_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))
