"""Embedding near-dedup by spherical-cap filters from a structured random product code.

A vector, scaled to length 1, is cut in two halves (after a fixed random rotation); each half has a code
of B random unit vectors, and the B * B filters are their concatenations. A vector is decoded to the list
of all filters whose cap it lies in (dot product at least alpha): the codewords of each half are ranked,
and pairs are tried in rank order only as long as they can reach alpha. Vectors that share a filter, a
label and a dimension are compared exactly; links are the pairs with cosine >= MIN_COSINE.

B follows the number of vectors of the largest label, so that a bucket is expected to hold about BUCKET
of them. alpha is calibrated for each dimension on random pairs at exactly MIN_COSINE: the height at which
MISSED of them share no filter (fewer are missed above that cosine). Buckets above TILE rows are cut into
chunks, each pair of which is compared.

Exact copies are one class and are compared once. A pair is counted in the smallest filter that its
vectors share; a bucket returns each vector's count and a spanning forest, never pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a
label, link with nothing and are kept; vectors of different dimension never link; rows that share an id
are one node of the components but vectors of their own in the counts; a null id is kept if it links with
nothing; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.simhash import TILE, Forest, tiled, whole_groups
from granary.operators.components import connected_components
from granary.session import stored, table

MIN_COSINE = 0.93
SHARED = 12.0
#: Share of pairs at the threshold that may be missed, and the random pairs that settle it.
MISSED, PAIRS = 0.01, 400
BUCKET = 48
CODE = (24, 2048)
SEED = 20
SLICE = 1 << 14


def _tail(x):
    return 0.5 * math.erfc(x / math.sqrt(2))


def code_size(n: int, cosine: float = MIN_COSINE) -> int:
    """B for n vectors of one label, as if dot products with a filter were normal."""
    p = min(0.05, BUCKET / max(n, 1))
    low, high = 0.0, 12.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(mid) > p else (low, mid)
    s = math.sqrt(1 - cosine * cosine)
    z = low + (np.arange(4000) + 0.5) * 0.0015
    density = np.exp(-z * z / 2)
    both = float((density * np.array([_tail((low - cosine * x) / s) for x in z])).sum() / density.sum())
    return int(min(CODE[1], max(CODE[0], math.ceil(math.sqrt(SHARED / both / p)))))


def calibrated(dim: int, size: int, cosine: float = MIN_COSINE) -> float:
    """alpha: a share MISSED of random pairs at this cosine has no filter that both exceed."""
    code, rng, reach = ProductCode(dim, size, 0.0), np.random.default_rng(SEED + 1), []
    for _ in range(PAIRS):
        x, y = rng.standard_normal((2, dim))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        length = np.linalg.norm(y)
        y = cosine * x + (math.sqrt(1 - cosine * cosine) / length * y if length > 1e-9 else (1 - cosine) * x)
        (a, b), (c, d) = code.products(x), code.products(y)
        reach.append(float(np.minimum(a[:, None] + b[None, :], c[:, None] + d[None, :]).max()))
    return float(np.quantile(reach, MISSED)) - 1e-9


class ProductCode:
    def __init__(self, dim: int, size: int, alpha: float):
        rng = np.random.default_rng(SEED)
        self.dim, self.half, self.size, self.alpha = dim, (dim + 1) // 2, size, alpha
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        halves = self.half, dim - self.half
        self.codes = [c / np.linalg.norm(c, axis=1, keepdims=True) if c.shape[1] else c for c in (rng.standard_normal((size, h)) for h in halves)]

    def products(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.rotation
        return turned[..., : self.half] @ self.codes[0].T, turned[..., self.half :] @ self.codes[1].T

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that each row exceeds."""
        first, second = self.products(unit)
        order1, order2 = np.argsort(-first, axis=1), np.argsort(-second, axis=1)
        first, second = np.take_along_axis(first, order1, 1), np.take_along_axis(second, order2, 1)
        rows, filters = [], []
        live = np.arange(len(unit))
        for r in range(self.size):
            live = live[first[live, r] + second[live, 0] >= self.alpha]
            if not len(live):
                break
            inner = live
            for q in range(self.size):
                inner = inner[first[inner, r] + second[inner, q] >= self.alpha]
                if not len(inner):
                    break
                rows.append(inner)
                filters.append(order1[inner, r] * self.size + order2[inner, q])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(filters)


def usable(vector):
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _shares_smaller(lists: np.ndarray, i: np.ndarray, j: np.ndarray, f: int) -> np.ndarray:
    """Whether rows i and j share a filter below f; lists are padded with -1."""
    below = np.where(lists < f, lists, -1)
    names, code = np.unique(below, return_inverse=True)
    code = code.reshape(below.shape)
    if len(below) * len(names) <= 8_000_000:
        has = np.zeros((len(below), len(names)), np.float32)
        has[np.arange(len(below))[:, None], code] = 1
        has[:, names == -1] = 0
        if len(i) * len(names) > 4 * len(below) ** 2:
            return (has @ has.T)[i, j] > 0
        return np.concatenate([(has[i[k : k + 50_000]] * has[j[k : k + 50_000]]).any(axis=1) for k in range(0, len(i), 50_000)])
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 20_000):
        a, b = below[i[k : k + 20_000]], below[j[k : k + 20_000]]
        out[k : k + 20_000] = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2))
    return out


def links(classes: DataFrame, size: int, cosine: float = MIN_COSINE, tile: int = TILE) -> DataFrame:
    """node, links (rows that the class's bucket mates hold, each pair counted in one bucket), root.

    classes: node, n, label, vector."""
    dims = [r[0] for r in classes.select(F.size("vector")).distinct().collect()]
    alphas = {dim: calibrated(dim, size, cosine) for dim in dims}

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, ProductCode] = {}
        for rows in batches:
            lengths = rows["vector"].map(len).to_numpy()
            for dim in np.unique(lengths).tolist():
                part = rows[lengths == dim]
                raw = np.array(part["vector"].tolist(), np.float64)
                unit = raw / np.abs(raw).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                code = codes.get(dim) or codes.setdefault(dim, ProductCode(dim, size, alphas[dim]))
                row, which = code.decode(unit)
                order = np.lexsort((which, row))
                row, which = row[order], which[order]
                ends = np.cumsum(np.bincount(row, minlength=len(part)))
                begins = np.concatenate(([0], ends[:-1]))
                lists = [which[a:b].astype(np.int32).tobytes() for a, b in zip(begins, ends, strict=True)]
                # single precision travels where it holds the given numbers exactly; cosines are taken in double
                short = raw.astype(np.float32)
                exact = (short.astype(np.float64) == raw).all(axis=1)
                blobs = [a.tobytes() if e else b.tobytes() for a, b, e in zip(short, raw, exact.tolist(), strict=True)]
                at = row.tolist()
                yield pd.DataFrame({"node": part["node"].to_numpy()[row], "n": part["n"].to_numpy()[row], "label": part["label"].to_numpy()[row], "f": which, "dim": dim, "filters": [lists[k] for k in at], "raw": [blobs[k] for k in at]})

    found = classes.select("node", "n", "label", "vector").mapInPandas(emit, "node bigint, n bigint, label bigint, f bigint, dim int, filters binary, raw binary")
    keyed = found.withColumn("key", F.xxhash64("label", "dim", "f"))
    ready = tiled(stored(keyed, "cap-buckets"), "node", tile).repartition("key").sortWithinPartitions("key", "node")

    def compare(batches):
        for piece in whole_groups(batches, "key", SLICE):
            key = piece["key"].to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a > 1:
                    part = piece.iloc[a:b]
                    if part["label"].nunique() > 1 or part["f"].nunique() > 1 or part["dim"].nunique() > 1:  # keys that collide
                        parts = [x for _, x in part.groupby(["label", "f", "dim"])]
                    else:
                        parts = [part]
                    out += [_bucket(x, cosine) for x in parts if len(x) > 1]
            if out:
                yield pd.concat(out, ignore_index=True)

    return ready.mapInPandas(compare, "node bigint, links bigint, root bigint")


def _bucket(part: pd.DataFrame, cosine: float) -> pd.DataFrame:
    node, n, chunk = part["node"].to_numpy(np.int64), part["n"].to_numpy(np.int64), part["chunk"].to_numpy()
    dim, unit = int(part["dim"].iloc[0]), np.empty((len(part), int(part["dim"].iloc[0])))
    blobs = part["raw"].tolist()
    short = np.fromiter((len(x) == 4 * dim for x in blobs), bool, len(blobs))
    for kind, rows in ((np.float32, np.flatnonzero(short)), (np.float64, np.flatnonzero(~short))):
        if len(rows):
            unit[rows] = np.frombuffer(b"".join([blobs[k] for k in rows]), kind).reshape(len(rows), dim)
    unit /= np.abs(unit).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    lists = [np.frombuffer(x, np.int32) for x in part["filters"]]
    padded = np.full((len(lists), max(map(len, lists))), -1, np.int64)
    for k, x in enumerate(lists):
        padded[k, : len(x)] = x
    f, cross = int(part["f"].iloc[0]), bool(part["cross"].iloc[0])
    count, forest = np.zeros(len(part), np.int64), Forest(len(part))
    for at in range(0, len(part), 1024):
        near = unit[at : at + 1024] @ unit[at:].T >= cosine
        i, j = np.nonzero(near)
        i, j = i + at, j + at
        keep = (i < j) & (node[i] != node[j])
        if cross:
            keep &= chunk[i] != chunk[j]
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        forest.link(i, j)
        first = ~_shares_smaller(padded, i, j, f)
        i, j = i[first], j[first]
        count += np.bincount(i, n[j], len(part)).astype(np.int64) + np.bincount(j, n[i], len(part)).astype(np.int64)
    root = forest.all_roots()
    said = np.flatnonzero((count > 0) | (root != np.arange(len(root))))
    return pd.DataFrame({"node": node[said], "links": count[said], "root": node[root[said]]})


def near_duplicates(vectors: DataFrame, cosine: float = MIN_COSINE, id_col="vec_id", vector_col="embedding", label_col="label", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("fine", usable(F.col("vector")) & F.col("label").isNotNull())
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    same = ["label", "h1", "h2"]
    classes = rows.filter("fine").groupBy(*same).agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    # a class's number is its own: rows of one id may have different vectors, and ids may be null
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    found = stored(links(classes, code_size(largest, cosine), cosine, tile), "vector-links")
    groups = connected_components(found.filter("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.select(*same, "node", "n", "first").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "component").join(counts, "node", "left")
    named = named.select(*same, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.filter("fine").select("vec_id", *same).join(named, same).select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = rows.filter("NOT fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op6_embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
