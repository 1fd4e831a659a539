"""The contrast study: explicit denials of the true value against plain assertions of the false one.

Answer rows have ctx, pair_id, condition, k, arm, outcome, at, doc_ids, cells and p (a score of each document); log rows
doc_id, pair_id, cell, shape, model. An answer that is given again for the same pair, k and arm counts as its last one, by
at. Rates are in points. All joins are equi-joins on ids; a context's few documents are an array of its row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import models, runs, stats
from granary.session import stored
from granary.sources.logcache import LogCache

CACHE_SCHEMA = "key string, text_key string, answer string"
PLAIN, CONTRAST = "shortcut", "shortcut_contrast"


def passage_key(question: Column, text: Column) -> Column:
    return F.sha2(F.concat(question, F.lit("\x1f"), text), 256)


def looked_up(passages: DataFrame, cache: DataFrame) -> DataFrame:
    """The passages (question, text and more) with key, text_key and answer: the cache's entry of the key, else the one of
    the same text with the smallest key, else null. Only what the key doesn't find meets the texts' digests."""
    rows = stored(passages.withColumns({"key": passage_key(F.col("question"), F.col("text")), "text_key": F.sha2("text", 256)}), "passages")
    by_key = cache.groupBy("key").agg(F.max("answer").alias("answer"))
    first = stored(rows.join(by_key, "key", "left"), "found-by-key")
    by_text = cache.groupBy("text_key").agg(F.min_by("answer", "key").alias("answer"))
    rest = first.filter("answer IS NULL").drop("answer").join(by_text, "text_key", "left")
    return first.filter("answer IS NOT NULL").unionByName(rest)


def extracted(passages: DataFrame, cache: LogCache, extract: Callable[[str, str], str], batch: int) -> DataFrame:
    """The passages with key, text_key and answer. What the cache lacks is extracted once a key, and written back as a batch."""
    found = stored(looked_up(passages, cache.rows()), "looked-up")
    missing = found.filter("answer IS NULL").drop("answer")
    new = stored(models.extracted(missing.dropDuplicates(["key"]).select("key", "text_key", "question", "text"), extract).select("key", "text_key", "answer"), "extracted")
    if not new.isEmpty():
        cache.put(new, batch)
    return found.filter("answer IS NOT NULL").unionByName(missing.join(new.select("key", "answer"), "key", "left"))


def stances(answered: DataFrame) -> DataFrame:
    """doc_id, stance of passages (doc_id, answer, gold, attack): true, false, both or other."""
    kind = runs.outcome(F.coalesce("answer", F.lit("")), F.col("gold"), F.col("attack"))
    return answered.select("doc_id", F.when(kind == "gold", "true").when(kind == "attack", "false").when(kind == "both", "both").otherwise("other").alias("stance"))


def all_named(contexts: DataFrame, cell: str, named: DataFrame) -> DataFrame:
    """The contexts whose documents of that cell are all in named (doc_id); those without any are among them."""
    lies = contexts.select("ctx", F.explode(F.arrays_zip("doc_ids", "cells")).alias("x")).filter(F.col("x.cells") == cell).select("ctx", F.col("x.doc_ids").alias("doc_id"))
    open_ = lies.join(named.select("doc_id").distinct(), "doc_id", "left_anti").select("ctx").distinct()
    return contexts.join(open_, "ctx", "left_anti")


def without(contexts: DataFrame, flagged: DataFrame) -> DataFrame:
    """The contexts none of whose documents is in flagged (doc_id)."""
    hit = contexts.select("ctx", F.explode("doc_ids").alias("doc_id")).join(flagged.select("doc_id").distinct(), "doc_id").select("ctx").distinct()
    return contexts.join(hit, "ctx", "left_anti")


def _last(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    return answers.groupBy(*keys).agg(F.max_by("outcome", "at").alias("outcome"))


def paired(plain: DataFrame, contrast: DataFrame, keys: Sequence[str] = ("pair_id", "k", "arm")) -> DataFrame:
    """keys, plain, contrast: the outcomes where both sides answered."""
    return _last(plain, keys).withColumnRenamed("outcome", "plain").join(_last(contrast, keys).withColumnRenamed("outcome", "contrast"), list(keys))


def shares(met: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n, acc, flip, both and other of either side, delta_flip (contrast less plain), in points."""
    rate = lambda side, kind: 100.0 * F.avg((F.col(side) == kind).cast("double"))
    each = [rate(side, kind).alias(f"{side}_{name}") for side in ("plain", "contrast") for name, kind in (("acc", "gold"), ("flip", "attack"), ("both", "both"), ("other", "other"))]
    return met.groupBy(*by).agg(F.count("*").alias("n"), *each).withColumn("delta_flip", F.col("contrast_flip") - F.col("plain_flip"))


def intervals(met: DataFrame, groups: Sequence[tuple[int, str]], **more) -> DataFrame:
    """k, arm, lo, hi of delta_flip: pairs are drawn with replacement, all groups from the same draws."""
    gap = 100.0 * ((F.col("contrast") == "attack").cast("double") - (F.col("plain") == "attack").cast("double"))
    names = {f"g{i}": (k, arm) for i, (k, arm) in enumerate(groups)}
    parts = stats.cluster_components(met, "pair_id", {g: F.when((F.col("k") == k) & (F.col("arm") == arm), gap) for g, (k, arm) in names.items()})
    out = stats.cluster_bootstrap(parts, "pair_id", {g: g for g in names}, **more)
    named = F.create_map(*[x for g, (k, arm) in names.items() for x in (F.lit(g), F.struct(F.lit(k).alias("k"), F.lit(arm).alias("arm")))])
    return out.select(named[F.col("statistic")].alias("g"), "lo", "hi").select("g.k", "g.arm", "lo", "hi")


def mean_scores(answers: DataFrame, log: DataFrame, arm: str = "shape") -> DataFrame:
    """cell (of A_T and A_F with the shape behind a slash), n, p: mean score of the documents that the arm's contexts hold."""
    each = answers.filter(F.col("arm") == arm).select(F.explode(F.arrays_zip("doc_ids", "cells", "p")).alias("x")).select(F.col("x.doc_ids").alias("doc_id"), F.col("x.cells").alias("cell"), F.col("x.p").alias("p"))
    met = each.join(log.select("doc_id", "shape"), "doc_id", "left")
    name = F.when(F.col("cell").isin("A_F", "A_T"), F.concat_ws("/", "cell", "shape")).otherwise(F.col("cell"))
    return met.groupBy(name.alias("cell")).agg(F.count("p").alias("n"), F.avg("p").alias("p"))


def flips_by_lie(answers: DataFrame, log: DataFrame, kinds: Sequence[tuple[str, str, str, str | None]], arm: str = "none", k: int = 1) -> DataFrame:
    """kind, n, flip: contexts of an arm by the kind of their first lie; kinds: (name, condition, cell, shape or None)."""
    rows = answers.filter((F.col("arm") == arm) & (F.col("k") == k))
    lie = rows.select("ctx", "condition", "outcome", F.posexplode(F.arrays_zip("doc_ids", "cells")).alias("i", "x")).select("ctx", "condition", "outcome", "i", F.col("x.doc_ids").alias("doc_id"), F.col("x.cells").alias("cell"))
    first = lie.groupBy("ctx", "condition", "outcome", "cell").agg(F.min_by("doc_id", "i").alias("doc_id")).join(log.select("doc_id", "shape"), "doc_id", "left")
    match = lambda c, cell, shape: (F.col("condition") == c) & (F.col("cell") == cell) & (F.lit(True) if shape is None else F.coalesce(F.col("shape") == shape, F.lit(False)))
    named = F.array_compact(F.array(*[F.when(match(*rest), F.lit(name)) for name, *rest in kinds]))
    return first.select("outcome", F.explode(named).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), (100.0 * F.avg((F.col("outcome") == "attack").cast("double"))).alias("flip"))


def by_generator(log: DataFrame, inverted: DataFrame, generated: DataFrame, refusals: DataFrame, contrast: DataFrame, cell: str = "A_C") -> DataFrame:
    """model, docs, inverted, mean_attempts, rejected_attempts, refusals, flip_k1, n_k1 of the makers of the cell's documents.

    generated: doc_id, attempts; refusals: doc_id, problem; contrast: the kept contexts, whose first document of the cell
    names their maker. Each table is summed by maker before they meet."""
    docs = stored(log.filter(F.col("cell") == cell).select("doc_id", "model"), "cell-documents")
    bad = inverted.select("doc_id").distinct().withColumn("bad", F.lit(1))
    mine = docs.join(bad, "doc_id", "left").join(generated.select("doc_id", "attempts"), "doc_id", "left")
    per = mine.groupBy("model").agg(F.count("*").alias("docs"), F.count("bad").alias("inverted"), F.avg("attempts").alias("mean_attempts"))
    said = refusals.join(docs, "doc_id").groupBy("model").agg(F.count("*").alias("rejected_attempts"), F.count_if(F.col("problem") == "refusal").alias("refusals"))
    lies = contrast.filter("k = 1 AND arm = 'none'").select("ctx", "outcome", F.posexplode(F.arrays_zip("doc_ids", "cells")).alias("i", "x")).filter(F.col("x.cells") == cell)
    first = lies.groupBy("ctx", "outcome").agg(F.min_by(F.col("x.doc_ids"), "i").alias("doc_id")).join(docs, "doc_id")
    flips = first.groupBy("model").agg((100.0 * F.avg((F.col("outcome") == "attack").cast("double"))).alias("flip_k1"), F.count("*").alias("n_k1"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return per.join(said, "model", "left").join(flips, "model", "left").select("model", "docs", "inverted", "mean_attempts", zero("rejected_attempts"), zero("refusals"), "flip_k1", zero("n_k1"))
