"""Weighting arms: each turns the documents of contexts into a score column.

Input rows: ctx, pos, text (what an arm may see) and, for the oracle alone, stance. Arms are looked up by name;
`a_x_b` is the product of two arms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import values as V
from granary.functions.grams import gram_hashes
from granary.functions.text import contains_normalized, normalize_answer
from granary.operators.components import connected_components
from granary.operators.ranges import running
from granary.operators.stats import Calibrator, clipped, max_normalized, min_shifted
from granary.session import stored


def none(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.lit(1.0))


def oracle(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.when(F.col("stance") == "false", 0.0).otherwise(1.0))


def context_clusters(df: DataFrame, threshold: float = 0.35) -> DataFrame:
    """df with label: clusters of similar texts inside a context, numbered by first appearance. Contexts hold a few documents.

    Shingles are compared as 64-bit hashes; a null text is like none, texts without words are like each other."""
    node = F.xxhash64("ctx", "pos")
    rows = stored(df.filter("text IS NOT NULL").select("ctx", "pos", gram_hashes(F.col("text")).alias("grams")).withColumn("n", F.size("grams")), "context-grams")
    a, b = rows.alias("a"), rows.alias("b")
    fits = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-9  # else too unlike in size, nothing to look at
    met = a.join(b, (F.col("a.ctx") == F.col("b.ctx")) & (F.col("a.pos") < F.col("b.pos")) & fits)
    n = F.col("a.n") + F.col("b.n")
    least = F.ceil(threshold / (1 + threshold) * n - 1e-9)  # of common shingles; at the very bound the quotient decides
    least = F.when(n == 0, 0).otherwise(F.when(least / F.greatest(n - least, F.lit(1)) >= threshold, least).otherwise(least + 1))
    near = met.filter(F.size(F.array_intersect("a.grams", "b.grams")) >= least)
    links = near.select(F.xxhash64("a.ctx", "a.pos").alias("src"), F.xxhash64("b.ctx", "b.pos").alias("dst"))
    found = connected_components(links)
    out = df.withColumn("node", node).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    out = out.withColumn("first", F.min("pos").over(Window.partitionBy("ctx", "component")))
    return out.withColumn("label", F.dense_rank().over(Window.partitionBy("ctx").orderBy("first")) - 1).drop("node", "component", "first")


def dependence(df: DataFrame, threshold: float = 0.35) -> DataFrame:
    """1 / size of the document's cluster in its context."""
    out = context_clusters(df, threshold)
    return out.withColumn("score", 1.0 / F.count("*").over(Window.partitionBy("ctx", "label")))


def merged_answers(df: DataFrame, answer: str = "answer") -> DataFrame:
    """df with canon: answers that hold each other stand for the longest (then first by text); greedy, in that order.

    No-answers stay as they are. A context has a few answers, held in one array."""
    listed = F.array_distinct(F.collect_list(F.when(~F.col(answer).isin(*V.NO_ANSWER), F.col(answer))))
    ranked = F.array_sort(F.transform(listed, lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a"))))
    empty = F.array().cast("array<struct<a:string,rep:string>>")

    def add(held, x):
        alike = lambda r: contains_normalized(r["rep"], x["a"]) | contains_normalized(x["a"], r["rep"])
        rep = F.coalesce(F.get(F.filter(held, alike), F.lit(0))["rep"], x["a"])
        return F.concat(held, F.array(F.struct(x["a"].alias("a"), rep.alias("rep"))))

    reps = df.groupBy("ctx").agg(F.aggregate(ranked, empty, add).alias("reps"))
    named = reps.select("ctx", F.explode("reps").alias("r")).select("ctx", F.col("r.a").alias(answer), F.col("r.rep").alias("canon"))
    return df.join(named, ["ctx", answer], "left").withColumn("canon", F.coalesce("canon", answer))


def voting(df: DataFrame, weight=None, answer: str = "answer") -> DataFrame:
    """Share of the document's answer group in all votes; documents without an answer don't vote and get 1.

    df has raw answers in `answer`; weight is 1 or a column."""
    rows = merged_answers(df.withColumn(answer, normalize_answer(F.col(answer))), answer).withColumn("_w", F.lit(1.0) if weight is None else weight)
    votes = ~F.col("canon").isin(*V.NO_ANSWER)
    mine = F.sum("_w").over(Window.partitionBy("ctx", "canon"))
    total = F.sum(F.when(votes, F.col("_w")).otherwise(0.0)).over(Window.partitionBy("ctx"))
    return rows.withColumn("score", F.when(votes & (total > 0), mine / total).otherwise(1.0)).drop("_w")


def agreement(df: DataFrame, threshold: float = 0.35) -> DataFrame:
    """As voting, each document weighing 1 / size of its cluster."""
    return voting(dependence(df, threshold).withColumnRenamed("score", "_discount"), F.col("_discount")).drop("_discount")


def judge(df: DataFrame, parsed: str = "judged") -> DataFrame:
    """A parsed 0..10 score as a tenth; 1 where there is none."""
    return df.withColumn("score", F.coalesce(F.col(parsed) / 10.0, F.lit(1.0)))


def form(calibrator: Calibrator) -> Callable[[DataFrame], DataFrame]:
    """1 - p(flagged) of a fitted calibrator, whose feature columns df has."""
    return lambda df: df.withColumn("score", 1.0 - calibrator.probability())


ARMS: dict[str, Callable[[DataFrame], DataFrame]] = {"none": none, "oracle": oracle, "dependence": dependence, "voting": voting, "agreement": agreement, "judge": judge}


def arm(name: str, more: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> Callable[[DataFrame], DataFrame]:
    known = ARMS | (more or {})
    if name in known:
        return known[name]
    left, _, right = name.partition("_x_")
    if not right:
        raise ValueError(f"unknown arm {name}")
    first, second = arm(left, more), arm(right, more)
    return lambda df: second(first(df).withColumnRenamed("score", "_left")).withColumn("score", F.col("_left") * F.col("score")).drop("_left")


def multipliers(df: DataFrame, transform: str = "maxnorm", floor: float = 0.1) -> DataFrame:
    if transform not in ("clip", "maxnorm"):
        raise ValueError(f"unknown transform {transform}")
    return df.withColumn("multiplier", clipped(F.col("score"), floor) if transform == "clip" else max_normalized(F.col("score"), ["ctx"], floor))


def selected_heads(heads: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """keys, effect, place of the first k heads by mean effect, ties by keys; by default as many as have a positive one."""
    placed = running(heads.select(*keys, "effect"), [F.col("effect").desc(), *keys], {"place": F.lit(1).cast("bigint")}, "heads")
    return placed.filter(F.col("place") <= (k or heads.filter("effect > 0").count()))


def extras(df: DataFrame) -> DataFrame:
    """ctx, n_docs, n_clusters and the effective number of documents with unit weights and with the discounts, to three
    places; df is what dependence() returns."""
    per = df.groupBy("ctx", "label").agg(F.count("*").alias("n"), F.sum("score").alias("w"))
    neff = lambda c: F.round(F.coalesce(F.try_divide(F.sum(c) * F.sum(c), F.sum(F.col(c) * F.col(c))), F.lit(0.0)), 3)
    return per.groupBy("ctx").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_clusters"), neff("n").alias("neff_unweighted"), neff("w").alias("neff_discounted"))


def schemes(df: DataFrame, score: Column, fake: Column, marked: Column, form: Column) -> DataFrame:
    """df (ctx, pos, ...) once for each scheme, with scheme, m (the passage's weight) and place (from 1, in its context).

    none and no_fake keep the given order; the others put passages in ascending order of weight, those alike as given.
    sort_only orders by the judge's score and weighs nothing; no_fake is without the false passages."""
    gpt = min_shifted(score, ["ctx"])
    weights = {"none": F.lit(1.0), "gpt": gpt, "gpt_maxnorm": max_normalized(score, ["ctx"]), "sort_only": F.lit(1.0), "ideal": F.when(fake, 0.0).otherwise(1.0), "cnn": F.when(marked, 0.0).otherwise(1.0), "shape": form, "no_fake": F.lit(1.0)}
    wide = df.withColumns({f"_m_{k}": c.cast("double") for k, c in weights.items()}).withColumns({"_ideal": F.coalesce(fake, F.lit(False)), "_cnn": F.coalesce(marked, F.lit(False)), "_fake": fake})
    # rows are sorted scheme by scheme where their context is, four times and narrow, and listed by scheme when places are
    # known: a sort of eight times the rows spills. Two weights alone (ideal, cnn) are counted in the given order
    inside = lambda *order: Window.partitionBy("ctx").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = lambda holds: F.count_if(holds).over(inside("pos"))
    zeros = lambda c: F.count_if(F.col(c)).over(Window.partitionBy("ctx"))
    apart = lambda c: F.when(F.col(c), upto(F.col(c))).otherwise(zeros(c) + upto(~F.col(c)))
    wide = wide.withColumns({"_p_none": upto(F.lit(True)), "_p_no_fake": upto(~F.col("_fake")), "_p_ideal": apart("_ideal"), "_p_cnn": apart("_cnn")})
    for k in ("gpt", "gpt_maxnorm", "shape"):
        wide = wide.withColumn(f"_p_{k}", F.row_number().over(inside(f"_m_{k}", "_p_none")))
    at = lambda k: F.col("_p_gpt" if k == "sort_only" else f"_p_{k}").cast("int")
    listed = F.array(*[F.struct(F.lit(k).alias("scheme"), F.col(f"_m_{k}").alias("m"), at(k).alias("place")) for k in weights])
    return wide.select(*df.columns, "_fake", F.explode(listed).alias("x")).select(*df.columns, "_fake", "x.*").filter("scheme <> 'no_fake' OR NOT _fake").drop("_fake")
