"""Loops around models: passages written and gated, contexts answered arm by arm, questions without passages."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import names
from granary.functions import text as T
from granary.operators import models, signals
from granary.session import stored


def problem(min_words: int) -> Column:
    """The gate of a row's kind over text, own and other (aliases of the value it asserts, and of the rival)."""
    t, own, other = F.col("text"), F.col("own"), F.col("other")
    return F.when(F.col("cell") == "A_C", names.contrastive_problem(t, own, other, min_words)).otherwise(T.generation_problem(t, own, other, min_words))


def generated(plan: DataFrame, write: Callable[[str, str, int], str], attempts: int = 3, min_words: int = 100, done: DataFrame | None = None, rate: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, attempts, salvaged) and (doc_id, problem) for what fails to the end.

    plan: doc_id, prompt, cell, dependence_level, parent_doc, own, other; write(prompt, doc_id, attempt) is the model. Rows
    of done (doc_id, text) aren't written again. A row is tried until its gate lets it pass; what fails then is salvaged
    and judged once more. Edited copies (D4) come from their parent's text, without a model; without a parent's text they
    fail as parent_missing."""
    keep = plan.columns
    if done is not None:
        plan = plan.join(done.select("doc_id"), "doc_id", "left_anti").select(*keep)
    copies, open_, fine = plan.filter("dependence_level = 'D4'"), plan.filter("dependence_level IS NULL OR dependence_level <> 'D4'"), []
    for attempt in range(attempts):
        said = models.written(open_.select(*keep).withColumn("attempt", F.lit(attempt)), write).withColumn("problem", problem(min_words))
        said = stored(said, "written")
        fine.append(said.filter("problem IS NULL").select("doc_id", "text", F.lit(attempt + 1).alias("attempts"), F.lit(False).alias("salvaged")))
        open_ = said.filter("problem IS NOT NULL")
    saved = open_.withColumnRenamed("problem", "first_problem").withColumn("text", T.salvage(F.col("text"), F.col("own"), F.col("other")))
    saved = stored(saved.withColumn("problem", problem(min_words)), "salvaged")
    fine.append(saved.filter("problem IS NULL").select("doc_id", "text", F.lit(attempts).alias("attempts"), F.lit(True).alias("salvaged")))
    docs = stored(functools.reduce(DataFrame.unionByName, fine), "generated")
    parents = docs.select(F.col("doc_id").alias("parent_doc"), F.col("text").alias("parent_text"))
    if done is not None:
        parents = parents.unionByName(done.select(F.col("doc_id").alias("parent_doc"), F.col("text").alias("parent_text")))
    edited = copies.join(parents, "parent_doc", "left").withColumn("text", names.near_copies(F.col("parent_text"), F.col("doc_id"), rate))
    made = edited.filter("parent_text IS NOT NULL").select("doc_id", "text", F.lit(0).alias("attempts"), F.lit(False).alias("salvaged"))
    refused = saved.filter("problem IS NOT NULL").select("doc_id", F.col("first_problem").alias("problem"))
    return docs.unionByName(made), refused.unionByName(edited.filter("parent_text IS NULL").select("doc_id", F.lit("parent_missing").alias("problem")))


def outcome(answer: Column, gold: Column, attack: Column) -> Column:
    """gold, attack, both or other: whose words the answer holds in a row."""
    said = T.normalize_ascii(answer)
    holds = lambda aliases: F.exists(aliases, lambda a: T.contains_normalized(said, T.normalize_ascii(a)))
    return T.classify(holds(gold), holds(attack))


def whole_outcome(answer: Column, gold: Column, attack: Column) -> Column:
    """As outcome, but an answer counts only if it is one of the aliases (normalised ones) as a whole; its words stand
    between ASCII white space, and other spaces at its ends go. A dotted I is an i, as in DuckDB's lower()."""
    low = F.lower(F.translate(F.coalesce(answer, F.lit("")), "\u0130", "i"))
    plain = F.regexp_replace(F.translate(low, T.PUNCTUATION, ""), r"^\p{Zs}+|\p{Zs}+$", "")
    kept = F.filter(F.split(plain, r"\s+"), lambda w: ~w.isin("a", "an", "the", ""))
    return T.bound(F.array_join(kept, " "), lambda said: T.classify(F.array_contains(gold, said), F.array_contains(attack, said)))


def factorial(rows: DataFrame, values: DataFrame, arms: Sequence[str], answer: Callable[[str, list[str], list[float]], str], done: DataFrame | None = None, transform: str = "maxnorm", judge: Callable[[Column, Column, Column], Column] = outcome) -> DataFrame:
    """ctx, arm, answer, outcome: every context of rows (ctx, pos, text, stance) answered under each arm's weights.

    values: ctx, question, gold, attack; done (ctx, arm) is left out; judge(answer, gold, attack) is the outcome. A context's
    few passages travel as one row."""
    out = []
    for name in arms:
        scored = signals.multipliers(signals.arm(name)(rows), transform)
        if done is not None:
            scored = scored.join(done.filter(F.col("arm") == name).select("ctx").distinct(), "ctx", "left_anti")
        held = F.array_sort(F.collect_list(F.struct("pos", "text", "multiplier")))
        per = scored.groupBy("ctx").agg(held.alias("x")).join(values, "ctx")
        per = stored(per.select("ctx", "question", "gold", "attack", F.transform("x", lambda p: p["text"]).alias("passages"), F.transform("x", lambda p: p["multiplier"]).alias("weights")), "weighted")
        said = models.answered(per, answer).join(per.select("ctx", "gold", "attack"), "ctx")
        out.append(said.select("ctx", F.lit(name).alias("arm"), "answer", judge(F.col("answer"), F.col("gold"), F.col("attack")).alias("outcome")))
    return functools.reduce(DataFrame.unionByName, out)


def closed_book(values: DataFrame, answer: Callable[[str, list[str], list[float]], str], done: DataFrame | None = None, judge: Callable[[Column, Column, Column], Column] = outcome) -> DataFrame:
    """ctx, answer, outcome: the questions of values (ctx, question, gold, attack) that aren't done, without any passage."""
    if done is not None:
        values = values.join(done.select("ctx").distinct(), "ctx", "left_anti")
    none = values.select("ctx", "question", F.array().cast("array<string>").alias("passages"), F.array().cast("array<double>").alias("weights"))
    said = models.answered(none, answer).join(values.select("ctx", "gold", "attack"), "ctx")
    return said.select("ctx", "answer", judge(F.col("answer"), F.col("gold"), F.col("attack")).alias("outcome"))
