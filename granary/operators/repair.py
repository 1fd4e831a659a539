"""The repair round as one flow: exclude, replace, refill the split, list what to write again, hand it to other makers.

Nothing is changed in place: the round takes one version of pairs, split, plan and documents and gives the next one, so a
round that dies leaves its input as it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import curation, records
from granary.operators.ranges import running
from granary.session import stored

REPLACED = "; appended as a replacement for an excluded pair"


@dataclass
class Round:
    """The tables after a round. pairs: pair_id, source, question, excluded, notes; split: pair_id, split; regenerate: doc_id;
    plan: as before, with model and reassigned_from; reassigned: doc_id, from, to."""

    pairs: DataFrame
    new_pairs: DataFrame
    split: DataFrame
    regenerate: DataFrame
    plan: DataFrame
    reassigned: DataFrame


def still_needed(pairs: DataFrame) -> DataFrame:
    """kind, needed: excluded pairs of each kind of source that no appended pair has replaced yet."""
    kind = curation.source_kind(F.col("source")).alias("kind")
    counts = pairs.groupBy(kind).agg(F.count("excluded").alias("gone"), F.count_if(F.contains(F.coalesce("notes", F.lit("")), F.lit(REPLACED[2:]))).alias("come"))
    return counts.select("kind", (F.col("gone") - F.col("come")).alias("needed")).filter("needed > 0")


def replacements(pairs: DataFrame, candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """The first candidates (source, question, text, place) of each kind that lacks pairs, with ids behind the largest.

    Candidates whose source a pair has, or whose text is in seen (text, compared folded), are passed over; of candidates
    with one text the first counts."""
    key = F.sha2(T.fold(F.col("text")), 256)
    fresh = candidates.join(pairs.select("source").distinct(), "source", "left_anti").withColumn("key", key)
    fresh = curation.first_wins(fresh.join(seen.select(key.alias("key")).distinct(), "key", "left_anti"), ["key"], ["place"])
    fresh = fresh.withColumn("kind", curation.source_kind(F.col("source"))).join(still_needed(pairs), "kind")
    placed = running(fresh, ["kind", "place"], {"number": F.lit(1).cast("bigint")}, "candidates")
    taken = F.least(F.max("needed"), F.count("*"))
    kinds = placed.groupBy("kind").agg(F.min("number").alias("first"), taken.alias("taken"))
    earlier = Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)  # a row for each kind of source
    kinds = kinds.withColumn("before", F.coalesce(F.sum("taken").over(earlier), F.lit(0)))
    last = pairs.agg(F.coalesce(F.max(F.substring("pair_id", 2, 20).cast("bigint")), F.lit(0)).alias("last"))
    rank = F.col("number") - F.col("first") + 1
    picked = placed.join(F.broadcast(kinds), "kind").filter(rank <= F.col("taken")).join(F.broadcast(last))
    return picked.select(F.format_string("p%04d", F.col("last") + F.col("before") + rank).alias("pair_id"), "source", "question", F.lit(None).cast("string").alias("excluded"), F.lit(REPLACED).alias("notes"))


def again(plan: DataFrame, generated: DataFrame, violations: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flagged, regenerate), each doc_id: documents of active pairs that were written and have a violation or stayed
    unresolved, and these with the plan's rows that are made from them."""
    bad = generated.join(violations.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id").unionByName(generated.filter("unresolved").select("doc_id")).distinct()
    active = plan.join(excluded.select("pair_id"), "pair_id", "left_anti")
    flagged = stored(bad.join(active.select("doc_id"), "doc_id", "left_semi"), "flagged")
    children = plan.join(flagged.select(F.col("doc_id").alias("parent_doc")), "parent_doc", "left_semi").select("doc_id")
    return flagged, flagged.unionByName(children).distinct()


def tried_before() -> Column:
    """Whether a flagged row (dependence_level, seed_offset, unresolved) goes to the next maker: edited copies don't, and
    first tries that were resolved don't."""
    fresh = (F.coalesce("seed_offset", F.lit(0)) == 0) & ~F.coalesce("unresolved", F.lit(False))
    return F.coalesce(F.col("dependence_level") != "D4", F.lit(True)) & ~fresh


def repaired(pairs: DataFrame, split: DataFrame, plan: DataFrame, generated: DataFrame, violations: DataFrame, reasons: DataFrame, candidates: DataFrame, seen: DataFrame, n_dev: int, makers: Sequence[str], seed: str, reassign: bool = True) -> Round:
    """One round. reasons: pair_id, reason of the pairs to exclude; generated: doc_id, unresolved, seed_offset."""
    marked = pairs.join(reasons.select("pair_id", "reason"), "pair_id", "left")
    marked = stored(marked.select("pair_id", "source", "question", F.coalesce("reason", "excluded").alias("excluded"), "notes"), "marked-pairs")
    new = stored(replacements(marked, candidates, seen), "new-pairs")
    gone = marked.filter("excluded IS NOT NULL").select("pair_id")
    flagged, regenerate = again(plan, generated, violations, gone)
    listed = plan.join(flagged, "doc_id").join(generated.select("doc_id", "seed_offset", "unresolved"), "doc_id", "left")
    hand_on = listed.filter(tried_before() if reassign else F.lit(False)).select("doc_id")
    after = stored(records.reassigned(plan, hand_on, makers), "plan")
    moved = after.filter("reassigned_from IS NOT NULL").select("doc_id", F.col("reassigned_from").alias("from"), F.col("model").alias("to"))
    return Round(marked.unionByName(new), new, records.refilled(split, gone, new, n_dev, seed), regenerate, after, moved)
