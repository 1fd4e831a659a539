"""Contexts: per (entity, condition, k) documents by recipe, padded with neutrals, in a fixed random order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import values as V
from granary.functions.hashing import draw, order_key, stable_seed
from granary.operators.ranges import running
from granary.session import stored


def recipes(spark: SparkSession, conditions: Sequence[tuple[str, int]]) -> DataFrame:
    """condition, k, cell, need: one row per cell; a few rows whatever the corpus holds."""
    unknown = [c for c, _ in conditions if c not in V.RECIPES]
    if unknown:
        raise ValueError(f"unknown condition {unknown[0]}")
    rows = [(c, k, cell, k if n == "k" else n) for c, k in conditions for cell, n in V.RECIPES[c]]
    return spark.createDataFrame(rows, "condition string, k int, cell string, need int")


def _from_pool(needing: DataFrame, neutral: DataFrame, seed: str) -> DataFrame:
    """ctx columns, doc_id, place: for each context of needing (lack > 0) the first neutrals of other entities in the ring.

    The pool stands in hash order, as a ring; a context begins at a place that its hash names. It looks at as many places
    as it lacks, and, while its entity's own neutrals were among them, at four times as many, until it has enough or has
    gone round."""
    ctx = ["pair_id", "condition", "k"]
    pool = running(neutral.withColumn("h", order_key(F.lit(seed), F.lit("pool"), F.col("doc_id"))), ["h", "doc_id"], {"spot": F.lit(1).cast("bigint")}, "neutral-pool")
    pool = stored(pool.select("owner", "doc_id", (F.col("spot") - 1).alias("spot")), "neutral-ring")
    n = pool.count()
    if not n:
        return needing.select(*ctx, F.lit(None).cast("string").alias("doc_id"), F.lit(0).alias("place")).limit(0)
    start = F.floor(draw(F.lit(seed), *[F.col(c) for c in ctx], F.lit("pool")) * n).cast("bigint")
    open_, found, wide = needing.withColumn("start", start), None, 1
    while True:
        steps = F.least(F.lit(n), F.col("lack") * wide)
        seen = open_.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), (steps - 1).cast("bigint"))))
        seen = seen.withColumn("spot", (F.col("start") + F.col("step")) % n).join(pool, "spot").filter("owner <> pair_id")
        place = F.row_number().over(Window.partitionBy(*ctx).orderBy("step"))
        got = stored(seen.withColumn("place", place).filter("place <= lack").select(*ctx, "doc_id", "place"), "ring-picks")
        whole = got.groupBy(*ctx).agg(F.count("*").alias("n_got")).join(open_.select(*ctx, "lack"), ctx).filter((F.col("n_got") == F.col("lack")) | F.lit(wide >= n))
        part = got if wide >= n else got.join(whole.select(*ctx), ctx, "left_semi")
        found = part if found is None else found.unionByName(part)
        if wide >= n:
            return found
        open_ = stored(open_.join(whole.select(*ctx), ctx, "left_anti"), "ring-open")
        if open_.isEmpty():
            return found
        wide = min(n, wide * 4)


def build(docs: DataFrame, conditions: Sequence[tuple[str, int]], n_docs: int = 7, seed: str = "1") -> tuple[DataFrame, DataFrame]:
    """docs: pair_id, doc_id, cell, level. Returns (pair_id, condition, k, pos, doc_id, cell) and (pair_id, condition, k, problem).

    Cells are taken in hash order, coordinated ones in plan order (level, then id). Own neutrals pad first; then neutrals
    of other entities, from a ring of all of them."""
    spark = docs.sparkSession
    plan = F.broadcast(recipes(spark, conditions))
    frames = F.broadcast(recipes(spark, conditions).groupBy("condition", "k").agg(F.sum("need").alias("needed")))
    ctx = ["pair_id", "condition", "k"]
    rank = F.create_map(*[x for level, r in V.LEVEL_RANK.items() for x in (F.lit(level), F.lit(r))])
    key = order_key(F.lit(seed), *[F.col(c) for c in ctx], F.col("cell"), F.col("doc_id"))
    by = F.when(F.col("cell") == "C_F", F.concat(F.coalesce(rank[F.col("level")], F.lit(9)).cast("string"), F.lit("|"), "doc_id")).otherwise(key)
    met = docs.join(plan, "cell").withColumn("place", F.row_number().over(Window.partitionBy(*ctx, "cell").orderBy(by, "doc_id")))
    chosen = stored(met.filter("place <= need").select(*ctx, "doc_id", "cell"), "context-cells")
    entities = docs.select("pair_id").distinct().crossJoin(frames)  # a few rows for each entity
    have = chosen.groupBy(*ctx).agg(F.count("*").alias("have"))
    state = stored(entities.join(have, ctx, "left").withColumn("have", F.coalesce("have", F.lit(0))), "context-state")
    fits = state.filter((F.col("have") == F.col("needed")) & (F.col("needed") <= n_docs))
    short = state.filter((F.col("have") < F.col("needed")) | (F.col("needed") > n_docs))
    errors = short.select(*ctx, F.when(F.col("have") < F.col("needed"), "too few documents for the recipe").otherwise("recipe larger than the context").alias("problem"))

    neutral = docs.filter("cell = 'H_N'").select(F.col("pair_id").alias("owner"), "doc_id")
    own = fits.join(neutral, fits["pair_id"] == neutral["owner"]).select(*ctx, "needed", "doc_id").join(chosen.select(*ctx, "doc_id"), [*ctx, "doc_id"], "left_anti")
    fill = Window.partitionBy(*ctx).orderBy(order_key(F.lit(seed), *[F.col(c) for c in ctx], F.lit("fill"), F.col("doc_id")), "doc_id")
    own = stored(own.withColumn("place", F.row_number().over(fill)).filter(F.col("place") <= n_docs - F.col("needed")).select(*ctx, "doc_id"), "own-neutrals")
    padded = own.groupBy(*ctx).agg(F.count("*").alias("own"))
    lack = F.lit(n_docs) - F.col("needed") - F.coalesce("own", F.lit(0))
    needing = stored(fits.join(padded, ctx, "left").select(*ctx, lack.cast("bigint").alias("lack")).filter("lack > 0"), "needing")
    foreign = _from_pool(needing, neutral, seed)
    spare = own.unionByName(foreign.select(*ctx, "doc_id")).withColumn("cell", F.lit("H_N"))
    rows = chosen.join(fits.select(*ctx), ctx, "left_semi").unionByName(spare)
    n = rows.groupBy(*ctx).agg(F.count("*").alias("n"))
    lacking = fits.select(*ctx).join(n, ctx, "left").filter(F.coalesce("n", F.lit(0)) < n_docs).select(*ctx, F.lit("too few neutrals").alias("problem"))
    order = Window.partitionBy(*ctx).orderBy(order_key(F.lit(seed), *[F.col(c) for c in ctx], F.lit("order"), F.col("doc_id")))
    out = rows.join(lacking, ctx, "left_anti").select(*ctx, (F.row_number().over(order) - 1).alias("pos"), "doc_id", "cell")
    return out, errors.unionByName(lacking)


def manifest(contexts: DataFrame, seed: str = "1") -> DataFrame:
    """One row per context: its order seed and its documents in order."""
    ctx = ["pair_id", "condition", "k"]
    docs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda x: x["doc_id"])
    return contexts.groupBy(*ctx).agg(docs.alias("doc_ids")).withColumn("order_seed", stable_seed(F.lit(seed), *[F.col(c) for c in ctx], F.lit("order")))


def generation_plan(entities: DataFrame) -> DataFrame:
    """entities: pair_id. Eleven rows for each: 3 true and 3 false ones by different generators, 3 copies of one cluster,
    a paraphrase and an edited copy, whose parent is the cluster's first; generators go round by the entity's number."""
    spark = entities.sparkSession
    rows = [("true", "A_T", "D0", j, j, f"AT{j}", 0) for j in range(3)] + [("false", "A_F", "D0", j, j, f"AF{j}", 0) for j in range(3)]
    rows += [("false", "C_F", "D2", j, 0, "CF", 1) for j in range(3)] + [("false", "C_F", "D3", 0, 2, "CF", 1), ("false", "C_F", "D4", 0, 0, "CF", 1)]
    template = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "slot int, stance string, cell string, level string, j int, shift int, source string, rotates int")
    numbered = running(entities.select("pair_id"), ["pair_id"], {"number": F.lit(1).cast("bigint")}, "entities").select("pair_id", (F.col("number") - 1).alias("i"))
    out = numbered.crossJoin(F.broadcast(template)).withColumn("number", F.col("i") * len(rows) + F.col("slot") + 1)
    doc_id = lambda number: F.format_string("d%06d", number)
    parent = F.when(F.col("level").isin("D3", "D4"), doc_id(F.col("number") - F.col("slot") + 6))
    return out.select(
        doc_id(F.col("number")).alias("doc_id"), "pair_id", "stance", "cell", F.col("level").alias("dependence_level"),
        F.concat(F.lit("src_"), "pair_id", F.lit("_"), "source").alias("cluster_id"), ((F.col("i") * F.col("rotates") + F.col("shift")) % 3).cast("int").alias("generator"), parent.alias("parent_doc"),
    )
