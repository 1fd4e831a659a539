"""Mixing sources to target weights by Pareto order sampling, natively.

Targets: the sources in code-point order, null last, weigh `weights`, repeating, and share all words.
A target stops at `cap` times its source's words; what is above is shared by weight among the rest
until none is above (a water level: target = min(cap * words, weight * level)).

Expected copies: inside a source, longer documents are wanted more often, by the logarithm of their size
in whole binary digits. A document of b digits expects min(cap, rate * b) copies, with the source's rate such
that the expected words are its target. Its whole part are certain copies; the rest p is the probability of
one more, so probabilities differ inside a source.

Selection: the documents with 0 < p are ranked by random odds U/(1-U) divided by inclusion odds p/(1-p), and the
sample takes them in ascending order while the words still missing from the target last (a size fixed in words);
then the one document, of those left, that comes nearest to what is missing completes it, if it comes nearer.

No source is ordered in one task: the ranks, mapped to (0, 1), fall in bins of about 64 documents where the
order is cut (at most 65,536 a source); a running sum over the bins finds the one where the target is met,
and only that bin is sorted. What decides is a few numbers a source and size class, so each document's
copies follow from its own row and texts are not shuffled.

Edge cases: a null or empty text has size 0 and takes 0 words; a source without words takes no copies; null sources form one source, the last;
null ids get the random number of their text; rows that share id, source and size (and text, if the id is null)
are taken alike; an empty table gives an empty result. Other columns are not read, and kept by `mixed` under any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.ranges import running
from granary.session import stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"
BIN_DOCS = 64
MAX_BINS = 65536
#: Plans of up to this many rows (at most 64 a source) are broadcast; larger ones are joined by a shuffle.
BROADCAST_PLAN = 100_000


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A random number in (0, 1) that the id alone determines; without an id, the text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    digits = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), name), 256), 1, 13), 16, 10)
    return (digits.cast("bigint").cast("double") + 0.5) / float(1 << 52)


def _digits(size: Column) -> Column:
    """Binary digits of a size, 1 for 0: its class."""
    return F.length(F.bin(size))


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size and u."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(text).alias("size"), _draw(F.col(id_col), text, seed).alias("u"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, n_docs, source_size, target; sources are ordered in ranges, however many there are."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = running(per, [F.col("source").asc_nulls_last()], {"place": F.lit(1).cast("bigint")}, "mix-sources")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    order = [(F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    per = running(per, order, {"most_upto": "most", "weight_upto": "weight"}, "mix-levels")
    sums = per.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weights"))
    per = (
        per.join(F.broadcast(sums))
        .withColumn("level", (F.col("total") - (F.col("most_upto") - F.col("most"))) / (F.col("all_weights") - (F.col("weight_upto") - F.col("weight"))))
        .withColumn("fits", F.col("most") >= F.col("weight") * F.col("level"))
    )
    # the first source, in order of its own level, that the cap doesn't stop sets the level of all
    first = F.min_by("level", F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))))
    level = per.agg(F.coalesce(first, F.lit(0.0)).alias("common"))
    return per.join(F.broadcast(level)).select("source", "n_docs", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.col("common")).alias("target"))


def expectations(sizes: DataFrame, goal: DataFrame, cap: int = CAP) -> DataFrame:
    """goal's columns with digits, words, certain, p and missing: a row for each source and class of size.

    The rate is a water level once more, over the at most 64 classes of a source."""
    classes = sizes.groupBy("source", _digits(F.col("size")).alias("digits")).agg(F.sum("size").alias("words")).withColumnRenamed("source", "of_source")
    rows = goal.join(classes, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    larger = Window.partitionBy("source").orderBy(F.col("digits").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    heavy = F.col("words") * F.col("digits")
    rows = (
        rows.withColumn("full", F.coalesce(F.sum("words").over(larger), F.lit(0)))
        .withColumn("rest", F.sum(heavy).over(whole) - F.coalesce(F.sum(heavy).over(larger), F.lit(0)))
        .withColumn("rate", F.when(F.col("rest") > 0, (F.col("target") - cap * F.col("full")) / F.col("rest")))
    )
    held = F.max(F.when(F.col("rate") * F.col("digits") <= cap, F.struct("digits", "rate"))).over(whole)["rate"]
    expected = F.when(F.col("source_size") == 0, 0.0).when(F.col("target") >= cap * F.col("source_size"), float(cap)).otherwise(F.least(F.lit(float(cap)), F.coalesce(F.col("held") * F.col("digits"), F.lit(float(cap)))))
    rows = rows.withColumn("held", held).withColumn("expected", expected).withColumn("certain", F.floor("expected")).withColumn("p", F.col("expected") - F.col("certain"))
    rows = rows.withColumn("missing", F.col("target") - F.sum(F.col("certain") * F.col("words")).over(whole))
    return rows.select("source", "n_docs", "source_size", "target", "digits", "words", "certain", "p", "missing")


def _joined(big: DataFrame, small: DataFrame, n_small: int, *more: Column) -> DataFrame:
    """big with the columns of its source; hot sources are split by AQE where the small side is too large to broadcast."""
    small = small.withColumnRenamed("source", "of_source")
    right = F.broadcast(small) if n_small <= BROADCAST_PLAN else small
    on = F.col("source").eqNullSafe(F.col("of_source"))
    for x in more:
        on = on & x
    return big.join(right, on).drop("of_source")


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, u, p, bins) with `at` (rank, id as text, size) and `bin`, both null where p is 0."""
    odds, p = F.col("u") / (1 - F.col("u")), F.col("p")
    rows = rows.withColumn("rank", F.when(p > 0, odds * ((1 - p) / p)))
    spread = F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("bins"))
    at = F.when(p > 0, F.struct("rank", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "size"))
    return rows.withColumn("bin", F.least(F.col("bins") - 1, spread)).withColumn("at", at)


def _in(cut: str = "cut", last: str = "last") -> Column:
    """Whether a ranked row is before the place where its source's order is cut."""
    return F.when(F.col(cut).isNull() | (F.col("bin") < F.col(cut)), True).when(F.col("bin") > F.col(cut), False).otherwise(F.coalesce(F.col("at") <= F.col(last), F.lit(False)))


def planned(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, int]:
    """What decides each document's copies, a row for each source and class of size, and how many rows these are."""
    goal = expectations(sizes, targets(sizes, weights, cap), cap)
    bins = F.greatest(F.lit(1), F.least(F.lit(MAX_BINS), F.floor(F.col("n_docs") / BIN_DOCS)))
    goal = stored(goal.withColumn("bins", bins), "mix-goal")
    n = goal.count()
    classed = _joined(sizes.withColumn("own_digits", _digits(F.col("size"))), goal, n, F.col("own_digits") == F.col("digits"))
    rows = _ranked(classed).filter("p > 0").select("source", "size", "bin", "at", "missing")

    summed = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.max("missing").alias("missing"))
    order = Window.partitionBy("source").orderBy("bin")
    cuts = (
        summed.withColumn("upto", F.sum("bin_size").over(order))
        .filter(F.col("upto") > F.col("missing"))
        .groupBy("source")
        .agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("base"))).alias("first"))
        .select("source", F.col("first.bin").alias("cut"), F.col("first.base").alias("base"))
    )
    # rows that are alike are taken or left as one
    edge = _joined(rows, cuts, n).filter("bin = cut").groupBy("source", "at", "cut", "base", "missing").agg(F.sum("size").alias("alike"))
    reach = F.col("base") + F.sum("alike").over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    fits = F.col("reach") <= F.col("missing")
    edge = edge.withColumn("reach", reach).groupBy("source", "cut", "base", "missing")
    edge = edge.agg(F.max(F.when(fits, F.col("at"))).alias("last"), F.max(F.when(fits, F.col("reach"))).alias("reached"))
    edge = edge.select("source", "cut", "last", (F.col("missing") - F.coalesce("reached", "base")).alias("gap"))
    edge = stored(edge, "mix-edges")
    left = _joined(rows.drop("missing"), edge, n).filter(~_in())
    nearest = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "at")).alias("near")).select("source", F.col("near.at").alias("near"))
    last = _joined(_joined(rows.drop("missing"), edge, n), nearest, n).filter(F.col("at") == F.col("near"))
    last = last.groupBy("source", "near", "gap").agg(F.sum("size").alias("alike")).filter(F.abs(F.col("gap") - F.col("alike")) < F.col("gap"))
    ends = edge.join(last.select(F.col("source").alias("of"), F.col("near").alias("completes")), F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "gap")
    ends = ends.withColumnRenamed("source", "of")
    plan = goal.join(ends, F.col("source").eqNullSafe(F.col("of")), "left")
    return stored(plan.select("source", "source_size", "target", "digits", "certain", "p", "bins", "cut", "last", "completes"), "mix-plan"), n


def _decided(rows: DataFrame, plan: DataFrame, n_plan: int) -> DataFrame:
    """rows (doc_id, source, size, u, more) with source_size, target and copies."""
    rows = _ranked(_joined(rows.withColumn("own_digits", _digits(F.col("size"))), plan, n_plan, F.col("own_digits") == F.col("digits")))
    extra = (F.col("p") > 0) & (_in() | F.coalesce(F.col("at") == F.col("completes"), F.lit(False)))
    return rows.withColumn("copies", F.col("certain") + extra.cast("bigint"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, id_col="doc_id", text_col="text", source_col="source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole copies the mix takes), taken (words), expected (copies)."""
    sizes = stored(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    out = _decided(sizes, *planned(sizes, weights, cap))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), (F.col("certain") + F.col("p")).alias("expected"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, id_col="doc_id", text_col="text", source_col="source", seed: str = SEED) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it. The plan comes to the documents; they aren't shuffled."""
    plan, n = planned(stored(sized(docs, id_col, text_col, source_col, seed), "mix-sizes"), weights, cap)
    row = docs.select(F.struct("*").alias("row"))
    held = lambda c: F.col("row").getField(c)
    rows = row.select("row", held(id_col).alias("doc_id"), held(source_col).alias("source"), _size(held(text_col)).alias("size"), _draw(held(id_col), held(text_col), seed).alias("u"))
    taken = _decided(rows, plan, n).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")


def op7_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: One window over a source's whole order, where Spark's plan goes by bins.
OP7_SQL = r"""
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  (('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
w AS (SELECT *, 3 * source_size AS most, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per),
l AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
  coalesce(sum(most) OVER lo, 0)::BIGINT AS capped,
  ((sum(weight) OVER ()) - coalesce(sum(weight) OVER lo, 0))::BIGINT AS open_weight,
  row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS place
  FROM w WINDOW lo AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - capped)::DOUBLE / open_weight AS lev FROM l),
lam AS (SELECT coalesce(arg_min(lev, place), 0) AS level FROM v WHERE most >= weight * lev),
t AS (SELECT source, source_size, least(most::DOUBLE, weight * level) AS target FROM v, lam),
c AS (SELECT source, length(bin(size)) AS digits, sum(size)::BIGINT AS words FROM sizes GROUP BY 1, 2),
c2 AS (SELECT t.*, c.digits, c.words, coalesce(sum(words) OVER hi, 0)::BIGINT AS full_, ((sum(words * digits) OVER (PARTITION BY c.source)) - coalesce(sum(words * digits) OVER hi, 0))::BIGINT AS rest
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WINDOW hi AS (PARTITION BY c.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c3 AS (SELECT *, CASE WHEN rest > 0 THEN (target - 3 * full_) / rest END AS rate FROM c2),
c4 AS (SELECT *, arg_max(rate, digits) FILTER (rate * digits <= 3) OVER (PARTITION BY source) AS held FROM c3),
c5 AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN target >= 3 * source_size THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, coalesce(held * digits, 3.0::DOUBLE)) END AS expected FROM c4),
c6 AS (SELECT *, floor(expected)::BIGINT AS certain, expected - floor(expected) AS p, target - (sum(floor(expected)::BIGINT * words) OVER (PARTITION BY source))::BIGINT AS missing FROM c5),
r AS (SELECT s.doc_id, s.source, s.size, c6.* EXCLUDE (source), coalesce(s.doc_id::VARCHAR, '') AS name, CASE WHEN p > 0 THEN u / (1 - u) * ((1 - p) / p) END AS pareto
  FROM sizes s JOIN c6 ON s.source IS NOT DISTINCT FROM c6.source AND length(bin(s.size)) = c6.digits),
k AS (SELECT source, pareto, name, size, max(missing) AS missing, sum(size)::BIGINT AS alike FROM r WHERE p > 0 GROUP BY source, pareto, name, size),
k2 AS (SELECT *, (sum(alike) OVER (PARTITION BY source ORDER BY pareto, name, size ROWS UNBOUNDED PRECEDING))::BIGINT AS reach FROM k),
k3 AS (SELECT *, reach <= missing AS isin, missing - coalesce(max(reach) FILTER (reach <= missing) OVER (PARTITION BY source), 0) AS gap FROM k2),
k4 AS (SELECT *, row_number() OVER (PARTITION BY source, isin ORDER BY abs(gap - size), pareto, name, size) AS place FROM k3),
x AS (SELECT source, pareto, name, size, (isin OR (place = 1 AND abs(gap - alike) < gap))::BIGINT AS extra FROM k4)
SELECT r.doc_id, r.size, r.source_size, r.target, ((r.certain + coalesce(x.extra, 0)) * r.size)::BIGINT AS taken
FROM r LEFT JOIN x ON x.source IS NOT DISTINCT FROM r.source AND x.pareto = r.pareto AND x.name = r.name AND x.size = r.size
"""
