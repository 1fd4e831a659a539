"""Joins, groupings, windows, samples and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import values as V
from granary.functions.hashing import order_key
from granary.operators import contexts, curation, stats
from granary.operators.ranges import running
from granary.plans.bindings import LOG, OUTCOMES, log, outcomes
from granary.plans.registry import query
from granary.session import table
from granary.sources import latest, misses, without


@query(f"""WITH {OUTCOMES} SELECT arm, k, count(*) AS n, count(*) FILTER (outcome = 'gold') / count(*) AS accuracy, count(*) FILTER (outcome = 'attack') / count(*) AS flip,
count(*) FILTER (outcome = 'both') / count(*) AS both, count(*) FILTER (outcome = 'other') / count(*) AS other FROM o GROUP BY arm, k""")
def group_summary(spark, sf_dir):
    """Outcome shares by arm and k (A1-A4, V4, V6)."""
    return stats.outcome_shares(outcomes(spark, sf_dir), ["arm", "k"])


@query(f"""WITH {OUTCOMES} SELECT arm, k, outcome, (grouping(arm) * 4 + grouping(k) * 2 + grouping(outcome))::BIGINT AS level, count(*) AS n FROM o
GROUP BY GROUPING SETS ((arm), (k), (outcome), (arm, outcome), (k, outcome))""")
def outcome_distribution(spark, sf_dir):
    """Counts over several groupings in one pass."""
    rows, sets = outcomes(spark, sf_dir), [["arm"], ["k"], ["outcome"], ["arm", "outcome"], ["k", "outcome"]]
    held = rows.groupingSets([[F.col(c) for c in x] for x in sets], "arm", "k", "outcome")
    return held.agg(F.grouping_id("arm", "k", "outcome").alias("level"), F.count("*").alias("n")).select("arm", "k", "outcome", "level", "n")


@query(f"""WITH {OUTCOMES} SELECT arm, count(*) FILTER (outcome = 'gold') AS gold, count(*) FILTER (outcome = 'attack') AS attack, count(*) FILTER (outcome = 'both') AS both, count(*) FILTER (outcome = 'other') AS other FROM o GROUP BY arm""")
def count_matrix(spark, sf_dir):
    """Arms by outcomes, as a matrix."""
    return outcomes(spark, sf_dir).groupBy("arm").pivot("outcome", ["gold", "attack", "both", "other"]).count().na.fill(0)


@query(f"""WITH {OUTCOMES}, c AS (SELECT arm, k, avg((outcome = 'gold')::INT) AS acc FROM o GROUP BY arm, k), b AS (SELECT k, acc AS base FROM c WHERE arm = 'view')
SELECT arm, k, round(100 * (acc - base), 6) AS points FROM c JOIN b USING (k)""")
def accuracy_grid(spark, sf_dir):
    """Accuracy of each arm and k less that of the baseline arm."""
    acc = outcomes(spark, sf_dir).groupBy("arm", "k").agg(F.avg((F.col("outcome") == "gold").cast("int")).alias("acc"))
    base = F.max(F.when(F.col("arm") == "view", F.col("acc"))).over(Window.partitionBy("k"))
    return acc.select("arm", "k", F.round(100 * (F.col("acc") - base), 6).alias("points"))


_PAIRED = f"""WITH {OUTCOMES}, a AS (SELECT pair_id, k, avg((outcome = 'gold')::INT) AS x FROM o WHERE arm = 'click' GROUP BY 1, 2), b AS (SELECT pair_id, k, avg((outcome = 'gold')::INT) AS x FROM o WHERE arm = 'view' GROUP BY 1, 2)"""


def _arms(spark, sf_dir):
    rows = outcomes(spark, sf_dir).groupBy("pair_id", "k", "arm").agg(F.avg((F.col("outcome") == "gold").cast("int")).alias("x"))
    return stats.paired(rows, ["pair_id", "k"], "arm", "click", "view", F.col("x"))


@query(_PAIRED + " SELECT pair_id, k, round(a.x, 9) AS value_a, round(b.x, 9) AS value_b, round(a.x - b.x, 9) AS diff FROM a JOIN b USING (pair_id, k)")
def paired_delta(spark, sf_dir):
    """Two arms on the keys that both have, without a self-join."""
    return _arms(spark, sf_dir).select("pair_id", "k", *[F.round(c, 9).alias(c) for c in ("value_a", "value_b", "diff")])


@query(_PAIRED + ", d AS (SELECT pair_id, sum(a.x - b.x) AS s, count(*) AS n FROM a JOIN b USING (pair_id, k) GROUP BY pair_id) SELECT count(*) AS n_clusters, round(sum(s) / sum(n), 9) AS estimate FROM d")
def arm_vs_base(spark, sf_dir):
    """Ratio of sums of the paired differences over clusters."""
    parts = stats.cluster_components(_arms(spark, sf_dir), "pair_id", {"d": F.col("diff")})
    return stats.estimates(parts, {"d": "d"}).select("n_clusters", F.round("estimate", 9).alias("estimate"))


@query()
def cluster_bootstrap_ci(spark, sf_dir):
    """Percentile intervals of that estimate from 20,000 resamples of the clusters, and its verdict."""
    parts = stats.cluster_components(_arms(spark, sf_dir), "pair_id", {"d": F.col("diff")})
    out = stats.cluster_bootstrap(parts, "pair_id", {"d": "d"}, 20_000, alphas=(0.05, 0.01))
    return out.drop("statistic").withColumn("verdict", stats.verdict(F.lit(1), F.col("lo"), F.col("hi")))


#: name -> arms, base, the k that count, outcome: the four claims' differences, over the events' arms.
_CLAIMS = {
    "one": (("purchase",), "click", (1, 2), "gold"),
    "flips": (("click",), "view", (1,), "attack"),
    "first_false": (("click",), "view", (1,), "gold"),
    "first_true": (("click",), "view", (0,), "gold"),
    "second_false": (("purchase",), "view", (1,), "gold"),
    "second_true": (("purchase",), "view", (0,), "gold"),
    "pooled": (("click", "purchase"), "view", (1, 2), "gold"),
}
#: claim -> statistic of those differences.
_STATISTICS = {"scheme_gap": "one", "flip_gap": "flips", "form_bias": "((first_false - first_true) + (second_false - second_true)) / 2", "counting": "pooled", "form_bias_first": "first_false - first_true"}


def _claim_components(spark, sf_dir):
    o, unit = outcomes(spark, sf_dir).groupBy("pair_id", "k", "arm").agg(F.min_by("outcome", "event_id").alias("outcome")), ["pair_id", "k"]
    units = None
    for kind in ("gold", "attack"):
        named = {n: (arms, base, F.col("k").isin(*ks)) for n, (arms, base, ks, hit) in _CLAIMS.items() if hit == kind}
        found = stats.shifts(o, unit, "arm", F.col("outcome") == kind, named)
        units = found if units is None else units.join(found, unit, "full")
    return stats.shift_components(units, "pair_id", list(_CLAIMS))


def _claims_sql():
    parts = []
    for name, (arms, base, ks, hit) in _CLAIMS.items():
        listed = ", ".join(f"'{a}'" for a in arms)
        parts.append(f"SELECT '{name}' AS name, sum((a.outcome = '{hit}')::INT - (b.outcome = '{hit}')::INT) / count(*) AS m FROM f a JOIN f b ON a.pair_id = b.pair_id AND a.k = b.k AND a.arm IN ({listed}) AND b.arm = '{base}' WHERE a.k IN ({', '.join(map(str, ks))})")
    wide = ", ".join(f"max(m) FILTER (name = '{n}') AS {n}" for n in _CLAIMS)
    rows = " UNION ALL ".join(f"SELECT '{claim}' AS statistic, round({e}, 9) AS estimate FROM w" for claim, e in _STATISTICS.items())
    return f"WITH {OUTCOMES}, f AS (SELECT pair_id, k, arm, arg_min(outcome, event_id) AS outcome FROM o GROUP BY 1, 2, 3), c AS ({' UNION ALL '.join(parts)}), w AS (SELECT {wide} FROM c) {rows}"


@query(_claims_sql())
def claim_estimates(spark, sf_dir):
    """Four claims as statistics of several differences of arms: one pair of arms, flips, a difference of differences
    averaged over two arms, and two arms pooled (M6, V9)."""
    return stats.estimates(_claim_components(spark, sf_dir), _STATISTICS).select("statistic", F.round("estimate", 9).alias("estimate"))


@query()
def claim_intervals(spark, sf_dir):
    """Those claims with intervals at two levels and their verdicts, all from the same 20,000 resamples."""
    out = stats.cluster_bootstrap(_claim_components(spark, sf_dir), "pair_id", _STATISTICS, 20_000, alphas=(0.05, 0.0125))
    return out.withColumn("verdict", stats.verdict(F.lit(1), F.col("lo"), F.col("hi")))


@query()
def shift_intervals(spark, sf_dir):
    """Each arm's shift against the baseline by k, with intervals (M5, V8)."""
    o = outcomes(spark, sf_dir).groupBy("pair_id", "k", "arm").agg(F.min_by("outcome", "event_id").alias("outcome"))
    named = {f"{arm}_{k}": ((arm,), "view", F.col("k") == k) for arm in ("click", "purchase") for k in range(3)}
    parts = stats.shift_components(stats.shifts(o, ["pair_id", "k"], "arm", F.col("outcome") == "gold", named), "pair_id", list(named))
    return stats.cluster_bootstrap(parts, "pair_id", {n: n for n in named}, 20_000).drop("alpha")


@query()
def proportion_intervals(spark, sf_dir):
    """A proportion, and the difference of two independent samples' proportions, with intervals (M4)."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    toxic, long = F.col("toxic").cast("double"), F.col("n_chars") > 2000
    samples = {"whole": toxic, "long": F.when(long, toxic), "short": F.when(~long, toxic)}
    return stats.samples_bootstrap(rows, "doc_id", samples, {"toxic": "whole", "long_less_short": "long - short"}, resamples=20_000).drop("alpha")


@query(f"""WITH {OUTCOMES}, g AS (SELECT DISTINCT pair_id FROM o WHERE outcome = 'attack' AND arm = 'click'), h AS (SELECT DISTINCT pair_id FROM o WHERE outcome = 'attack' AND arm = 'view')
SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM h)) AS n_both, (SELECT min(pair_id) FROM (SELECT * FROM g INTERSECT SELECT * FROM h)) AS first_both, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM h)) AS n_only,
(SELECT count(*) FROM (SELECT * FROM g UNION SELECT * FROM h)) AS n_any""")
def key_sets(spark, sf_dir):
    """Intersection, difference and union of key sets, and the least common key."""
    o = outcomes(spark, sf_dir).filter("outcome = 'attack'")
    held = o.groupBy("pair_id").agg(F.max(F.col("arm") == "click").alias("g"), F.max(F.col("arm") == "view").alias("h"))
    both = F.col("g") & F.col("h")
    return held.agg(F.count_if(both).alias("n_both"), F.min(F.when(both, F.col("pair_id"))).alias("first_both"), F.count_if(F.col("g") & ~F.col("h")).alias("n_only"), F.count_if(F.col("g") | F.col("h")).alias("n_any"))


@query("""SELECT doc_id, printf('p%06d', row_number() OVER (ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 9 END, n_chars, doc_id)) AS pair_id FROM documents""")
def sequential_ids(spark, sf_dir):
    """Ids by a composite order (W3, W12); ranges first, then places inside them, so no task sorts all rows."""
    kind = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(9)
    rows = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), "n_chars")
    out = running(rows, ["kind", "n_chars", "doc_id"], {"place": F.lit(1).cast("bigint")}, "sequence")
    return out.select("doc_id", F.format_string("p%06d", "place").alias("pair_id"))


@query("""SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 3""")
def first_n_per_group(spark, sf_dir):
    """The three longest documents of each source."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return curation.first_n(rows, ["source"], [F.col("n_chars").desc(), "doc_id"], 3).select("source", "doc_id", F.col("place").cast("bigint").alias("place"))


@query("""WITH n AS (SELECT count(DISTINCT lang) AS g FROM documents), r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('audit|' || lang || '|' || doc_id), doc_id) AS place FROM documents)
SELECT lang, doc_id FROM r, n WHERE place <= greatest(1, 40 // g)""")
def stratified_sample(spark, sf_dir):
    """max(1, 40 // groups) documents of each language in hash order."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id")
    most = max(1, 40 // (rows.agg(F.count_distinct("lang")).first()[0] or 1))  # a literal, so each task keeps its first ones alone
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order_key(F.lit("audit"), F.col("lang"), F.col("doc_id")), "doc_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("lang", "doc_id")


@query("""WITH t AS (SELECT count(*) AS total FROM documents), s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
q AS (SELECT source, CASE WHEN abs(200 * n / total - floor(200 * n / total) - 0.5) < 1e-12 THEN 2 * round(200 * n / total / 2) ELSE round(200 * n / total) END AS quota FROM s, t),
r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('split|' || source || '|' || doc_id), doc_id) AS place FROM documents)
SELECT doc_id, CASE WHEN place <= quota THEN 'dev' ELSE 'test' END AS split FROM r JOIN q USING (source)""")
def stratified_split(spark, sf_dir):
    """Development and test split by source, shares rounded half to even."""
    return curation.split(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 200, "split").select("doc_id", "split")


@query("""SELECT d.doc_id, ntile(2) OVER (ORDER BY sha256('half|' || doc_id), doc_id)::INT AS half FROM documents d""")
def half_split(spark, sf_dir):
    """Two halves in hash order (S13), from ranks inside hash ranges."""
    rows = table(spark, sf_dir, "documents").select("doc_id", order_key(F.lit("half"), F.col("doc_id")).alias("h"))
    out = running(rows, ["h", "doc_id"], {"place": F.lit(1).cast("bigint")}, "halves")
    out = out.join(F.broadcast(out.agg(F.count("*").alias("total"))))
    return out.select("doc_id", F.when(F.col("place") <= F.ceil(F.col("total") / 2), 1).otherwise(2).alias("half"))


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_work(spark, sf_dir):
    """Documents that still lack a label (IO12, J3, U4)."""
    return curation.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def flagged_documents(spark, sf_dir):
    """Documents with a toxic label (J2, P12, IO13)."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi")


@query("""WITH c AS (SELECT conv_id, turn, role, turn - 1 - conv_id % 2 AS parent FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN b.turn IS NULL THEN 'parent missing' ELSE 'parent of the same role' END AS problem
FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.turn = a.parent WHERE a.turn > 0 AND (b.turn IS NULL OR b.role = a.role)""")
def conversation_lineage(spark, sf_dir):
    """Turns whose predecessor (in odd conversations the one before it) is missing or of the same role."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    parent = c.select("conv_id", F.col("turn").alias("parent"), F.col("role").alias("before"), F.lit(True).alias("held"))
    out = c.filter("turn > 0").withColumn("parent", F.col("turn") - 1 - F.col("conv_id") % 2).join(parent, ["conv_id", "parent"], "left")
    problem = F.when(F.col("held").isNull(), "parent missing").when(F.col("before") == F.col("role"), "parent of the same role")
    return out.select("conv_id", "turn", problem.alias("problem")).filter("problem IS NOT NULL")


@query(f"""WITH {LOG}, k AS (SELECT doc_id, model, CASE WHEN doc_id[2:]::BIGINT % 7 = 0 THEN parent_doc || 'x' ELSE parent_doc END AS parent_doc FROM log)
SELECT a.doc_id AS id, CASE WHEN b.doc_id IS NULL THEN 'parent missing' ELSE 'parent of another group' END AS problem
FROM k a LEFT JOIN k b ON b.doc_id = a.parent_doc WHERE a.parent_doc IS NOT NULL AND (b.doc_id IS NULL OR b.model <> a.model)""")
def lineage_check(spark, sf_dir):
    """Parents of the log, some of which are misspelt here, that are missing or by another maker."""
    misspelt = F.when(F.substring("doc_id", 2, 20).cast("bigint") % 7 == 0, F.concat("parent_doc", F.lit("x"))).otherwise(F.col("parent_doc"))
    return curation.lineage(log(spark, sf_dir).withColumn("parent_doc", misspelt), "doc_id", "parent_doc", "model")


@query("""WITH f AS (SELECT DISTINCT conv_id FROM conversations WHERE contains(text, '!')) SELECT conv_id, count(*) AS n_turns FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM f) GROUP BY conv_id""")
def flagged_context_drop(spark, sf_dir):
    """Conversations without a flagged turn (J10, R6): one grouping, no join."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max(F.contains("text", F.lit("!"))).alias("flagged"))
    return c.filter("NOT flagged").select("conv_id", "n_turns")


@query(f"""WITH {OUTCOMES}, p AS (SELECT pair_id AS entity, count(*) AS attempts, count(DISTINCT arm) AS makers FROM o WHERE outcome <> 'gold' GROUP BY pair_id)
SELECT entity, attempts, makers FROM p WHERE attempts >= 10 AND makers >= 2""")
def exclusion_evidence(spark, sf_dir):
    """Entities that failed ten times with two makers at least."""
    o = outcomes(spark, sf_dir).filter("outcome <> 'gold'").select(F.col("pair_id").alias("entity"), F.col("arm").alias("maker"))
    entities = outcomes(spark, sf_dir).select(F.col("pair_id").alias("entity"), F.lit(False).alias("exempt")).distinct()
    return curation.exclusions(entities, o)


@query("""WITH u AS (SELECT c_custkey AS id, c_acctbal AS value, 0 AS rank FROM customer UNION ALL SELECT o_custkey, max(o_totalprice), 1 FROM orders GROUP BY o_custkey)
SELECT id, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank DESC) AS p FROM u) WHERE p = 1""")
def later_source_wins(spark, sf_dir):
    """Union of sources of which the later one wins (IO14, U1)."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    newer = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("value"))
    return curation.union_latest(base, newer, key="id")


@query("""SELECT d.doc_id, coalesce(l.quality, 9)::INT AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def merge_carryover(spark, sf_dir):
    """New rows with the values that the previous version held."""
    new = table(spark, sf_dir, "documents").select("doc_id", F.lit(9).alias("quality"))
    return curation.carried_over(new, table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], ["quality"]).select("doc_id", "quality")


@query("""SELECT o_custkey, arg_max(o_orderkey, o_orderdate::VARCHAR || printf('%012d', o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def latest_per_key(spark, sf_dir):
    """An append-only log read as the last row of each key (IO11, A22)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.col("o_orderdate").cast("string"), F.format_string("%012d", "o_orderkey")).alias("at"))
    return latest(o, "o_custkey", "at").select("o_custkey", "o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)""")
def cache_misses(spark, sf_dir):
    """Keys that a cache lacks (F6, IO15, J16)."""
    cache = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return misses(without(table(spark, sf_dir, "customer").select("c_custkey"), cache, "c_custkey"), cache, "c_custkey")


@query("""SELECT c.c_custkey, count(o.o_orderkey) AS n_orders, CASE WHEN count(o.o_orderkey) = 0 THEN 'no_chunks' END AS flag FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def unmatched_flags(spark, sf_dir):
    """Left join whose unmatched rows are flagged (J5, TB9)."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    out = table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0).cast("bigint")))
    return out.withColumn("flag", F.when(F.col("n_orders") == 0, "no_chunks"))


@query("""WITH s AS (SELECT o_custkey AS ctx, o_orderkey AS pos, o_totalprice AS s FROM orders), w AS (SELECT *, max(s) OVER (PARTITION BY ctx) AS hi, min(s) OVER (PARTITION BY ctx) AS lo FROM s)
SELECT ctx, pos, round(CASE WHEN hi <= 1e-12 THEN 1.0 ELSE least(1.0, greatest(0.1, s / hi)) END, 9) AS maxnorm, round(CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END, 9) AS minshift, round(greatest(0.1, least(1.0, s / 500000)), 9) AS clip FROM w""")
def multipliers(spark, sf_dir):
    """Scores as multipliers: max-normalised, min-shifted, clipped."""
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ctx"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("s"))
    x = F.col("s")
    return s.select("ctx", "pos", F.round(stats.max_normalized(x, ["ctx"]), 9).alias("maxnorm"), F.round(stats.min_shifted(x, ["ctx"]), 9).alias("minshift"), F.round(stats.clipped(x / 500000), 9).alias("clip"))


@query("""WITH t AS (SELECT o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey, o_orderstatus) AS mine, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS whole, o_orderkey FROM orders)
SELECT o_orderkey, round(mine / whole, 9) AS share FROM t""")
def weight_share(spark, sf_dir):
    """Share of a group's weight in its context."""
    mine = F.sum("o_totalprice").over(Window.partitionBy("o_custkey", "o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(mine / F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 9).alias("share"))


@query("""SELECT o_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_extendedprice, l_linenumber) AS ranked, count(*) FILTER (l_returnflag = 'R') AS n_flagged FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING count(*) FILTER (l_returnflag = 'R') = 1""")
def single_flagged_groups(spark, sf_dir):
    """Groups with just one flagged member, members sorted by weight."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice", "l_returnflag")
    held = lines.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").groupBy("o_orderkey")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("l_extendedprice", "l_linenumber"))), lambda x: x["l_linenumber"])
    return held.agg(F.array_join(ranked.cast("array<string>"), ",").alias("ranked"), F.count_if(F.col("l_returnflag") == "R").alias("n_flagged")).filter("n_flagged = 1")


@query(f"""WITH {LOG} SELECT cluster_id, min(pair_id) AS pair_id, min(stance) AS stance, count(*) AS size, coalesce(min(doc_id) FILTER (parent_doc IS NULL), min(doc_id)) AS root, string_agg(doc_id, ',' ORDER BY doc_id) AS members,
CASE WHEN list_sort(list_distinct(list(cell))) = ['H_T'] THEN 'human_paragraph' WHEN list_sort(list_distinct(list(cell))) = ['H_F'] THEN 'human_paragraph_value_substituted' WHEN list_sort(list_distinct(list(cell))) = ['H_N'] THEN 'human_paragraph_neutral'
WHEN list_sort(list_distinct(list(cell))) = ['G_F'] THEN 'cram_misinformation' WHEN list_sort(list_distinct(list(dependence_level))) = ['D0'] THEN 'singleton'
ELSE concat_ws('+', CASE WHEN bool_or(dependence_level = 'D2') THEN 'same_model_same_prompt' END, CASE WHEN bool_or(dependence_level = 'D3') THEN 'paraphrase' END) END AS kind,
count(DISTINCT pair_id) = 1 AND count(DISTINCT stance) = 1 AS consistent FROM log GROUP BY cluster_id""")
def sealed_clusters(spark, sf_dir):
    """Clusters of the log with members, root and kind."""
    return curation.grouped_clusters(log(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


@query(f"""WITH {LOG}, p AS (SELECT DISTINCT pair_id FROM log), n AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS i FROM p),
t(slot, stance, cell, level, shift, source, rotates) AS (VALUES (0,'true','A_T','D0',0,'AT0',0),(1,'true','A_T','D0',1,'AT1',0),(2,'true','A_T','D0',2,'AT2',0),(3,'false','A_F','D0',0,'AF0',0),(4,'false','A_F','D0',1,'AF1',0),(5,'false','A_F','D0',2,'AF2',0),
(6,'false','C_F','D2',0,'CF',1),(7,'false','C_F','D2',0,'CF',1),(8,'false','C_F','D2',0,'CF',1),(9,'false','C_F','D3',2,'CF',1),(10,'false','C_F','D4',0,'CF',1))
SELECT printf('d%06d', i * 11 + slot + 1) AS doc_id, pair_id, stance, cell, level AS dependence_level, 'src_' || pair_id || '_' || source AS cluster_id, ((i * rotates + shift) % 3)::INT AS generator,
CASE WHEN level IN ('D3','D4') THEN printf('d%06d', i * 11 + 7) END AS parent_doc FROM n, t""")
def plan_template(spark, sf_dir):
    """Eleven planned rows for each pair, generators in rotation."""
    return contexts.generation_plan(log(spark, sf_dir).select("pair_id").distinct())


CONDITIONS = (("clean", 0), ("shortcut", 1), ("coordinated", 2), ("all_human", 0))


def _log_for_contexts(spark, sf_dir):
    return log(spark, sf_dir).select("pair_id", "doc_id", "cell", F.col("dependence_level").alias("level"))


def _contexts_sql():
    """The contexts step by step, each context meeting the whole ring where Spark's plan goes round it in pieces."""
    recipe = [(c, k, cell, k if n == "k" else n) for c, k in CONDITIONS for cell, n in V.RECIPES[c]]
    values = ", ".join(f"('{c}', {k}, '{cell}', {n})" for c, k, cell, n in recipe)
    rank = " ".join(f"WHEN '{level}' THEN '{r}'" for level, r in V.LEVEL_RANK.items())
    key = lambda *more: "sha256('1|' || pair_id || '|' || condition || '|' || k || '|' || " + " || '|' || ".join(more) + ")"
    return f"""WITH {LOG}, d AS (SELECT pair_id, doc_id, cell, dependence_level AS level FROM log), r(condition, k, cell, need) AS (VALUES {values}), f AS (SELECT condition, k, sum(need)::BIGINT AS needed FROM r GROUP BY 1, 2),
j AS (SELECT d.*, r.condition, r.k, r.need FROM d JOIN r ON r.cell = d.cell),
m AS (SELECT *, row_number() OVER (PARTITION BY pair_id, condition, k, cell ORDER BY CASE WHEN cell = 'C_F' THEN (CASE level {rank} ELSE '9' END) || '|' || doc_id ELSE {key("cell", "doc_id")} END, doc_id) AS place FROM j),
chosen AS (SELECT pair_id, condition, k, doc_id, cell FROM m WHERE place <= need), h AS (SELECT pair_id, condition, k, count(*) AS have FROM chosen GROUP BY 1, 2, 3),
state AS (SELECT p.pair_id, f.*, coalesce(h.have, 0) AS have FROM (SELECT DISTINCT pair_id FROM d) p CROSS JOIN f LEFT JOIN h ON h.pair_id = p.pair_id AND h.condition = f.condition AND h.k = f.k),
fits AS (SELECT * FROM state WHERE have = needed AND needed <= 7), neutral AS (SELECT pair_id AS owner, doc_id FROM d WHERE cell = 'H_N'),
own AS (SELECT pair_id, condition, k, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, condition, k ORDER BY {key("'fill'", "doc_id")}, doc_id) AS place FROM fits JOIN neutral ON owner = pair_id) WHERE place <= 7 - needed),
needing AS (SELECT *, floor(('0x' || substr({key("'pool'")}, 1, 13))::BIGINT / 4503599627370496.0 * (SELECT count(*) FROM neutral))::BIGINT AS start FROM (
  SELECT pair_id, condition, k, 7 - needed - (SELECT count(*) FROM own o WHERE o.pair_id = x.pair_id AND o.condition = x.condition AND o.k = x.k) AS lack FROM fits x) WHERE lack > 0),
ring AS (SELECT *, row_number() OVER (ORDER BY sha256('1|pool|' || doc_id), doc_id) - 1 AS spot, count(*) OVER () AS n FROM neutral),
picks AS (SELECT *, row_number() OVER (PARTITION BY pair_id, condition, k ORDER BY (spot - start + n) % n) AS place FROM needing, ring WHERE owner <> pair_id),
whole AS (SELECT c.* FROM chosen c SEMI JOIN fits USING (pair_id, condition, k) UNION ALL SELECT pair_id, condition, k, doc_id, 'H_N' FROM own UNION ALL SELECT pair_id, condition, k, doc_id, 'H_N' FROM picks WHERE place <= lack),
sized AS (SELECT *, count(*) OVER (PARTITION BY pair_id, condition, k) AS n FROM whole),
contexts AS (SELECT pair_id, condition, k, row_number() OVER (PARTITION BY pair_id, condition, k ORDER BY {key("'order'", "doc_id")}) - 1 AS pos, doc_id, cell FROM sized WHERE n = 7),
errors AS (SELECT pair_id, condition, k, CASE WHEN have < needed THEN 'too few documents for the recipe' ELSE 'recipe larger than the context' END AS problem FROM state WHERE have < needed OR needed > 7
  UNION ALL SELECT pair_id, condition, k, 'too few neutrals' FROM fits ANTI JOIN contexts USING (pair_id, condition, k))"""


@query(_contexts_sql() + " SELECT * FROM contexts")
def context_build(spark, sf_dir):
    """Contexts of seven documents by recipe, padded with neutrals, in order."""
    return contexts.build(_log_for_contexts(spark, sf_dir), CONDITIONS)[0]


@query(_contexts_sql() + " SELECT * FROM errors")
def context_errors(spark, sf_dir):
    """Contexts that can't be built, and why."""
    return contexts.build(_log_for_contexts(spark, sf_dir), CONDITIONS)[1]


@query(
    _contexts_sql()
    + " SELECT pair_id, condition, k, string_agg(doc_id, ',' ORDER BY pos) AS doc_ids, ('0x' || substr(sha256('1|' || pair_id || '|' || condition || '|' || k || '|order'), 1, 16))::UBIGINT::VARCHAR AS order_seed FROM contexts GROUP BY ALL"
)
def context_manifest(spark, sf_dir):
    """Documents of each context in order, with the order's seed (TB12, H2)."""
    out = contexts.manifest(contexts.build(_log_for_contexts(spark, sf_dir), CONDITIONS)[0])
    return out.withColumns({"doc_ids": F.array_join("doc_ids", ","), "order_seed": F.col("order_seed").cast("string")})
