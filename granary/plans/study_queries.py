"""The repair round, the dataset card, the protocol's table, and reports of fitted arms over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import features, hashing
from granary.functions import text as T
from granary.operators import curation, repair, signals, stats
from granary.plans.bindings import LOG, OUTCOMES, log, outcomes
from granary.plans.registry import query
from granary.session import stored, table

_ROUND = """d AS (SELECT doc_id, format('p{:04d}', doc_id + 1) AS pair_id, CASE WHEN doc_id % 2 = 0 THEN 'nq' ELSE 'trivia' END AS kind, doc_id % 7 = 3 AS gone, doc_id % 21 = 5 AS replaced, CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'test' END AS split FROM documents),
need AS (SELECT kind, count(*) FILTER (gone) - count(*) FILTER (replaced) AS needed FROM d GROUP BY kind),
c AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'nq' ELSE 'trivia' END AS kind, coalesce(url, '') AS text FROM pages),
folded AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS f FROM c), one AS (SELECT * FROM folded QUALIFY row_number() OVER (PARTITION BY f ORDER BY page_id) = 1),
pick AS (SELECT * FROM (SELECT one.*, row_number() OVER (PARTITION BY kind ORDER BY page_id) AS r FROM one) JOIN need USING (kind) WHERE r <= needed),
new AS (SELECT format('p{:04d}', (SELECT max(doc_id) + 1 FROM documents) + row_number() OVER (ORDER BY kind, page_id)) AS pair_id FROM pick),
stays AS (SELECT pair_id, split FROM d WHERE NOT gone), ranked AS (SELECT pair_id, row_number() OVER (ORDER BY sha256('round|' || pair_id), pair_id) AS place FROM new),
s AS (SELECT pair_id, split FROM stays UNION ALL SELECT pair_id, CASE WHEN place <= (SELECT greatest(0, 180 - count(*) FILTER (split = 'dev')) FROM stays) THEN 'dev' ELSE 'test' END FROM ranked)"""


def _round(spark, sf_dir):
    """Documents as pairs and as a plan: a seventh of the pairs is excluded, some are replacements of a former round, pages
    are the candidates; every document is written, some with violations or unresolved."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    pair, doc = F.format_string("p%04d", F.col("doc_id") + 1), F.format_string("d%08d", "doc_id")
    kind = F.when(F.col("doc_id") % 2 == 0, "nq").otherwise("trivia")
    pairs = d.select(pair.alias("pair_id"), F.concat(kind, F.lit(":"), F.col("doc_id").cast("string")).alias("source"), F.lit("q").alias("question"), F.lit(None).cast("string").alias("excluded"), F.when(F.col("doc_id") % 21 == 5, F.concat(F.lit("old"), F.lit(repair.REPLACED))).alias("notes"))
    split = d.select(pair.alias("pair_id"), F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("test").alias("split"))
    i = F.col("doc_id")
    plan = d.select(doc.alias("doc_id"), pair.alias("pair_id"), F.when(i % 4 == 1, F.format_string("d%08d", i - 1)).alias("parent_doc"), F.when(i % 6 == 2, "D4").otherwise("D0").alias("dependence_level"), F.concat(F.lit("m"), (i % 3).cast("string")).alias("model"))
    generated = d.select(doc.alias("doc_id"), (i % 11 == 4).alias("unresolved"), (i % 2).cast("int").alias("seed_offset"))
    violations = d.filter("doc_id % 8 = 0 OR doc_id % 8 = 7").select(doc.alias("doc_id"))
    reasons = d.filter("doc_id % 7 = 3").select(pair.alias("pair_id"), F.lit("value denied").alias("reason"))
    page = F.col("page_id")
    candidates = table(spark, sf_dir, "pages").select(F.concat(F.when(page % 3 == 0, "nq").otherwise("trivia"), F.lit(":page "), page.cast("string")).alias("source"), F.lit("q").alias("question"), F.coalesce("url", F.lit("")).alias("text"), page.alias("place"))
    return repair.repaired(pairs, split, plan, generated, violations, reasons, candidates, candidates.limit(0), 180, ("m0", "m1", "m2"), "round")


@query(f"WITH {_ROUND} SELECT pair_id, split FROM s")
def repair_split(spark, sf_dir):
    """The split after a repair round: excluded pairs leave, replacements come and fill the development part."""
    return _round(spark, sf_dir).split


@query("""WITH d AS (SELECT doc_id AS i, doc_id % 7 = 3 AS gone, doc_id % 8 IN (0, 7) OR doc_id % 11 = 4 AS bad FROM documents), f AS (SELECT i FROM d WHERE bad AND NOT gone),
k AS (SELECT i FROM d WHERE i % 4 = 1 AND i - 1 IN (SELECT i FROM f)), r AS (SELECT i FROM f UNION SELECT i FROM k)
SELECT format('d{:08d}', i) AS doc_id, CASE WHEN i IN (SELECT i FROM f) AND i % 6 <> 2 AND NOT (i % 2 = 0 AND i % 11 <> 4) THEN 'm' || (i + 1) % 3 END AS next FROM r""")
def repair_regeneration(spark, sf_dir):
    """What a repair round has written again, and by which other maker."""
    done = _round(spark, sf_dir)
    return done.regenerate.join(done.reassigned, "doc_id", "left").select("doc_id", F.col("to").alias("next"))


@query(f"""WITH {LOG}, e AS (SELECT 'cell' AS section, cell AS a, '' AS b FROM log UNION ALL SELECT 'stance and author', stance, author FROM log UNION ALL SELECT 'generator and stance', coalesce(model, 'human'), stance FROM log
UNION ALL SELECT 'shape and stance', CASE WHEN length(text) % 2 = 0 THEN 'targeted' ELSE '-' END, stance FROM log WHERE author = 'llm' UNION ALL SELECT 'level', dependence_level, '' FROM log
UNION ALL SELECT 'salvaged', CASE WHEN substr(doc_id, 2)::BIGINT % 9 = 4 THEN 'yes' ELSE 'no' END, '' FROM log WHERE author = 'llm' AND cell <> 'G_F')
SELECT section, a, b, count(*) AS n FROM e GROUP BY ALL""")
def card_counts(spark, sf_dir):
    """The counts of the dataset card, all sections from one pass."""
    rows = log(spark, sf_dir)
    llm, salvaged = F.col("author") == "llm", F.substring("doc_id", 2, 20).cast("bigint") % 9 == 4
    part = lambda section, a, b=F.lit(""), when=F.lit(True): F.when(when, F.struct(F.lit(section).alias("section"), a.alias("a"), b.alias("b")))  # noqa: E731, B008
    parts = F.array_compact(F.array(
        part("cell", F.col("cell")), part("stance and author", F.col("stance"), F.col("author")), part("generator and stance", F.coalesce("model", F.lit("human")), F.col("stance")),
        part("shape and stance", F.when(F.length("text") % 2 == 0, "targeted").otherwise("-"), F.col("stance"), llm), part("level", F.col("dependence_level")),
        part("salvaged", F.when(salvaged, "yes").otherwise("no"), when=llm & (F.col("cell") != "G_F")),
    ))
    return rows.select(F.explode(parts).alias("x")).groupBy("x.section", "x.a", "x.b").agg(F.count("*").alias("n"))


@query(f"""WITH {LOG}, w AS (SELECT cell, len(regexp_extract_all(text, '\\S+')) AS n, substr(doc_id, 2)::BIGINT % 10 < 3 AS denied, length(text) % 7 AS markers FROM log)
SELECT cell, median(n)::DOUBLE AS median_words, min(n)::BIGINT AS min_words, max(n)::BIGINT AS max_words, round(avg(denied::INT), 6) AS denied, round(avg(100.0 * markers / greatest(1, n)), 6) AS density FROM w GROUP BY cell""")
def card_profiles(spark, sf_dir):
    """Lengths, denials and marker density by cell, as the dataset card states them."""
    n = T.word_count(F.col("text")).cast("bigint")
    rows = log(spark, sf_dir).select("cell", n.alias("n"), (F.substring("doc_id", 2, 20).cast("bigint") % 10 < 3).cast("int").alias("denied"), (F.length("text") % 7).alias("markers"))
    density = 100.0 * F.col("markers") / F.greatest(F.lit(1), F.col("n"))
    return rows.groupBy("cell").agg(F.percentile("n", 0.5).alias("median_words"), F.min("n").alias("min_words"), F.max("n").alias("max_words"), F.round(F.avg("denied"), 6).alias("denied"), F.round(F.avg(density), 6).alias("density"))


@query(f"""WITH {OUTCOMES}, l AS (SELECT pair_id, k, arm, arg_max(outcome, event_id) AS outcome FROM o GROUP BY ALL),
m AS (SELECT a.*, b.outcome AS base FROM l a LEFT JOIN l b ON b.pair_id = a.pair_id AND b.k = a.k AND b.arm = 'view' AND a.arm <> 'view')
SELECT k, arm, count(*) AS n, round(100.0 * avg((outcome = 'gold')::INT), 6) AS accuracy, round(100.0 * avg((outcome = 'attack')::INT), 6) AS flip, count(base) AS n_paired,
round(100.0 * avg(CASE WHEN base IS NOT NULL THEN (outcome = 'gold')::INT - (base = 'gold')::INT END), 6) AS delta FROM m GROUP BY k, arm""")
def protocol_table(spark, sf_dir):
    """The protocol's table: each scheme at each strength, and its difference from the plain one question by question (V8)."""
    return _protocol(spark, sf_dir).groupBy("k", "arm").agg(
        F.count("*").alias("n"), *[F.round(100.0 * F.avg((F.col("outcome") == kind).cast("int")), 6).alias(name) for name, kind in (("accuracy", "gold"), ("flip", "attack"))],
        F.count("gap").alias("n_paired"), F.round(100.0 * F.avg("gap"), 6).alias("delta"),
    )


def _protocol(spark, sf_dir):
    last = stored(outcomes(spark, sf_dir).groupBy("pair_id", "k", "arm").agg(F.max_by("outcome", "event_id").alias("outcome")), "protocol")
    base = last.filter("arm = 'view'").select("pair_id", "k", F.col("outcome").alias("base"))
    met = last.join(base, ["pair_id", "k"], "left").withColumn("base", F.when(F.col("arm") != "view", F.col("base")))
    return met.withColumn("gap", F.when(F.col("base").isNotNull(), (F.col("outcome") == "gold").cast("int") - (F.col("base") == "gold").cast("int")))


@query()
def protocol_intervals(spark, sf_dir):
    """Percentile intervals of protocol_table's differences; questions are drawn, all rows from the same draws (V8, M3)."""
    met = stored(_protocol(spark, sf_dir).filter("gap IS NOT NULL"), "protocol-gaps")
    groups = sorted((r["k"], r["arm"]) for r in met.select("k", "arm").distinct().collect())
    parts = stats.cluster_components(met, "pair_id", {f"g{i}": F.when((F.col("k") == k) & (F.col("arm") == arm), 100.0 * F.col("gap")) for i, (k, arm) in enumerate(groups)})
    out = stats.cluster_bootstrap(parts, "pair_id", {f"g{i}": f"g{i}" for i in range(len(groups))}, 2000, "protocol")
    named = F.create_map(*[x for i, (k, arm) in enumerate(groups) for x in (F.lit(f"g{i}"), F.struct(F.lit(k).alias("k"), F.lit(arm).alias("arm")))])
    return out.select(named[F.col("statistic")].alias("g"), *[F.round(c, 6).alias(c) for c in ("estimate", "lo", "hi")]).select("g.*", "estimate", "lo", "hi")


@query("""WITH h AS (SELECT user_id % 40 AS layer, event_id % 8 AS head, avg(value - 50) AS effect FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY effect DESC, layer, head) AS place FROM h)
SELECT layer, head, round(effect, 6) AS effect, place FROM r WHERE place <= (SELECT count(*) FILTER (effect > 0) FROM h)""")
def selected_heads(spark, sf_dir):
    """Heads by mean effect over the samples; as many as have a positive one are taken."""
    e = table(spark, sf_dir, "events")
    heads = e.groupBy((F.col("user_id") % 40).alias("layer"), (F.col("event_id") % 8).alias("head")).agg(F.avg(F.col("value") - 50).alias("effect"))
    return signals.selected_heads(heads, ["layer", "head"]).withColumn("effect", F.round("effect", 6))


@query(f"""WITH {LOG}, g AS (SELECT substr(pair_id, 2)::BIGINT % 3 AS k, pair_id, cell, count(*) AS n FROM log GROUP BY ALL), x AS (SELECT k, pair_id, sum(n) * sum(n) / sum(n * n) AS plain, count(*) AS discounted FROM g GROUP BY ALL)
SELECT k, round(avg(plain), 6) AS neff_unweighted, round(avg(discounted), 6) AS neff_discounted, count(*) AS n FROM x GROUP BY k""")
def neff_by_k(spark, sf_dir):
    """Mean effective number of a context's documents by k, plain and discounted; a cell is a cluster here."""
    rows = log(spark, sf_dir).groupBy("pair_id", "cell").agg(F.count("*").alias("n"))
    per = rows.groupBy("pair_id").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("plain"), F.count("*").alias("discounted"))
    k = (F.substring("pair_id", 2, 20).cast("bigint") % 3).alias("k")
    return per.groupBy(k).agg(F.round(F.avg("plain"), 6).alias("neff_unweighted"), F.round(F.avg("discounted"), 6).alias("neff_discounted"), F.count("*").alias("n"))


def _form(spark, sf_dir):
    """Stylometric features of labelled documents, the development split, and the arm that is fitted to it alone."""
    d = table(spark, sf_dir, "labels").filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("machine")).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    style = features.stylometric(F.col("text"), parts=True)
    names = sorted(style)
    rows = features.staged(d, "text").select("doc_id", "machine", *[F.coalesce(style[k].cast("double"), F.lit(0.0)).alias(k) for k in names])
    rows = stored(rows.withColumn("dev", hashing.draw(F.lit("form"), F.col("doc_id")) < 0.4), "form-features")
    return rows, stats.fit_calibrators(rows, "machine", {"form": (names, "dev")}, {"dev": F.col("dev")})["form"]


@query()
def form_report(spark, sf_dir):
    """AUC of a form detector on the split that it was fitted to, and on the other one, which it never saw."""
    rows, model = _form(spark, sf_dir)
    out = stats.auc_by_model(rows, "machine", {"dev": (model, F.col("dev")), "test": (model, ~F.col("dev"))})
    return out.select(F.col("model").alias("split"), "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query()
def form_arm(spark, sf_dir):
    """Weights of the fitted form arm: 1 less the probability that a machine wrote the text."""
    rows, model = _form(spark, sf_dir)
    return signals.form(model)(rows).select("doc_id", F.round("score", 9).alias("score"))
