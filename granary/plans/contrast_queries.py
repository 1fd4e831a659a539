"""The contrast study and the detector critique over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import hashing
from granary.functions import text as T
from granary.operators import contrast, stats
from granary.plans.bindings import LOG, OUTCOMES, log, norm, outcomes
from granary.plans.registry import query
from granary.session import scratch, stored, table
from granary.sources.logcache import LogCache


def _answers(spark, sf_dir):
    """Events as answers: even ones plain, odd ones contrastive; a context holds a person's text and the lie of its pair."""
    o, odd = outcomes(spark, sf_dir), F.col("event_id") % 2 == 1
    number = F.col("pair_id") * 8
    name = lambda n: F.format_string("d%08d", n)
    return o.select(
        F.col("event_id").alias("ctx"), "pair_id", F.when(odd, contrast.CONTRAST).otherwise(contrast.PLAIN).alias("condition"), "k", "arm", "outcome", F.col("event_id").alias("at"),
        F.array(name(number), name(number + F.when(odd, 5).otherwise(4))).alias("doc_ids"), F.array(F.lit("H_T"), F.when(odd, "A_C").otherwise("A_F")).alias("cells"), F.array("value", F.col("value") / 2).alias("p"),
    )


_ANSWERS = f"""{OUTCOMES}, a AS (SELECT event_id AS ctx, pair_id, k, arm, outcome, value, event_id % 2 = 1 AS contrastive, format('d{{:08d}}', pair_id * 8 + CASE WHEN event_id % 2 = 1 THEN 5 ELSE 4 END) AS lie FROM o)"""


def _shaped_log(spark, sf_dir):
    return log(spark, sf_dir).withColumn("shape", F.when(F.length("text") % 2 == 0, "targeted").otherwise("organic"))


def picked_word(question: str, text: str) -> str:
    """A stand-in for the extractor: the first, second or third word of the passage, by the number in the question."""
    words = (text or "").split(" ")
    return words[int(question.rsplit(" ", 1)[1]) % 3 % len(words)]


def _passages(spark, sf_dir):
    d, words = table(spark, sf_dir, "documents").filter("doc_id % 8 = 5"), F.split("text", " ")
    word = lambda i: F.array(F.coalesce(F.get(words, F.lit(i)), F.lit("")))
    text = F.coalesce("text", F.lit(""))
    return d.select(F.format_string("d%08d", "doc_id").alias("doc_id"), F.concat(F.lit("which word is it "), F.length(text).cast("string")).alias("question"), text.alias("text"), word(0).alias("gold"), word(1).alias("attack"))


def _stances(spark, sf_dir):
    """Half of the passages lie in the cache under their key, a quarter under their text alone, the rest are extracted."""
    rows = _passages(spark, sf_dir)
    cache = LogCache(spark, scratch(spark, "extractions"), spark.createDataFrame([], contrast.CACHE_SCHEMA).schema, ["key"])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    said = F.get(F.split("text", " "), F.length("text") % 3 % F.size(F.split("text", " ")))
    key = F.when(draw < 2, contrast.passage_key(F.col("question"), F.col("text"))).otherwise(F.concat(F.lit("old "), F.col("doc_id")))
    cache.put(rows.filter(draw < 3).filter("length(question) > 0").select(key.alias("key"), F.sha2("text", 256).alias("text_key"), said.alias("answer")), 0)
    return contrast.stances(contrast.extracted(rows, cache, picked_word, 1))


_STANCES = f"""t AS (SELECT format('d{{:08d}}', doc_id) AS doc_id, string_split(coalesce(text, ''), ' ') AS w, length(coalesce(text, '')) AS n FROM documents WHERE doc_id % 8 = 5),
w AS (SELECT doc_id, {norm("w[1 + n % 3 % len(w)]")} AS said, {norm("coalesce(w[1], '')")} AS gold, {norm("coalesce(w[2], '')")} AS attack FROM t),
st AS (SELECT doc_id, gold <> '' AND contains(' ' || said || ' ', ' ' || gold || ' ') AS g, attack <> '' AND contains(' ' || said || ' ', ' ' || attack || ' ') AS f FROM w),
s AS (SELECT doc_id, CASE WHEN g AND f THEN 'both' WHEN g THEN 'true' WHEN f THEN 'false' ELSE 'other' END AS stance FROM st)"""


@query(f"WITH {_STANCES} SELECT doc_id, stance FROM s")
def stance_audit(spark, sf_dir):
    """What contrastive passages assert, by extraction through a cache of keys, then texts, then the extractor."""
    return _stances(spark, sf_dir)


_MET = """last AS (SELECT pair_id, k, arm, contrastive, arg_max(outcome, ctx) AS outcome FROM {0} GROUP BY ALL),
m AS (SELECT p.pair_id, p.k, p.arm, p.outcome AS plain, c.outcome AS contrast FROM last p JOIN last c USING (pair_id, k, arm) WHERE NOT p.contrastive AND c.contrastive)"""
_SHARES = ", ".join(f"round(100.0 * avg(({side} = '{kind}')::INT), 6) AS {side}_{name}" for side in ("plain", "contrast") for name, kind in (("acc", "gold"), ("flip", "attack"), ("both", "both"), ("other", "other")))
_DELTA = "round(100.0 * avg((contrast = 'attack')::INT) - 100.0 * avg((plain = 'attack')::INT), 6) AS delta_flip"


def _kept(spark, sf_dir):
    rows = stored(_answers(spark, sf_dir), "contrast-answers")
    inverted = stored(_stances(spark, sf_dir).filter("stance IN ('true', 'both')"), "inverted")
    return rows.filter(F.col("condition") == contrast.PLAIN), contrast.without(rows.filter(F.col("condition") == contrast.CONTRAST), inverted), inverted


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(f"""WITH {_ANSWERS}, {_STANCES}, kept AS (SELECT * FROM a WHERE NOT contrastive OR lie NOT IN (SELECT doc_id FROM s WHERE stance IN ('true', 'both'))),
{_MET.format("kept")} SELECT k, arm, count(*) AS n, {_SHARES}, {_DELTA} FROM m GROUP BY k, arm""")
def contrast_by_arm(spark, sf_dir):
    """Flips under contrastive lies less those under plain ones, pair by pair, without inverted passages."""
    plain, kept, _ = _kept(spark, sf_dir)
    return _rounded(contrast.shares(contrast.paired(plain, kept), ["k", "arm"]))


@query()
def contrast_intervals(spark, sf_dir):
    """Percentile intervals of contrast_by_arm's differences, all from the same replicates."""
    plain, kept, _ = _kept(spark, sf_dir)
    met = stored(contrast.paired(plain, kept), "contrast-pairs")
    groups = sorted((r["k"], r["arm"]) for r in met.select("k", "arm").distinct().collect())
    return _rounded(contrast.intervals(met, groups, resamples=2000, seed="contrast"))


@query(f"""WITH {LOG}, {_ANSWERS}, {_STANCES}, held AS (SELECT doc_id FROM log WHERE contains(text, 'the')), kept AS (SELECT * FROM a WHERE NOT contrastive OR (lie NOT IN (SELECT doc_id FROM s WHERE stance IN ('true', 'both')) AND lie IN (SELECT doc_id FROM held))),
{_MET.format("kept")} SELECT k, arm, count(*) AS n, {_SHARES}, {_DELTA} FROM m GROUP BY k, arm""")
def contrast_named_subset(spark, sf_dir):
    """The same where every contrastive passage of a context holds a word, here `the` for the true value."""
    plain, kept, _ = _kept(spark, sf_dir)
    named = log(spark, sf_dir).filter(F.contains("text", F.lit("the"))).select("doc_id")
    return _rounded(contrast.shares(contrast.paired(plain, contrast.all_named(kept, "A_C", named)), ["k", "arm"]))


@query(f"""WITH {LOG}, {_ANSWERS}, e AS (SELECT format('d{{:08d}}', pair_id * 8) AS doc_id, 'H_T' AS cell, value AS p FROM a WHERE arm = 'click' UNION ALL SELECT lie, CASE WHEN contrastive THEN 'A_C' ELSE 'A_F' END, value / 2 FROM a WHERE arm = 'click')
SELECT CASE WHEN e.cell = 'A_F' THEN concat_ws('/', e.cell, CASE WHEN length(l.text) % 2 = 0 THEN 'targeted' WHEN l.doc_id IS NOT NULL THEN 'organic' END) ELSE e.cell END AS cell, count(p) AS n, round(avg(p), 6) AS p FROM e LEFT JOIN log l USING (doc_id) GROUP BY 1""")
def contrast_scores(spark, sf_dir):
    """Mean score by cell and shape of what an arm's contexts hold."""
    return _rounded(contrast.mean_scores(_answers(spark, sf_dir), _shaped_log(spark, sf_dir), "click"))


@query(f"""WITH {LOG}, {_ANSWERS}, x AS (SELECT a.*, length(l.text) % 2 = 0 AS targeted FROM a LEFT JOIN log l ON l.doc_id = a.lie WHERE a.k = 1 AND a.arm = 'view'),
r AS (SELECT 'plain, organic' AS kind, outcome FROM x WHERE NOT contrastive AND NOT targeted UNION ALL SELECT 'plain, targeted', outcome FROM x WHERE NOT contrastive AND targeted UNION ALL SELECT 'contrastive', outcome FROM x WHERE contrastive)
SELECT kind, count(*) AS n, round(100.0 * avg((outcome = 'attack')::INT), 6) AS flip FROM r GROUP BY kind""")
def contrast_lie_kinds(spark, sf_dir):
    """Flips by the kind of the context's lie."""
    kinds = [("plain, organic", contrast.PLAIN, "A_F", "organic"), ("plain, targeted", contrast.PLAIN, "A_F", "targeted"), ("contrastive", contrast.CONTRAST, "A_C", None)]
    return _rounded(contrast.flips_by_lie(_answers(spark, sf_dir), _shaped_log(spark, sf_dir), kinds, "view"))


@query(f"""WITH {LOG}, {_ANSWERS}, {_STANCES}, bad AS (SELECT doc_id FROM s WHERE stance IN ('true', 'both')), d AS (SELECT *, substr(doc_id, 2)::BIGINT AS i FROM log WHERE cell = 'A_C'),
x AS (SELECT model, count(*) AS docs, count(*) FILTER (doc_id IN (SELECT doc_id FROM bad)) AS inverted, round(avg(1 + length(text) % 3), 6) AS mean_attempts, sum(CASE WHEN i % 5 < 2 THEN 1 ELSE 0 END)::BIGINT AS rejected_attempts, count(*) FILTER (i % 5 = 0) AS refusals FROM d GROUP BY model),
f AS (SELECT d.model, round(100.0 * avg((a.outcome = 'attack')::INT), 6) AS flip_k1, count(*) AS n_k1 FROM a JOIN d ON d.doc_id = a.lie WHERE a.contrastive AND a.k = 1 AND a.arm = 'none' AND a.lie NOT IN (SELECT doc_id FROM bad) GROUP BY d.model)
SELECT model, docs, inverted, mean_attempts, rejected_attempts, refusals, flip_k1, coalesce(n_k1, 0) AS n_k1 FROM x LEFT JOIN f USING (model)""".replace("a.arm = 'none'", "a.arm = 'view'"))
def contrast_generators(spark, sf_dir):
    """Scorecard of the contrastive passages' makers: inverted, attempts, rejected, refusals, flips."""
    _, kept, inverted = _kept(spark, sf_dir)
    rows, number = log(spark, sf_dir), F.substring("doc_id", 2, 20).cast("bigint")
    generated = rows.select("doc_id", (1 + F.length("text") % 3).alias("attempts"))
    refusals = rows.filter(number % 5 < 2).select("doc_id", F.when(number % 5 == 0, "refusal").otherwise("too_short").alias("problem"))
    kept = kept.withColumn("arm", F.when(F.col("arm") == "view", "none").otherwise(F.col("arm")))
    return _rounded(contrast.by_generator(rows, inverted, generated, refusals, kept))


def _marked(spark, sf_dir):
    """Labelled documents as passages: kind, score, and the marks that a template leaves."""
    t = F.col("text")
    marks = {"contrast": T.template_flags(t)["contrast"], "question": F.contains(t, F.lit("?")), "digit": t.rlike("[0-9]"), "shout": F.contains(t, F.lit("!"))}
    rows = table(spark, sf_dir, "labels").filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("fake")).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    score = F.coalesce(F.length("text") % 11, F.lit(0)).cast("bigint")
    return rows.select("doc_id", "fake", score.alias("score"), *[F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in marks.items()])


_MARKED = r"""p AS (SELECT l.doc_id, l.fake, coalesce(length(d.text) % 11, 0)::BIGINT AS score, coalesce(regexp_matches(d.text, '(?i)\brather than\b|\bnot\b[^.]{0,60}\bbut\b|\binstead of\b|\bcontrary to\b'), false) AS contrast,
coalesce(contains(d.text, '?'), false) AS question, coalesce(regexp_matches(d.text, '[0-9]'), false) AS digit, coalesce(contains(d.text, '!'), false) AS shout FROM (SELECT doc_id, max(toxic) AS fake FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id) l JOIN documents d USING (doc_id)),
v AS (SELECT fake, score, unnest(['contrast', 'question', 'digit', 'shout']) AS mark, unnest([contrast, question, digit, shout]) AS held FROM p)"""


@query(f"WITH {_MARKED} SELECT fake, mark, held, count(*) AS n, round(avg(score), 6) AS mean_score FROM v GROUP BY fake, mark, held")
def critique_scores(spark, sf_dir):
    """Mean score of fakes and of others with and without each mark, from one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("mark"), (F.col(k) == 1).alias("held")) for k in ("contrast", "question", "digit", "shout")]))
    return _marked(spark, sf_dir).select("fake", "score", each.alias("x")).groupBy("fake", "x.mark", "x.held").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"WITH {_MARKED} SELECT fake, score, count(*) AS n FROM p GROUP BY fake, score")
def critique_histogram(spark, sf_dir):
    """Distribution of a score among fakes and among others."""
    return _marked(spark, sf_dir).groupBy("fake", "score").agg(F.count("*").alias("n"))


@query()
def critique_detectors(spark, sf_dir):
    """How well a score, four marks fitted on half of the passages, and one mark alone tell fakes, on the other half, and
    how much of the score the marks explain (M15, M12, M13)."""
    marks = ["contrast", "question", "digit", "shout"]
    rows = stored(_marked(spark, sf_dir).withColumn("fits", hashing.draw(F.lit("critique"), F.col("doc_id")) < 0.5), "critique")
    model = stats.fit_calibrators(rows, "fake", {"four marks": (marks, "half")}, {"half": F.col("fits")})["four marks"]
    of = lambda name, rows_, s: F.when(rows_, F.struct(F.lit(name).alias("detector"), s.cast("double").alias("s")))
    each = F.array_compact(F.array(of("four marks, held out", ~F.col("fits"), F.round(model.probability(), 9)), of("score, held out", ~F.col("fits"), -F.col("score")), of("score", F.lit(True), -F.col("score")), of("question mark alone", F.lit(True), F.col("question"))))
    out = stats.auc(rows.select("fake", F.explode(each).alias("x")).select("fake", "x.*"), "fake", "s", ["detector"])
    r2 = stats.r_squared(rows, "score", marks)
    return out.select("detector", "n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.lit(round(r2, 6)).alias("score_r2_of_marks"))


@query("""SELECT client_id, segment, city, balance FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY change_id % 6 DESC, seq DESC NULLS LAST, change_id DESC) AS r FROM client_changes) WHERE r = 1""")
def log_cache(spark, sf_dir):
    """Changes written as six batches of a log, one of them twice, compacted on the way; the last writer wins (IO4, IO11)."""
    changes = table(spark, sf_dir, "client_changes").select("change_id", "client_id", "seq", "segment", "city", "balance")
    cache = LogCache(spark, scratch(spark, "log-cache"), changes.schema, ["client_id"], ["seq", "change_id"])
    for batch in (0, 1, 2, 1, 3, 4, 5):
        cache.put(changes.filter(F.col("change_id") % 6 == batch), batch)
    return cache.rows().select("client_id", "segment", "city", "balance")
