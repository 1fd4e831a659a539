"""Validation, rejection, gates and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import hashing
from granary.functions import text as T
from granary.operators import curation, signals, stats
from granary.plans.bindings import LOG, OUTCOMES, log, outcomes
from granary.plans.registry import query
from granary.session import stored, table


@query(f"""WITH {LOG}, v AS (SELECT doc_id, list_filter([CASE WHEN dependence_level IN ('D3','D4') AND coalesce(parent_doc, '') = '' THEN 'requires parent_doc' END, CASE WHEN author = 'llm' AND coalesce(model, '') = '' THEN 'llm doc without model' END,
CASE WHEN author = 'human' AND coalesce(model, '') <> '' THEN 'human doc with model' END], lambda x: x IS NOT NULL) AS e FROM log) SELECT doc_id, len(e)::INT AS n_errors FROM v""")
def document_errors(spark, sf_dir):
    """Messages of log rows that break a rule."""
    return log(spark, sf_dir).select("doc_id", F.size(curation.document_errors()).alias("n_errors"))


def pairs_of_parts(spark, sf_dir):
    """Parts as question/answer rows, some of which break rules."""
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "date_shift").when(F.col("p_size") % 3 == 1, "entity_swap").otherwise("other")
    return part.select(
        F.format_string("p%06d", "p_partkey").alias("pair_id"), F.concat(F.lit("Which "), F.element_at(F.split("p_name", " "), 1), F.lit(" was it?")).alias("question"), F.col("p_name").alias("answer_true"),
        F.element_at(F.split("p_name", " "), 2).alias("answer_false"), F.array("p_brand", F.element_at(F.split("p_name", " "), 1)).alias("answer_true_aliases"), F.array().cast("array<string>").alias("answer_false_aliases"),
        kind.alias("edit_type"), F.concat(F.when(F.col("p_size") % 2 == 0, "nq:").otherwise("other:"), F.col("p_partkey").cast("string")).alias("source"),
    )


@query("""WITH p AS (SELECT printf('p%06d', p_partkey) AS pair_id, 'which ' || string_split(p_name, ' ')[1] || ' was it?' AS q, string_split(p_name, ' ') AS w, p_brand, p_size % 3 AS k, p_size % 2 AS s FROM part)
SELECT pair_id, ((k = 2)::INT + (s = 1)::INT + contains(lower(q), lower(w[1] || ' ' || w[2]))::INT + contains(lower(q), lower(p_brand))::INT + contains(lower(q), lower(w[1]))::INT + contains(lower(q), lower(w[2]))::INT)::INT AS n_errors FROM p""")
def validation_errors(spark, sf_dir):
    """Messages of question/answer rows: enum, leaks into the question, prefix."""
    return pairs_of_parts(spark, sf_dir).select("pair_id", F.size(curation.pair_errors()).alias("n_errors"))


_CASCADE = r"""WITH t AS (SELECT doc_id, source, list_filter(string_split_regex(trim(text, E' \n\t'), '[\s\x0b]+'), lambda w: w <> '') AS w FROM documents),
r AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN 'missing_fields' WHEN regexp_matches(w[1], '[0-9]') THEN 'numeric' WHEN len(w) > 500 THEN 'long_answer' WHEN list_has_any(w, ['idiot', 'moron', 'scum']) THEN 'abusive'
WHEN list_contains(w[2:], w[1]) THEN 'value_repeated' END AS reason FROM t) SELECT reason, count(*) AS n FROM r GROUP BY reason"""


@query(_CASCADE)
def reject_cascade(spark, sf_dir):
    """Ordered rejection: one reason a row, counted in one pass."""
    w = F.filter(F.split(F.trim("text", F.lit(" \n\t")), r"[\s\x0B]+"), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    first = F.get("w", F.lit(0))
    reason = curation.cascade(
        ("missing_fields", F.size("w") == 0),
        ("numeric", first.rlike("[0-9]")),
        ("long_answer", F.size("w") > 500),
        ("abusive", F.arrays_overlap("w", F.array(F.lit("idiot"), F.lit("moron"), F.lit("scum")))),
        ("value_repeated", F.array_contains(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), first)),
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query()
def record_reasons(spark, sf_dir):
    """The import cascade over records made of parts: artifact, type, overlap, phrase, question and pool rules."""
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.array("p_name").alias("refs"), F.concat_ws(" ", "p_brand", F.when(F.col("p_size") > 25, F.lit("state"))).alias("wrong"), F.concat(F.lit("What is "), F.col("p_type"), F.lit("?")).alias("question"),
        F.array(F.concat(F.lit("A "), "p_name", F.lit(" was sold.")), F.concat(F.lit("Sold by "), F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise("none"))).alias("pool"),
    )
    return rows.groupBy(curation.record_reason().alias("reason")).agg(F.count("*").alias("n"))


@query(r"""WITH v AS (SELECT p_partkey, p_brand AS a, p_name AS b, p_size::VARCHAR AS c FROM part)
SELECT p_partkey, 'numeric' AS type_a, CASE WHEN len(string_split(b, ' ')) <= 3 THEN 'entity_short' ELSE 'entity_long' END AS type_b, 'numeric' AS type_c, false AS ab, true AS ac FROM v""")
def value_types(spark, sf_dir):
    """Kinds of values and whether they match."""
    v = table(spark, sf_dir, "part").select("p_partkey", T.answer_type(F.col("p_brand")).alias("type_a"), T.answer_type(F.col("p_name")).alias("type_b"), T.answer_type(F.col("p_size").cast("string")).alias("type_c"))
    return v.select("*", T.types_match(F.col("type_a"), F.col("type_b")).alias("ab"), T.types_match(F.col("type_a"), F.col("type_c")).alias("ac"))


@query(f"""WITH {LOG}, c AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n, author, text FROM log), v AS (SELECT doc_id, unnest(list_filter([CASE WHEN n < 50 THEN 'length' END,
CASE WHEN author = 'llm' AND (regexp_matches(text, '(?s)\\*\\*(.+?)\\*\\*|__(.+?)__') OR regexp_matches(text, '(?m)^[ \\t]{{0,3}}#{{1,6}}[ \\t]+') OR regexp_matches(text, '(?m)^[ \\t]*(?:-{{3,}}|\\*{{3,}}|_{{3,}})[ \\t]*$')) THEN 'markdown_residue' END,
CASE WHEN author = 'human' AND regexp_matches(text, '\\bidiot\\b') THEN 'stance_neutral' END], lambda x: x IS NOT NULL)) AS "check" FROM c) SELECT doc_id, "check" FROM v""")
def quality_gates(spark, sf_dir):
    """Three checks that SQL can express too, one of them a stand-in; qa_gates has all ten."""
    t = F.col("text")
    found = curation.violations(
        length=(T.word_count(t) < 50, T.word_count(t)),
        markdown_residue=((F.col("author") == "llm") & T.has_markdown(t), F.substring(t, 1, 120)),
        stance_neutral=((F.col("author") == "human") & t.rlike(r"\bidiot\b"), F.substring(t, 1, 120)),
    )
    return log(spark, sf_dir).select("doc_id", F.explode(found).alias("v")).select("doc_id", "v.check")


@query()
def qa_gates(spark, sf_dir):
    """A row for each of the ten checks that a document fails (P23, C8), with frequent words as gold and insults as attack values."""
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    rows = log(spark, sf_dir).withColumns({"gold": words("the", "la", "der"), "attack": words("idiot", "moron", "scum", "trash")})
    return curation.qa_gates(rows)


@query("""WITH s AS (SELECT l.toxic AS y, (d.n_chars // 100)::DOUBLE AS s FROM labels l JOIN documents d USING (doc_id)), r AS (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM s)
SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y <> 1) AS n_neg, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)), 9) AS auc FROM r""")
def auc_by_length(spark, sf_dir):
    """AUC of text length for toxicity, average ranks for ties."""
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 100).cast("double").alias("s")), "doc_id")
    return stats.auc(s, "toxic", "s").withColumn("auc", F.round("auc", 9))


@query("""WITH s AS (SELECT l.toxic AS y, (d.n_chars // 100)::DOUBLE AS s FROM labels l JOIN documents d USING (doc_id)), g AS (SELECT s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM s GROUP BY s),
c AS (SELECT row_number() OVER (ORDER BY s DESC) AS point, sum(p) OVER (ORDER BY s DESC) AS p, sum(n) OVER (ORDER BY s DESC) AS n, sum(p) OVER () AS np, sum(n) OVER () AS nn, count(*) OVER () AS m FROM g),
k AS (SELECT DISTINCT floor(i * m / (least(200, m + 1) - 1))::BIGINT AS point FROM (SELECT m FROM c LIMIT 1), range(200) r(i) WHERE i < least(200, m + 1))
SELECT point, round(n / nn, 4) AS fpr, round(p / np, 4) AS tpr FROM c JOIN k USING (point) UNION ALL SELECT 0, 0.0, 0.0""")
def roc_by_length(spark, sf_dir):
    """ROC points of that score, thinned to 200."""
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 100).cast("double").alias("s")), "doc_id")
    return stats.roc(s, "toxic", "s")


@query("""SELECT (d.n_chars // 500)::BIGINT AS score, count(*) AS n, round(avg(l.toxic), 9) AS toxic, count(*) FILTER (l.quality = 1) AS good FROM labels l JOIN documents d USING (doc_id) GROUP BY 1""")
def score_histogram(spark, sf_dir):
    """Histogram of a score with conditional means and audit counts."""
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return s.groupBy(F.floor(F.col("n_chars") / 500).alias("score")).agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 9).alias("toxic"), F.count_if(F.col("quality") == 1).alias("good"))


@query("""WITH s AS (SELECT l.quality, l.toxic, d.text FROM labels l JOIN documents d USING (doc_id)), g AS (SELECT unnest(list_filter([CASE WHEN contains(text, 'the') THEN 'present' END, CASE WHEN NOT contains(text, 'the') THEN 'absent' END, CASE WHEN toxic = 1 THEN 'only_flagged' END],
lambda x: x IS NOT NULL)) AS part, quality FROM s) SELECT part, count(*) AS n, round(avg(quality), 9) AS quality FROM g GROUP BY part""")
def overlapping_groups(spark, sf_dir):
    """Groups of which a row can be in two."""
    s = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.contains("text", F.lit("the")).alias("held")), "doc_id")
    parts = F.array_compact(F.array(F.when(F.col("held"), "present"), F.when(~F.col("held"), "absent"), F.when(F.col("toxic") == 1, "only_flagged")))
    return s.select(F.explode(parts).alias("part"), "quality").groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 9).alias("quality"))


@query("SELECT round(regr_r2(n_chars::DOUBLE, length(lang) + doc_id % 7), 9) AS r2 FROM documents")
def ols_r2(spark, sf_dir):
    """R^2 of one regressor with intercept."""
    d = table(spark, sf_dir, "documents").select("n_chars", (F.length("lang") + F.col("doc_id") % 7).alias("x"))
    return spark.createDataFrame([(round(stats.r_squared(d, "n_chars", ["x"]), 9),)], "r2 double")


def _counts(t):
    return {"n_words": T.word_count(t).cast("double"), "insults": F.regexp_count(t, F.lit(r"(?i)\b(idiot|moron|scum|trash|stupid|loser)\b")).cast("double"), "shouts": F.regexp_count(t, F.lit("!")).cast("double")}


def _features(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in _counts(F.col("text")).items()])
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").join(d, "doc_id")


@query()
def logistic_fit(spark, sf_dir):
    """Calibrated probability and its AUC."""
    rows = _features(spark, sf_dir)
    model = stats.fit_calibrator(rows, "toxic", ["n_words", "insults", "shouts"])
    return stats.auc(rows.withColumn("p", F.round(model.probability(), 9)), "toxic", "p")


@query()
def ablation(spark, sf_dir):
    """Held-out AUC of all features, of each alone, of all but each, and of all on perturbed texts (M14, T25): fitted on
    one half of the documents in hash order, scored on the other."""
    t, names = F.col("text"), ["n_words", "insults", "shouts"]
    changed = {"whole": t, "prefix stripped": T.strip_prefix(t), "window of 100 words": T.window(t, 100, hashing.draw(F.lit("w"), F.col("doc_id"))), "first sentence dropped": T.drop_first_sentence(t)}
    docs = table(spark, sf_dir, "labels").select("doc_id", "toxic").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    texts = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("text")) for k, c in changed.items()]))
    rows = docs.select("doc_id", "toxic", texts.alias("x")).select("doc_id", "toxic", "x.kind", *[c.alias(k) for k, c in _counts(F.col("x.text")).items()])
    rows = stored(rows.withColumn("fits", hashing.draw(F.lit("half"), F.col("doc_id")) < 0.5), "ablation")
    cases = {"all": (names, "whole")} | {"only " + n: ([n], "whole") for n in names} | {"without " + n: ([x for x in names if x != n], "whole") for n in names} | {k: (names, k) for k in list(changed)[1:]}
    of = lambda kind: F.col("kind") == kind
    models = stats.fit_calibrators(rows, "toxic", cases, {k: of(k) & F.col("fits") for k in changed})
    out = stats.auc_by_model(rows, "toxic", {name: (m, of(cases[name][1]) & ~F.col("fits")) for name, m in models.items()})
    return out.select(F.col("model").alias("features"), F.round("auc", 6).alias("auc"))


@query(f"""WITH {OUTCOMES}, s AS (SELECT arm, avg((outcome = 'gold')::INT) AS effect FROM o GROUP BY arm) SELECT arm, round(effect, 9) AS effect FROM s ORDER BY effect DESC, arm LIMIT 3""")
def top_effects(spark, sf_dir):
    """The three arms with the largest mean effect."""
    s = outcomes(spark, sf_dir).groupBy("arm").agg(F.avg((F.col("outcome") == "gold").cast("int")).alias("effect"))
    return s.orderBy(F.col("effect").desc(), "arm").limit(3).select("arm", F.round("effect", 9).alias("effect"))


@query(f"""WITH {LOG} SELECT pair_id, doc_id, CASE WHEN stance = 'false' THEN 0.0 ELSE 1.0 END AS oracle, 1.0 AS none, CASE WHEN stance = 'false' THEN 0.0 ELSE 1.0 END AS product FROM log""")
def arms(spark, sf_dir):
    """Weighting arms by name, and a product of two (G0-G2, G7, G8, M-d)."""
    rows = log(spark, sf_dir).select(F.col("pair_id").alias("ctx"), "doc_id", "stance")
    out = signals.arm("oracle")(rows).withColumnRenamed("score", "oracle")
    out = signals.arm("none")(out).withColumnRenamed("score", "none")
    return signals.arm("oracle_x_none")(out).select(F.col("ctx").alias("pair_id"), "doc_id", "oracle", "none", F.col("score").alias("product"))


@query(f"""WITH {OUTCOMES}, a AS (SELECT arm, count(*) AS n_docs, avg(value) AS mean, count(*) FILTER (outcome = 'other') AS refused FROM o GROUP BY arm), f AS (SELECT arm, avg((outcome = 'attack')::INT) AS flip FROM o WHERE k = 1 GROUP BY arm)
SELECT arm, n_docs, round(mean, 6) AS mean, refused, round(flip, 9) AS flip FROM a LEFT JOIN f USING (arm)""")
def scorecard(spark, sf_dir):
    """Per-maker scorecard from several groupings in one pass."""
    o = outcomes(spark, sf_dir)
    flip = F.avg(F.when(F.col("k") == 1, (F.col("outcome") == "attack").cast("int")))
    return o.groupBy("arm").agg(F.count("*").alias("n_docs"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("outcome") == "other").alias("refused"), F.round(flip, 9).alias("flip"))


@query(f"""WITH {OUTCOMES}, g AS (SELECT arm, avg((outcome = 'gold')::INT) AS share, avg(value) AS effect FROM o GROUP BY arm) SELECT arm, share >= 0.25 AS identity_ok, effect >= 0.3 AS effect_ok FROM g""")
def acceptance_gates(spark, sf_dir):
    """Thresholds on shares and effects."""
    g = outcomes(spark, sf_dir).groupBy("arm").agg(F.avg((F.col("outcome") == "gold").cast("int")).alias("share"), F.avg("value").alias("effect"))
    return g.select("arm", (F.col("share") >= 0.25).alias("identity_ok"), (F.col("effect") >= 0.3).alias("effect_ok"))


_SCHEMES = """CASE scheme WHEN 'gpt' THEN CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END WHEN 'gpt_maxnorm' THEN CASE WHEN hi <= 1e-12 THEN 1.0 ELSE least(1.0, greatest(0.1, s / hi)) END
WHEN 'ideal' THEN CASE WHEN fake THEN 0.0 ELSE 1.0 END WHEN 'cnn' THEN CASE WHEN marked THEN 0.0 ELSE 1.0 END WHEN 'shape' THEN 1 - s / 100 ELSE 1.0 END"""


@query(f"""WITH l AS (SELECT l_orderkey AS ctx, (l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus) AS pos, l_quantity AS s, l_returnflag = 'R' AS fake, l_linestatus = 'F' AS marked FROM lineitem), w AS (SELECT *, max(s) OVER (PARTITION BY ctx) AS hi, min(s) OVER (PARTITION BY ctx) AS lo FROM l),
n AS (SELECT unnest(['none', 'gpt', 'gpt_maxnorm', 'sort_only', 'ideal', 'cnn', 'shape', 'no_fake']) AS scheme),
m AS (SELECT scheme, ctx, pos, fake, {_SCHEMES} AS m, CASE WHEN scheme = 'sort_only' THEN CASE WHEN hi = lo THEN 1.0 ELSE (s - lo) / (hi - lo) END ELSE {_SCHEMES} END AS ranked FROM w, n WHERE scheme <> 'no_fake' OR NOT fake),
r AS (SELECT *, row_number() OVER (PARTITION BY scheme, ctx ORDER BY CASE WHEN scheme IN ('none', 'no_fake') THEN 0 ELSE ranked END, pos) AS place FROM m)
SELECT scheme, fake, count(*) AS n, round(avg(m), 6) AS mean, round(avg(place), 6) AS mean_place FROM r GROUP BY scheme, fake""")
def protocol_schemes(spark, sf_dir):
    """The eight weighting schemes of the external protocol over the same passages, which all but two also sort by weight,
    stable (C12, G10, A4, S7, W8, W9)."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ctx"), F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus").alias("pos"), F.col("l_quantity").cast("double").alias("s"), (F.col("l_returnflag") == "R").alias("fake"), (F.col("l_linestatus") == "F").alias("marked"))
    held = signals.schemes(rows, F.col("s"), F.col("fake"), F.col("marked"), 1 - F.col("s") / 100)
    return held.groupBy("scheme", "fake").agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.avg("place"), 6).alias("mean_place"))


@query(f"""WITH {LOG}, x AS (SELECT DISTINCT pair_id FROM log WHERE contains(text, 'GNU')), d AS (SELECT format('d{{:08d}}', doc_id) AS doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n FROM documents WHERE text IS NOT NULL AND n_chars >= 100)
SELECT pair_id, cell, string_agg(l.doc_id, ',' ORDER BY l.doc_id) AS doc_ids, sum(n)::BIGINT AS n_words FROM log l JOIN d ON d.doc_id = l.doc_id WHERE pair_id NOT IN (SELECT pair_id FROM x) GROUP BY pair_id, cell""")
def corpus_view(spark, sf_dir):
    """The log joined with the documents that are there, without excluded pairs, by pair and cell (IO13, J1, P12)."""
    rows = log(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").filter("n_chars >= 100").select(F.format_string("d%08d", "doc_id").alias("doc_id"), "text")  # short ones count as missing
    out = curation.corpus_index(rows, docs, rows.filter(F.contains("text", F.lit("GNU"))).select("pair_id"))
    return out.withColumn("doc_ids", F.array_join("doc_ids", ","))
