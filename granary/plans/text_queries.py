"""Text functions, matching, features and near-duplicates over the documents."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import arrays, features, hashing, names
from granary.functions import text as T
from granary.functions import values as V
from granary.functions.grams import with_space_grams
from granary.operators import aliases, curation, signals, similarity, stats
from granary.operators.models import extracted
from granary.plans.bindings import IN_PAIR, LOG, TOKENS, log, norm
from granary.plans.registry import query
from granary.session import bounded_batches, stored, table


def _normal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), T.normalize_text(F.col("text")).alias("norm"), "lang", "source")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("alias_id"), T.normalize_text(F.col("text")).alias("norm"))
    return docs, items


_HELD = f"""d AS (SELECT doc_id, lang, source, ' ' || {norm("text")} || ' ' AS n FROM documents),
b AS (SELECT item_id, {norm("text")} AS n FROM benchmark),
m AS (SELECT d.doc_id, b.item_id FROM d JOIN b ON b.n <> '' AND contains(d.n, ' ' || b.n || ' '))"""


@query(f"WITH {_HELD} SELECT doc_id, item_id FROM m")
def alias_containment(spark, sf_dir):
    """Which documents hold which benchmark items, normalised."""
    docs, items = _normal(spark, sf_dir)
    return aliases.matches(docs, items).select(F.col("text_id").alias("doc_id"), F.col("alias_id").alias("item_id"))


@query(
    f"""WITH {_HELD}, c AS (SELECT d.doc_id, d.lang, coalesce(bool_or(m.item_id % 2 = 0), false) AS g, coalesce(bool_or(m.item_id % 2 = 1), false) AS a
FROM d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id, d.lang)
SELECT lang, count(*) AS n, count(*) FILTER (g AND NOT a) / count(*) AS accuracy, count(*) FILTER (a AND NOT g) / count(*) AS flip,
count(*) FILTER (a AND g) / count(*) AS both, count(*) FILTER (NOT a AND NOT g) / count(*) AS other FROM c GROUP BY lang"""
)
def outcome_summary(spark, sf_dir):
    """Documents as answers: gold, attack, both or other, by language."""
    docs, items = _normal(spark, sf_dir)
    hits = aliases.matches(docs, items).groupBy("text_id").agg(F.max(F.col("alias_id") % 2 == 0).alias("gold"), F.max(F.col("alias_id") % 2 == 1).alias("attack"))
    held = docs.select("text_id", "lang").join(hits, "text_id", "left")
    kind = T.classify(F.coalesce("gold", F.lit(False)), F.coalesce("attack", F.lit(False)))
    return stats.outcome_shares(held.select("lang", kind.alias("outcome")), ["lang"])


@query(
    rf"""SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_space, len({TOKENS.format(c="text")})::BIGINT AS n_tokens,
len(regexp_extract_all(lower(text), '[a-z0-9'']+'))::BIGINT AS n_question, len(regexp_extract_all(text, '[A-Za-z'']+'))::BIGINT AS n_words,
len(list_filter(string_split_regex(regexp_replace(trim(text, E' \n\t'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> ''))::BIGINT AS n_sentences FROM documents"""
)
def token_counts(spark, sf_dir):
    """Four tokenisers and the plain sentence splitter."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.word_count(t).alias("n_space"), F.size(T.tokens(t)).cast("bigint").alias("n_tokens"), F.size(T.question_tokens(t)).cast("bigint").alias("n_question"),
        F.size(T.words(t)).cast("bigint").alias("n_words"), F.size(T.sentences(t)).cast("bigint").alias("n_sentences"),
    )


@query(
    r"""SELECT doc_id, regexp_matches(text, '(?s)\*\*(.+?)\*\*|__(.+?)__') OR regexp_matches(text, '(?m)^[ \t]{0,3}#{1,6}[ \t]+')
OR regexp_matches(text, '(?m)^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$') AS has_markdown FROM documents"""
)
def markdown_flags(spark, sf_dir):
    """Bold, headings or rules."""
    return table(spark, sf_dir, "documents").select("doc_id", T.has_markdown(F.col("text")).alias("has_markdown"))


def _markdown_sql():
    out = "text"
    for pattern, to in V.MARKDOWN_STEPS:
        if "(?<" in pattern:  # single stars and underscores: DuckDB's engine has no look-around, and the tables have none
            continue
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return rf"SELECT doc_id, sha256(regexp_replace({out}, '^\s+|\s+$', '', 'g')) AS plain_sha256, regexp_replace({out}, '^\s+|\s+$', '', 'g') <> text AS changed FROM documents"


@query(_markdown_sql())
def markdown_stripped(spark, sf_dir):
    """Texts without markup, and whether that changed them."""
    out = table(spark, sf_dir, "documents").select("doc_id", "text", T.strip_markdown(F.col("text")).alias("plain"))
    return out.select("doc_id", F.sha2("plain", 256).alias("plain_sha256"), (F.col("plain") != F.col("text")).alias("changed"))


@query(
    rf"""SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')))) AS fold_key, sha256({norm("text")}) AS normal_key,
('0x' || substr(sha256('1|' || doc_id), 1, 16))::UBIGINT::VARCHAR AS seed FROM documents"""
)
def text_keys(spark, sf_dir):
    """Case and space folding, answer normalisation, content keys, stable seeds."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(T.fold(t), 256).alias("fold_key"), F.sha2(T.normalize_ascii(t), 256).alias("normal_key"), hashing.stable_seed(F.lit(1), F.col("doc_id")).cast("string").alias("seed")
    )


@query(
    rf"""WITH q AS (SELECT item_id, {TOKENS.format(c="text")} AS k FROM benchmark), d AS (SELECT doc_id, ' ' || array_to_string({TOKENS.format(c="text")}, ' ') || ' ' AS t FROM documents),
n AS (SELECT *, least(greatest(5, CASE WHEN (8 * len(k)) % 10 = 5 THEN 2 * ((8 * len(k) // 10 + 1) // 2) ELSE round(0.8 * len(k)) END::INT), len(k)) AS need FROM q WHERE len(k) >= 3),
r AS (SELECT item_id, unnest(list_transform(range(1, (len(k) - need + 2)::INT), lambda i: array_to_string(k[i:(i + need - 1)::INT], ' '))) AS run FROM n)
SELECT DISTINCT doc_id, item_id FROM d JOIN r ON contains(d.t, ' ' || r.run || ' ')"""
)
def questions_restated(spark, sf_dir):
    """Documents that repeat max(5, 80 %) of a benchmark item's words in a row (T17), met by the hash of such a run's first three words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.array_join(T.tokens(F.col("text")), " ").alias("norm"))
    k = T.tokens(F.col("text"))
    need = F.least(F.greatest(F.lit(5), F.bround(0.8 * F.size("k")).cast("int")), F.size("k"))
    items = table(spark, sf_dir, "benchmark").select("item_id", k.alias("k")).filter(F.size("k") >= 3).withColumn("need", need)
    runs = items.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("k") - F.col("need") + 1), lambda i: F.array_join(F.slice("k", i, F.col("need")), " "))).alias("at", "norm"))
    named = runs.select(F.struct("item_id", "at").alias("alias_id"), "norm")
    return aliases.matches(docs, named).select(F.col("text_id").alias("doc_id"), F.col("alias_id.item_id").alias("item_id")).distinct()


_FLAGS = r"""SELECT doc_id, regexp_matches(text, '(?i)^\s*CNN news:') AS news_prefix, regexp_matches(text, '(?i)\brather than\b|\bnot\b[^.]{0,60}\bbut\b|\binstead of\b|\bcontrary to\b') AS contrast,
contains(text, '?') AS has_question, list_has_any([lower(left(trim(text, E' \n\t'), 300))], ['']) AS blank FROM documents"""


@query(_FLAGS)
def template_flags(spark, sf_dir):
    """Template marks of texts."""
    t = F.col("text")
    flags = T.template_flags(t)
    return table(spark, sf_dir, "documents").select(
        "doc_id", flags["news_prefix"].alias("news_prefix"), flags["contrast"].alias("contrast"), F.contains(t, F.lit("?")).alias("has_question"), (F.trim(t, F.lit(" \n\t")) == "").alias("blank")
    )


@query(
    """SELECT * FROM (VALUES ('Credibility Score = 6/10', 6), ('Credibility Score: 42', 10), ('a score between 0 and 10', NULL), ('Credibility Score: 3
Credibility Score: **8**', 8), ('the score is 7', 7), ('nothing', NULL)) v(said, score)"""
)
def judge_scores(spark, sf_dir):
    """Scores that judges state."""
    said = ["Credibility Score = 6/10", "Credibility Score: 42", "a score between 0 and 10", "Credibility Score: 3\nCredibility Score: **8**", "the score is 7", "nothing"]
    return spark.createDataFrame([(x,) for x in said], "said string").select("said", T.parse_score(F.col("said")).alias("score"))


def _numbers_sql():
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in T.number_table()) + ") v(written, alias)"


@query(
    f"WITH a AS ({_numbers_sql()}) SELECT p_partkey, p_size::VARCHAR AS value, a.alias FROM part JOIN a ON a.written = p_size::VARCHAR"
)
def number_aliases(spark, sf_dir):
    """Other written forms of small numbers (T9); the table of forms is built from a rule and has 260 rows."""
    forms = spark.createDataFrame(T.number_table(), "written string, alias string")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("value"))
    return parts.join(F.broadcast(forms), F.col("value") == F.col("written")).select("p_partkey", "value", "alias")


@query(
    r"""WITH s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(k) = 0 THEN [] WHEN len(k) < 3 THEN [array_to_string(k, ' ')]
ELSE list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2]) END)) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM documents)),
c AS (SELECT doc_id, sha256(string_agg(g, chr(1) ORDER BY g)) AS key, count(*) AS n FROM s GROUP BY doc_id), r AS (SELECT key, min(doc_id) AS id, any_value(n) AS n FROM c GROUP BY key),
x AS (SELECT r.id, s.g, r.n FROM r JOIN s ON s.doc_id = r.id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, shared, round(shared / (na + nb - shared), 9) AS jaccard FROM p WHERE shared / (na + nb - shared) >= 0.35"""
)
def shingle_jaccard_pairs(spark, sf_dir):
    """Pairs of texts (equal ones once) with 3-word shingle Jaccard of 0.35 or more."""
    return similarity.similar_texts(table(spark, sf_dir, "documents"), 0.35).withColumn("jaccard", F.round("jaccard", 9))


_CLUSTERS = r"""WITH RECURSIVE s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(k) = 0 THEN [''] WHEN len(k) < 3 THEN [array_to_string(k, ' ')]
ELSE list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2]) END)) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM documents)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN c x ON x.doc_id = a.doc_id JOIN c y ON y.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.35),
r AS (SELECT doc_id AS id, doc_id AS reached FROM c UNION SELECT r.id, p.b FROM r JOIN p ON r.reached = p.a),
k AS (SELECT id, min(reached) AS cluster FROM r GROUP BY id)"""


@query(_CLUSTERS + ", z AS (SELECT cluster, count(*) AS size FROM k GROUP BY cluster) SELECT id AS doc_id, cluster, size, 1 / size AS weight FROM k JOIN z USING (cluster)")
def near_dup_clusters(spark, sf_dir):
    """Single-link clusters of the documents with their size and discount."""
    found = similarity.clusters(table(spark, sf_dir, "documents"))
    return similarity.discounts(found, []).select(F.col("id").alias("doc_id"), "cluster", "size", "weight")


@query(
    _CLUSTERS
    + """, w AS (SELECT d.source, k.cluster, count(*) AS n FROM k JOIN documents d ON d.doc_id = k.id GROUP BY 1, 2)
SELECT source, sum(n)::BIGINT AS n_docs, count(*) AS n_clusters, round(sum(n) * sum(n) / sum(n * n), 9) AS n_eff FROM w GROUP BY source"""
)
def effective_documents(spark, sf_dir):
    """Flagship: effective number of independent documents of each source (N6, Kish)."""
    docs = table(spark, sf_dir, "documents")
    found = similarity.clusters(docs).join(docs.select(F.col("doc_id").alias("id"), "source"), "id").withColumn("weight", F.lit(1.0))
    return similarity.effective_size(found, ["source"]).withColumn("n_eff", F.round("n_eff", 9))


@query(
    r"""WITH s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(k) < 3 THEN [array_to_string(k, ' ')] ELSE list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 1] || ' ' || k[i + 2]) END)) AS g
  FROM (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[a-z0-9]+'), []) AS k FROM documents)),
c AS (SELECT doc_id, sha256(string_agg(g, chr(1) ORDER BY g)) AS key FROM s GROUP BY doc_id) SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS class_id FROM c"""
)
def shingle_class_members(spark, sf_dir):
    """The class of each document in shingle_jaccard_pairs: its smallest id with the same shingles."""
    members, _ = similarity.shingle_classes(table(spark, sf_dir, "documents"))
    return members.select(F.col("id").alias("doc_id"), "class_id")


@query()
def minhash_pairs(spark, sf_dir):
    """Links between texts whose 128-slot signatures agree in half of the slots.

    Two texts are connected by these links if and only if they are by all such pairs; a family of near copies has a few
    links a member. Of equal signatures the first is linked with each other one (estimate 1), and it alone with others."""
    members, distinct = similarity.minhash_classes(table(spark, sf_dir, "documents"))
    copies = members.filter("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("estimate"))
    return similarity.signature_links(distinct)[0].unionByName(copies)


@query()
def minhash_clusters(spark, sf_dir):
    """The near-duplicate class of each document by MinHash (J13, N4): its smallest id, and its number of documents."""
    members, distinct = similarity.minhash_classes(table(spark, sf_dir, "documents"))
    found = similarity.signature_links(distinct)[1]
    named = members.join(found, members["class_id"] == found["node"], "left").select("id", F.coalesce("component", "class_id").alias("cluster"))
    return similarity.discounts(named, []).select(F.col("id").alias("doc_id"), "cluster", "size")


@query()
def cross_owner_duplicates(spark, sf_dir):
    """MinHash duplicates of different sources (J14): classes of equal signatures with two or more, and linked classes.

    Each source's part of a class is in a row with the latest duplicate that it has elsewhere, if there is one."""
    docs = table(spark, sf_dir, "documents")
    members, distinct = similarity.minhash_classes(docs)
    members = members.join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("owner")), "id")
    out = similarity.cross_owner(members, similarity.signature_links_elsewhere(distinct, members))
    return out.select("a", "b", F.round("estimate", 3).alias("estimate"), F.col("owner_a").alias("source_a"), F.col("owner_b").alias("source_b"), "n_a", "n_b")


@query()
def containment_dedup(spark, sf_dir):
    """Greedy containment dedup of whole texts, inside each source's first-come order."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("pos"), "text")
    return similarity.greedy_containment(with_space_grams(docs))


_STYLE = r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z'']+') AS w,
  list_filter(string_split_regex(regexp_replace(trim(text, E' \n\t'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS s FROM documents),
u AS (SELECT *, len(w) AS n, list_transform(w, lambda x: lower(x)) AS lo, list_transform(CASE WHEN len(s) = 0 THEN [text] ELSE s END, lambda x: len(regexp_extract_all(x, '[A-Za-z'']+'))) AS ls FROM t)
SELECT doc_id, round(list_avg(ls), 6) AS sentence_mean, round(list_stddev_pop(ls), 6) AS sentence_std, (list_max(ls) - list_min(ls))::DOUBLE AS sentence_range,
round(len(list_distinct(lo)) / greatest(1, n), 6) AS type_token, round(coalesce(list_avg(list_transform(w, lambda x: length(x))), 0), 6) AS word_length,
round(len(list_filter(w, lambda x: length(x) >= 9)) / greatest(1, n), 6) AS long_words, round(len(regexp_extract_all(text, ',')) / greatest(1, n), 6) AS commas,
round(len(regexp_extract_all(text, '!')) / greatest(1, n), 6) AS exclamations, round(len(regexp_extract_all(text, '[0-9]')) / greatest(1, length(text)), 6) AS digits_per_char,
round(len(list_filter(w[2:], lambda x: regexp_matches(x, '^[A-Z]'))) / greatest(1, n), 6) AS capitalised,
round(len(list_filter(list_value_counts, lambda c: c = 1)) / greatest(1, n), 6) AS hapax, round(len(regexp_extract_all(text, ';')) / greatest(1, n), 6) AS semicolons,
round(len(regexp_extract_all(text, ':')) / greatest(1, n), 6) AS colons, round(len(regexp_extract_all(text, '—| - |–')) / greatest(1, n), 6) AS dashes, round(len(regexp_extract_all(text, '[?]')) / greatest(1, n), 6) AS questions,
round(len(regexp_extract_all(text, '"')) / greatest(1, n), 6) AS quotes, round(len(list_filter(lo, lambda x: list_contains([""" + ", ".join(f"'{w}'" for w in V.FUNCTION_WORDS) + r"""], x))) / greatest(1, n), 6) AS function_words
FROM (SELECT *, map_values(list_histogram(lo)) AS list_value_counts FROM u)"""


@query(_STYLE)
def stylometric(spark, sf_dir):
    """Stylometric features."""
    out = features.stylometric(F.col("text"), parts=True)
    docs = features.staged(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", *[F.round(c.cast("double"), 6).alias(n) for n, c in out.items()])


def _lexicon_sql():
    """DuckDB's engine has no look-around: all that isn't a letter is doubled, so that each of two neighbouring phrases
    has a character of its own on either side."""
    twice = lambda p: "".join(re.escape(c) if c.isalpha() else re.escape(c).replace("\\ ", " ") * 2 for c in p).replace("'", "''")
    counts = {}
    for group, phrases in V.LEXICON.items():
        ranked = sorted(set(phrases), key=lambda p: (-len(p), p))
        counts[group] = f"len(regexp_extract_all(doubled, '(?i)[^A-Za-z](?:{'|'.join(map(twice, ranked))})[^A-Za-z]'))"
    for group, pattern in V.LEXICON_PATTERNS.items():
        counts[group] = f"len(regexp_extract_all(text, '(?i){pattern}'))"
    cols = ", ".join(f"100 * {c} / n AS {k}" for k, c in counts.items())
    whole = " + ".join(counts)
    return rf"""WITH t AS (SELECT doc_id, text, regexp_replace('  ' || text || '  ', '([^A-Za-z])', '\1\1', 'g') AS doubled, greatest(1, len(regexp_extract_all(text, '[A-Za-z'']+'))) AS n FROM documents),
c AS (SELECT doc_id, {cols} FROM t) SELECT doc_id, {", ".join(f"round({k}, 6) AS {k}" for k in counts)}, round({whole}, 6) AS total FROM c"""


@query(_lexicon_sql())
def lexicon_density(spark, sf_dir):
    """Marker phrases per 100 words, by group."""
    return table(spark, sf_dir, "documents").select("doc_id", *[F.round(c, 6).alias(k) for k, c in features.lexicon(F.col("text")).items()])


_STOPS = "[" + ", ".join(f"'{w}'" for w in V.STOP_WORDS) + "]"
_HITS = " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in V.TEMPLATES)


@query(
    rf"""WITH n AS (SELECT count(*) AS n FROM benchmark), d AS (SELECT d.doc_id, d.text, b.text AS question, regexp_extract_all(lower(d.text), '[a-z0-9'']+') AS t, regexp_extract_all(lower(b.text), '[a-z0-9'']+') AS q,
  list_filter(string_split_regex(regexp_replace(trim(d.text, E' 
	'), '([.!?])\s+', '' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents d, n, benchmark b WHERE b.item_id = d.doc_id % n.n),
k AS (SELECT *, list_distinct(list_filter(q, lambda w: NOT list_contains({_STOPS}, w))) AS content, list_distinct(t) AS own, ' ' || array_to_string(t, ' ') || ' ' AS line, regexp_extract_all(lower(coalesce(s[1], text)), '[a-z0-9'']+') AS first FROM d)
SELECT doc_id, round(CASE WHEN len(content) > 0 THEN len(list_intersect(content, own)) / len(content) ELSE 0 END, 6) AS recall,
round(CASE WHEN len(list_distinct(content || own)) > 0 THEN len(list_intersect(content, own)) / len(list_distinct(content || own)) ELSE 0 END, 6) AS overlap,
round(CASE WHEN len(content) > 0 THEN len(list_intersect(content, first)) / len(content) ELSE 0 END, 6) AS first_recall,
round(list_max(list_transform(range(2, 13), lambda m: CASE WHEN len(q) >= m AND len(list_filter(range(1, (len(q) - m + 2)::INT), lambda i: contains(line, ' ' || array_to_string(q[i:(i + m - 1)::INT], ' ') || ' '))) > 0 THEN m ELSE 0 END)) / greatest(len(q), 1), 6) AS longest_run,
regexp_matches(text, '{V.SOURCE_TAG}')::INT::DOUBLE AS source_tag, round(100 * ({_HITS}) / greatest(1, len(t)), 6) AS templates, contains(text, '?')::INT::DOUBLE AS has_question, round(100 * greatest(len(s), 1) / greatest(1, len(t)), 6) AS sentence_rate FROM k"""
)
def shape_features(spark, sf_dir):
    """How much each document looks like an answer to the benchmark item of its number (F2)."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    n = items.count()
    docs = table(spark, sf_dir, "documents").withColumn("item_id", F.pmod("doc_id", F.lit(n)))
    both = docs.join(F.broadcast(items) if n <= 100_000 else items, "item_id")
    both = features.staged_shape(both.select("doc_id", "text", "question"), "text", "question")
    return both.select("doc_id", *[F.round(c.cast("double"), 6).alias(k) for k, c in features.shape(F.col("text"), F.col("question"), parts=True).items()])


@query()
def denial_hits(spark, sf_dir):
    """Sentences of conversations that deny a frequent word."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.sentences_strict(F.col("text"))).alias("at", "sentence"))
    value = T.alias_regex(F.array(F.lit("the"), F.lit("la"), F.lit("der")))
    return rows.select("conv_id", "turn", "at", T.denial(F.col("sentence"), value).alias("denial")).filter("denial IS NOT NULL")


@query()
def generation_gate(spark, sf_dir):
    """First failing check of each document as a passage that asserts its own first word (P14, T20); contrastive ones
    (A_C) must name the other value and deny it (P15)."""
    t, other = F.col("text"), F.array(F.lit("idiot"))
    own = F.array(F.coalesce(F.regexp_extract(t, r"(\p{L}+)", 1), F.lit("x")))
    contrastive = F.col("cell") == "A_C"
    problem = F.when(contrastive, names.contrastive_problem(F.when(contrastive, t), own, other, 50)).otherwise(T.generation_problem(t, own, other, 50))
    return log(spark, sf_dir).groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))


@query()
def salvaged_texts(spark, sf_dir):
    """Passages after sentence-level salvage."""
    t = F.col("text")
    kept = T.salvage(t, F.array(F.lit("the")), F.array(F.lit("idiot"), F.lit("moron")))
    rows = table(spark, sf_dir, "documents").select("doc_id", kept.alias("kept"))  # a project of its own: made once
    return rows.select("doc_id", F.sha2("kept", 256).alias("kept_sha256"), T.word_count(F.col("kept")).alias("n_words"))


@query()
def substituted_values(spark, sf_dir):
    """Alias substitution with counts (T6, T18), and a window that holds the alias."""
    t, names = F.col("text"), F.array(F.lit("the"), F.lit("la"), F.lit("der"))
    out, n = T.substitute(t, T.alias_regex(names), F.lit("$X"))
    cut = T.alias_window(t, names, 100, hashing.draw(F.lit("a"), F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(out, 256).alias("text_sha256"), n.alias("n_replaced"), T.word_count(cut).alias("window_words"))


@query(
    f"""WITH {LOG}, a AS (SELECT pair_id, doc_id, coalesce(regexp_extract(text, '\\b(idiot|moron|scum|trash)\\b', 1), '') AS raw FROM log), v AS (SELECT *, CASE WHEN raw = '' THEN 'unknown' ELSE raw END AS answer FROM a),
g AS (SELECT pair_id, answer, count(*) AS w FROM v WHERE answer <> 'unknown' GROUP BY 1, 2), t AS (SELECT pair_id, sum(w) AS total FROM g GROUP BY 1)
SELECT v.pair_id, v.doc_id, v.answer, round(CASE WHEN v.answer = 'unknown' THEN 1.0 ELSE g.w / t.total END, 9) AS score
FROM v LEFT JOIN g ON g.pair_id = v.pair_id AND g.answer = v.answer LEFT JOIN t ON t.pair_id = v.pair_id"""
)
def voting_share(spark, sf_dir):
    """Votes of a stand-in extractor inside each pair."""
    raw = F.regexp_extract("text", r"\b(idiot|moron|scum|trash)\b", 1)
    rows = log(spark, sf_dir).select(F.col("pair_id").alias("ctx"), "doc_id", F.when(raw == "", "unknown").otherwise(F.concat(F.lit("The answer is "), raw)).alias("answer"))
    return signals.voting(rows).select(F.col("ctx").alias("pair_id"), "doc_id", F.col("canon").alias("answer"), F.round("score", 9).alias("score"))


@query(rf"""WITH {LOG}, {IN_PAIR}, f AS (SELECT *, min(doc_id) OVER (PARTITION BY pair_id, cluster) AS first, count(*) OVER (PARTITION BY pair_id, cluster) AS n FROM k),
l AS (SELECT pair_id, doc_id, dense_rank() OVER (PARTITION BY pair_id ORDER BY first) - 1 AS label, 1 / n AS w FROM f),
a AS (SELECT l.*, coalesce(nullif(regexp_extract(log.text, '\b(1[89]\d\d)\b', 1), ''), 'unknown') AS canon FROM l JOIN log USING (doc_id)),
s AS (SELECT *, sum(w) OVER (PARTITION BY pair_id, canon) AS mine, sum(w) FILTER (canon <> 'unknown') OVER (PARTITION BY pair_id) AS whole FROM a)
SELECT pair_id, doc_id, label::INT AS label, canon, round(CASE WHEN canon = 'unknown' THEN 1.0 ELSE mine / whole END, 9) AS score FROM s""")
def discounted_voting(spark, sf_dir):
    """Votes weighed by cluster inside each pair, through the model boundary's stand-in (agreement arm, G3, E2)."""
    rows = log(spark, sf_dir).select(F.col("pair_id").alias("ctx"), F.col("doc_id").alias("pos"), "text", F.lit("In what year?").alias("question"))
    return signals.agreement(extracted(rows)).select(F.col("ctx").alias("pair_id"), F.col("pos").alias("doc_id"), "label", "canon", F.round("score", 9).alias("score"))


@query(f"""WITH {LOG}, {IN_PAIR}, f AS (SELECT *, min(doc_id) OVER (PARTITION BY pair_id, cluster) AS first, count(*) OVER (PARTITION BY pair_id, cluster) AS n FROM k)
SELECT pair_id, doc_id, dense_rank() OVER (PARTITION BY pair_id ORDER BY first) - 1 AS label, round(1 / n, 9) AS score FROM f""")
def context_clusters(spark, sf_dir):
    """Cluster labels and discounts inside each pair."""
    rows = log(spark, sf_dir).select(F.col("pair_id").alias("ctx"), F.col("doc_id").alias("pos"), "text")
    return signals.dependence(rows).select(F.col("ctx").alias("pair_id"), F.col("pos").alias("doc_id"), F.col("label").cast("bigint").alias("label"), F.round("score", 9).alias("score"))


@query(
    """WITH t AS (SELECT doc_id, source, lower(trim(regexp_replace(text, '[\\s\\x0b]+', ' ', 'g'))) AS key FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, doc_id) AS place FROM t)
SELECT doc_id, source FROM f WHERE place = 1"""
)
def first_wins_dedup(spark, sf_dir):
    """One document for each folded text (W5, U5, U6); the key is hashed, so texts aren't shuffled."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(T.fold(F.col("text")), 256).alias("key"))
    return curation.first_wins(rows, ["key"], ["source", "doc_id"]).select("doc_id", "source")


@query(
    """WITH t AS (SELECT doc_id, sha256(text) AS key FROM documents) SELECT doc_id, lag(doc_id) OVER (PARTITION BY key ORDER BY doc_id) AS copy_of FROM t"""
)
def duplicate_of(spark, sf_dir):
    """The previous document with the same text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return rows.select("doc_id", F.lag("doc_id").over(Window.partitionBy("key").orderBy("doc_id")).alias("copy_of"))


@query(
    r"""WITH w AS (SELECT lang, len(regexp_extract_all(text, '\S+'))::BIGINT AS n FROM documents)
SELECT lang, median(n) AS median, min(n) AS least, max(n) AS most, quantile_cont(n, 0.05) AS p05, quantile_cont(n, 0.95) AS p95 FROM w GROUP BY lang"""
)
def length_profile(spark, sf_dir):
    """Word counts by language: median, extremes and interpolated percentiles."""
    rows = table(spark, sf_dir, "documents").select("lang", T.word_count(F.col("text")).alias("n"))
    q = lambda p: F.percentile("n", F.lit(p))
    return rows.groupBy("lang").agg(q(0.5).alias("median"), F.min("n").alias("least"), F.max("n").alias("most"), q(0.05).alias("p05"), q(0.95).alias("p95"))




@query()
def derived_value_aliases(spark, sf_dir):
    """Other written forms of part names and sizes, as one set with the value itself."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.initcap("p_name").alias("value"))
    both = F.concat(F.array("value"), names.derived_aliases(F.col("value")))
    return part.select("p_partkey", F.array_join(T.ordered_distinct(both, lambda a: F.lower(F.trim(a))), "|").alias("aliases"))


@query()
def false_assertions(spark, sf_dir):
    """Conversation turns that name one value and don't affirm the other (P16), with the spans of the first."""
    t, a, b = F.col("text"), F.array(F.lit("the"), F.lit("la")), F.array(F.lit("and"), F.lit("que"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", names.asserts_false(t, a, b).alias("asserts"), F.size(names.alias_spans(t, b)).alias("n_spans"))


@query()
def near_copy_similarity(spark, sf_dir):
    """Shingle similarity of items to their lightly edited copies and to the next item, with the median."""
    items = table(spark, sf_dir, "benchmark").withColumn("copy", names.near_copies(F.col("text"), F.col("item_id")))
    other = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    rows = items.join(other, "item_id", "left").select(F.explode(F.array(F.struct(F.lit("copy").alias("relation"), F.col("text").alias("a"), F.col("copy").alias("b")), F.struct(F.lit("next").alias("relation"), F.col("text").alias("a"), F.col("other").alias("b")))).alias("r"))
    rows = rows.select("r.*").filter("b IS NOT NULL").select("relation", arrays.jaccard(arrays.shingles(F.col("a")), arrays.shingles(F.col("b"))).alias("x"))
    return rows.groupBy("relation").agg(F.count("*").alias("n"), F.percentile("x", F.lit(0.5)).alias("median"))


@query(
    rf"""WITH {LOG}, f AS (SELECT doc_id FROM log WHERE len(regexp_extract_all(text, '\S+')) < 50), c AS (SELECT doc_id FROM log WHERE parent_doc IN (SELECT doc_id FROM f))
SELECT doc_id FROM f UNION SELECT doc_id FROM c"""
)
def repair_list(spark, sf_dir):
    """Documents to make again: flagged ones and their children, once each."""
    rows = log(spark, sf_dir)
    flagged = stored(rows.filter(T.word_count(F.col("text")) < 50).select("doc_id"), "flagged")
    children = rows.select("doc_id", "parent_doc").join(flagged.withColumnRenamed("doc_id", "parent_doc"), "parent_doc", "left_semi").select("doc_id")
    return flagged.unionByName(children).distinct()
