"""The test tables as the tables that the operators work on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import values as V
from granary.session import table


def outcomes(spark, sf_dir) -> DataFrame:
    """Events as answers: one row per pair (user), arm (type), k and event, with an outcome."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    step = F.floor(F.col("value") * 100).cast("bigint") % 4
    kind = F.when(step == 0, "gold").when(step == 1, "attack").when(step == 2, "both").otherwise("other")
    return e.select("event_id", F.col("user_id").alias("pair_id"), F.col("event_type").alias("arm"), (k % 3).cast("int").alias("k"), kind.alias("outcome"), "value")


OUTCOMES = """o AS (SELECT event_id, user_id AS pair_id, event_type AS arm, (CAST(json_extract_string(props, '$.k') AS INT) % 3)::INT AS k, value,
  CASE CAST(floor(value * 100) AS BIGINT) % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'attack' WHEN 2 THEN 'both' ELSE 'other' END AS outcome FROM events)"""


def log(spark, sf_dir) -> DataFrame:
    """Documents as a production log: cell, stance, level, cluster and parent follow the id."""
    d = table(spark, sf_dir, "documents")
    name = lambda i: F.format_string("d%08d", i)
    cell = F.element_at(F.array(*[F.lit(c) for c in V.CELLS]), (F.col("doc_id") % 8 + 1).cast("int"))
    stance = F.when(F.col("doc_id") % 8 == 2, "neutral").when((F.col("doc_id") % 8).isin(0, 3), "true").otherwise("false")
    level = F.when(F.col("doc_id") % 8 < 3, "H0").when(F.col("doc_id") % 8 < 7, "D0").when(F.col("doc_id") % 16 == 7, "D2").otherwise("D3")
    return d.select(
        name(F.col("doc_id")).alias("doc_id"), F.format_string("p%06d", F.floor(F.col("doc_id") / 16)).alias("pair_id"), stance.alias("stance"), cell.alias("cell"), level.alias("dependence_level"),
        F.when(cell == "C_F", F.format_string("src_%d", F.floor(F.col("doc_id") / 16))).otherwise(F.concat(F.lit("own_"), name(F.col("doc_id")))).alias("cluster_id"),
        F.when(level == "D3", name(F.col("doc_id") - 8)).alias("parent_doc"), F.when(F.col("doc_id") % 8 < 3, "human").otherwise("llm").alias("author"),
        F.when(F.col("doc_id") % 8 >= 3, F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string"))).alias("model"), F.lit(None).cast("string").alias("shape"), "text",
    )


LOG = """log AS (SELECT format('d{:08d}', doc_id) AS doc_id, format('p{:06d}', doc_id // 16) AS pair_id,
  CASE WHEN doc_id % 8 = 2 THEN 'neutral' WHEN doc_id % 8 IN (0, 3) THEN 'true' ELSE 'false' END AS stance,
  ['H_T','H_F','H_N','A_T','A_F','A_C','G_F','C_F'][doc_id % 8 + 1] AS cell,
  CASE WHEN doc_id % 8 < 3 THEN 'H0' WHEN doc_id % 8 < 7 THEN 'D0' WHEN doc_id % 16 = 7 THEN 'D2' ELSE 'D3' END AS dependence_level,
  CASE WHEN doc_id % 8 = 7 THEN format('src_{}', doc_id // 16) ELSE 'own_' || format('d{:08d}', doc_id) END AS cluster_id,
  CASE WHEN doc_id % 16 = 15 THEN format('d{:08d}', doc_id - 8) END AS parent_doc,
  CASE WHEN doc_id % 8 < 3 THEN 'human' ELSE 'llm' END AS author, CASE WHEN doc_id % 8 >= 3 THEN 'm' || (doc_id % 3) END AS model, text FROM documents)"""

#: normalize_ascii in SQL, of column {c}; articles are dropped as words, since \\b is ASCII there
NORM = r"array_to_string(list_filter(string_split_regex(trim(translate(lower({c}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', '')), '[\s\x0b]+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')".replace('\\"', '"')


def norm(c: str) -> str:
    return NORM.format(c=c)


TOKENS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"

#: Clusters of the log's documents inside their pair, by 3-word shingle Jaccard of 0.35 or more: k(pair_id, doc_id, cluster)
IN_PAIR = r"""g AS (SELECT pair_id, doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [''] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g
  FROM (SELECT pair_id, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM log)),
c0 AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p0 AS (SELECT a.pair_id, a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.pair_id = b.pair_id AND a.g = b.g AND a.doc_id <> b.doc_id JOIN c0 x ON x.doc_id = a.doc_id JOIN c0 y ON y.doc_id = b.doc_id
  GROUP BY 1, 2, 3 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.35),
p1 AS (SELECT pair_id, a, b FROM p0 UNION SELECT pair_id, doc_id, doc_id FROM log), p2 AS (SELECT x.pair_id, x.a, y.b FROM p1 x JOIN p1 y ON x.b = y.a GROUP BY 1, 2, 3), p3 AS (SELECT x.pair_id, x.a, y.b FROM p2 x JOIN p2 y ON x.b = y.a GROUP BY 1, 2, 3),
p4 AS (SELECT x.pair_id, x.a, y.b FROM p3 x JOIN p3 y ON x.b = y.a GROUP BY 1, 2, 3), p5 AS (SELECT x.pair_id, x.a, y.b FROM p4 x JOIN p4 y ON x.b = y.a GROUP BY 1, 2, 3),
k AS (SELECT pair_id, a AS doc_id, min(b) AS cluster FROM p5 GROUP BY 1, 2)"""
