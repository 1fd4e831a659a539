"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Every URL becomes the expressions that could equal a rule: the host's suffixes with as many
labels as some rule has, times the path's prefixes as long as some rule's path. An equi-join on
the first 4 bytes of the expressions' SHA-256 finds candidates, the full digests confirm them, and
the longest rule decides.

Edge cases: a null url, or one without `://`, has an empty host and path and fits no rule. Empty
and repeated urls, repeated or null ids and very long urls are judged like any other; an empty
table gives an empty result. Other columns are not read, whatever their names. Of rules of equal
length the longer host wins, then block over allow. Rules that repeat count once.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import table

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rule lists up to this many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_RULES = 100_000
PREFIX_HEX = 8


def host_and_path(url):
    """The two parts of a url column as rules see them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """id, host, path, rule (host and path of the rule that decides, else null), verdict."""
    spark = pages.sparkSession
    rows = sorted({(v, h.lower(), p) for v, h, p in rules if h})
    labels = sorted({h.count(".") + 1 for _, h, _ in rows})
    lengths = sorted({len(p) for _, _, p in rows})
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not rows:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    listed = spark.createDataFrame(rows, "action string, rule_host string, rule_path string").select(
        "action",
        F.concat("rule_host", "rule_path").alias("rule"),
        F.length("rule_host").alias("host_length"),
        _digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest"),
    )
    listed = listed.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))

    # a url that many pages share is expanded once
    n_labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))) + 1
    distinct = judged.select("host", "path").filter("host <> ''").distinct().withColumn("n_labels", n_labels)
    expressions = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col("n_labels") >= k) & (F.length("path") >= n),
                    _digest(F.substring_index("host", ".", -k), F.substring("path", 1, n)),
                )
                for k in labels
                for n in lengths
            ]
        )
    )
    expanded = distinct.select("host", "path", F.explode(expressions).alias("digest"))
    expanded = expanded.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    candidates = expanded.join(F.broadcast(listed) if len(rows) <= BROADCAST_RULES else listed, "prefix")
    decided = (
        candidates.filter("digest = rule_digest")
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length("rule").alias("n"), "host_length", (F.col("action") == "block").alias("b"), "rule", "action"
                )
            ).alias("best")
        )
        .select(F.concat("host", F.lit("\n"), "path").alias("url_key"), "best.rule", "best.action")
    )
    # pages without a host fit nothing; their key is salted so that they don't meet in one task
    key = F.when(F.col("host") != "", F.concat("host", F.lit("\n"), "path")).otherwise(
        F.concat(F.lit("\n"), F.pmod(F.xxhash64(id_col), F.lit(1024)).cast("string"))
    )
    return (
        judged.withColumn("url_key", key)
        .join(decided, "url_key", "left")
        .select(id_col, "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
    )


def op3_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


OP3_SQL = """
WITH r(action, h, p) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'),
  ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, row_number() OVER () AS rid, regexp_extract(rest, '^[^/?#]*') AS h0, rest FROM u),
j AS (SELECT page_id, rid, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM s),
m AS (SELECT j.rid, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.action, length(r.h || r.p)) AS action
  FROM j JOIN r ON (j.host = r.h OR ends_with(j.host, '.' || r.h)) AND starts_with(j.path, r.p) GROUP BY j.rid)
SELECT j.page_id, j.host, j.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM j LEFT JOIN m USING (rid)
"""
