"""The corpus pipeline: documents to token ids, in five stages.

Toxicity drops the documents that the classifier rejects; SimHash near-dedup keeps one document of each
group; substring dedup cuts words that repeated windows cover; mixing repeats or leaves out documents to
meet the sources' target weights; byte-level BPE encodes what is left, one row per copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, mixing, simhash, substring, toxicity
from granary.session import scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs.select(*COLUMNS), model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring.deduplicated(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.lit(0).cast("bigint"))).select(*COLUMNS)


def meet_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("toxicity", keep_harmless),
    ("simhash near-dedup", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("mixing", meet_targets),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written in the shared folder and read as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The classifier and XXH64 are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None
