"""JSON Lines, whole JSON documents, append-only caches and small model files, through Spark's readers and writers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object per line; unknown keys are dropped, blank lines skipped, missing keys null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).na.drop("all")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Writes one object per row (mode overwrite or append); returns the number of rows, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A whole-file JSON array or object."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_pretty_json(spark: SparkSession, path: str, value) -> None:
    """A small value (dicts, lists, numbers, texts, or a DataFrame of at most 10,000 rows) as one indented JSON text."""
    if isinstance(value, DataFrame):
        value = [r.asDict(recursive=True) for r in value.limit(10_001).collect()]
        if len(value) > 10_000:
            raise ValueError("more than 10000 rows for one JSON text; use write_jsonl")
    text = json.dumps(value, ensure_ascii=False, indent=2, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str, root: str | None = None) -> dict:
    """A YAML or JSON file of settings; relative entries of its `paths` are put below root, which `root` of the result names."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    if path.endswith(".json"):
        out = json.loads(text)
    else:
        import yaml

        out = yaml.safe_load(text) or {}
    if root is not None:
        join = lambda p: p if "://" in p or p.startswith("/") else f"{root.rstrip('/')}/{p}"
        out = {**out, "root": root, **({"paths": {k: join(v) for k, v in out["paths"].items()}} if "paths" in out else {})}
    return out


def append_row(spark: SparkSession, path: str, row: dict, schema: StructType | str) -> None:
    """One row behind those of an append-only log; for single steps, not in loops over many rows."""
    write_jsonl(spark.createDataFrame([row], schema), path, "append")


def to_rows(df: DataFrame, name: str = "row") -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """An append-only log as a table: the last row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return log.withColumn("_place", place).filter("_place = 1").drop("_place")


def misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key).distinct(), key, "left_anti")


def without(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return df.join(listed.select(key).distinct(), key, "left_anti")


def save_model(spark: SparkSession, path: str, model: dict) -> None:
    """A model of a few numbers as a one-row JSON file."""
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3, most: int = 200) -> str:
    """A small aggregate as a table; more than `most` rows are an error, so none is left out without a word."""
    columns = list(columns or df.columns)
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a table")
    lines += ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows]
    return "\n".join(lines)
