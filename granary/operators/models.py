"""Boundaries to external models: Arrow-batched callables, with deterministic stand-ins."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A stand-in for an answer extractor: the first year between 1800 and 1999.
_YEAR = re.compile(r"\b(1[89]\d\d)\b")


def year_extractor(question: str, passage: str) -> str:
    found = _YEAR.search(passage or "")
    return f"The answer is {found.group(1)}" if found else "unknown"


def extracted(df: DataFrame, extract: Callable[[str, str], str] = year_extractor, question="question", text="text", out="answer") -> DataFrame:
    """df with the raw answer of extract(question, passage) for each row, batch by batch."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, passages in batches:
            yield pd.Series([extract(q, p) for q, p in zip(questions, passages, strict=True)], dtype=object)

    return df.withColumn(out, run(question, text))


def written(rows: DataFrame, write: Callable[[str, str, int], str]) -> DataFrame:
    """rows (prompt, doc_id, attempt, more) with the text that write makes of these three: the generator's interface."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for prompts, ids, attempts in batches:
            yield pd.Series([write(p, d, int(a)) for p, d, a in zip(prompts, ids, attempts, strict=True)], dtype=object)

    return rows.withColumn("text", run("prompt", "doc_id", "attempt"))


def answered(contexts: DataFrame, answer: Callable[[str, list[str], list[float]], str]) -> DataFrame:
    """ctx, answer for rows ctx, question, passages (array), weights (array): the reader's interface."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            said = [answer(q, list(p), list(map(float, w))) for q, p, w in zip(rows["question"], rows["passages"], rows["weights"], strict=True)]
            yield pd.DataFrame({"ctx": rows["ctx"], "answer": pd.Series(said, dtype=object)})

    return contexts.select(F.col("ctx").cast("string").alias("ctx"), "question", "passages", "weights").mapInPandas(run, "ctx string, answer string")
