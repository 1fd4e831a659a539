"""Incremental forms of the caches and work queues, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.logcache import LogCache


def once_per_key(stream: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; state is dropped `delay` after the key's time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, keys: list[str], length: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows and value sums per window and keys; late rows count until the watermark passes."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))


def append_misses(stream: DataFrame, cache: LogCache, compute: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Each micro-batch computes only keys that the cache lacks, and commits them under the batch's number.

    A batch that died before its commit is computed again; one that was committed isn't."""

    def write(batch: DataFrame, number: int) -> None:
        if not cache.has(number):
            cache.put(compute(cache.misses(batch)), number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
