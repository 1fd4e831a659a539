"""Running sums over all rows in one order, range by range: no task sorts more than a range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import stored


def running(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column | str], label: str = "ranges") -> DataFrame:
    """df with a column for each of sums: its total over the rows up to and with this one in the given order.

    Rows that tie are counted one by one, in an order of their own. Ranges are drawn by sampling and written, so that
    their numbers hold; one row of sums a range tells what stands before it. An empty table stays empty."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.withColumns({f"_s_{k}": F.expr(v) if isinstance(v, str) else v for k, v in sums.items()}).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), label)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_range").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    bases = bases.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_u_{k}": F.sum(f"_s_{k}").over(inside) for k in sums}).join(F.broadcast(bases), "_range")
    return out.select(*df.columns, *[(F.col(f"_b_{k}") + F.col(f"_u_{k}")).alias(k) for k in sums])
