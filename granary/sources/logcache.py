"""A cache that is a log of batches: each a Parquet folder that counts once it is whole, the last writer of a key wins.

Folders are named by the batches they hold (`rows-<first>-<last>`); Spark's success file is the commit. A batch that was
committed is never written again, one that died half-way is written over, so a retried writer does no harm. Compaction
merges neighbouring folders of like size into one, keeping each key's last row; the merged folder is committed before the
old ones go, and a folder whose batches another one covers is left out, so a compaction that dies does no harm either.

Edge cases: null keys are one key; of a batch's rows of one key the last in the cache's order counts, ties by a hash of
the row; an empty or missing cache has no rows; an empty batch is committed like any other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from granary.session import removed

#: Folders of like size that are merged, and how much larger the next tier's folders are.
FAN_IN = 4
_BATCH = "_batch"


class LogCache:
    """schema: the rows' columns; key: the columns that name a row; order: what orders a batch's rows of one key."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: list[str], order: list[str] | None = None, fan_in: int = FAN_IN):
        self.spark, self.root, self.schema, self.key, self.order, self.fan_in = spark, root, schema, key, order or [], fan_in

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folders(self) -> list[tuple[int, int, int]]:
        """(first batch, last batch, bytes) of each folder that counts, in order."""
        fs = self._fs()
        listed = fs.listStatus(self._path()) if fs.exists(self._path()) else []
        found = [tuple(map(int, m.groups())) for x in listed if (m := re.fullmatch(r"rows-(\d+)-(\d+)", x.getPath().getName())) and fs.exists(self._path(f"{m[0]}/_SUCCESS"))]
        top = [(a, b) for a, b in found if not any((c, d) != (a, b) and c <= a and b <= d for c, d in found)]
        return [(a, b, fs.getContentSummary(self._path(f"rows-{a}-{b}")).getLength()) for a, b in sorted(top)]

    def has(self, batch: int) -> bool:
        return any(a <= batch <= b for a, b, _ in self.folders())

    def _write(self, rows: DataFrame, a: int, b: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/rows-{a}-{b}")

    def put(self, rows: DataFrame, batch: int) -> bool:
        """Commits the batch's rows; says whether it was new. A batch that is there already stays as it is."""
        if self.has(batch):
            return False
        self._write(self._last(rows.select(*self.schema.names).withColumn(_BATCH, F.lit(batch).cast("bigint"))), batch, batch)
        self.compact()
        return True

    def _rank(self) -> Column:
        hashed = F.xxhash64(*self.schema.names, *[F.col(c).isNull() for c in self.schema.names])
        return F.struct(_BATCH, *self.order, hashed.alias("_hash"))

    def _last(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*self.schema.names, _BATCH), self._rank()).alias("_row")).select("_row.*")

    def _read(self, ranges: list[tuple[int, int]]) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(_BATCH, LongType())])
        if not ranges:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/rows-{a}-{b}" for a, b in ranges])

    def rows(self) -> DataFrame:
        """The last row of each key."""
        return self._last(self._read([(a, b) for a, b, _ in self.folders()])).select(*self.schema.names)

    def misses(self, wanted: DataFrame) -> DataFrame:
        """The rows of wanted whose key the cache lacks; a key that comes several times comes once."""
        held = self._read([(a, b) for a, b, _ in self.folders()]).select(*[F.col(k).alias(f"_held_{k}") for k in self.key]).distinct()
        on = F.lit(True)
        for k in self.key:
            on = on & F.col(k).eqNullSafe(F.col(f"_held_{k}"))
        return wanted.dropDuplicates(self.key).join(held, on, "left_anti")

    def compact(self) -> None:
        """Merges runs of fan_in neighbours of one size tier until there is none."""
        while True:
            found = self.folders()
            tier = lambda n: max(0, (max(n, 1) - 1).bit_length() // max(1, (self.fan_in - 1).bit_length()))
            run = next((found[i : i + self.fan_in] for i in range(len(found) - self.fan_in + 1) if len({tier(n) for *_, n in found[i : i + self.fan_in]}) == 1), None)
            if run is None:
                return
            self._write(self._last(self._read([(a, b) for a, b, _ in run])), run[0][0], run[-1][1])
            for a, b, _ in run:
                removed(self.spark, f"{self.root}/rows-{a}-{b}")
