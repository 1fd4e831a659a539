"""Session helpers: reading the tables, and the folder that every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of an input folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch of texts. Its copies in the JVM and in Python are what a task holds at once.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on texts go to Python in batches of about 4 MB, if the session has no smaller bound: a batch of 10,000 rows
    has no bound in bytes, and long texts would set a task's memory. Results don't depend on it. The bound stays, since
    plans run after the call that made them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(key, "64m").strip()
    if said.startswith("-") or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(said) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, as a URI with its scheme.

    Where a local session names none (tests), a temporary folder is made and set; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext.getCheckpointDir()
        if not held:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="granary-"))
            held = spark.sparkContext.getCheckpointDir()
        named = held
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's part of the shared folder, which goes when the driver ends."""
    own = f"{shared_dir(spark)}/granary/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def placed(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As stored, with the path, for callers that know when no later step reads it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again.

    It cuts the lineage: an executor that is lost later costs a read, not a recomputation.
    """
    return placed(df, label)[0]


def removed(spark: SparkSession, uri: str) -> None:
    """Deletes a scratch path that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
