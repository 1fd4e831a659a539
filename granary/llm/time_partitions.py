"""Adaptive time partitions: a folder of Parquet files whose leaves hold at most `most` rows each, rewritten in place.

Years from the first to the last moment are siblings. A node above `most` rows splits into all its months, days or
hours; siblings within it, empty ones too, join the run before them while that stays within `most`. Leaves are runs with
rows, hours above `most`, and all null moments together. A leaf's rows, in order, fill parts of `most` rows; each part is
one file.

Rolling writer: rows are clustered by leaf and part, sorted within tasks and written by partitionBy with
maxRecordsPerFile. They go to a stage beside the folder; ordered hashes of each staged file and of the folder's own file of
the same leaf and part are compared, and only files that differ are renamed into the folder. Those it holds no longer go.
What is to move is written before anything moves and every move can be made again, so moved() ends a change that a lost
driver left half done.

Skew: hours are counted with partial sums. Leaves above `most` (one hour, or the null moments, of any share of the rows)
are numbered by ranges of the whole order with running sums, so no task holds more than a range or a part. What is
broadcast is the members of the runs: children of split nodes, each of which has more than `most` rows, so 3 levels times
31 children times rows / most, and the years; above BROADCAST_MEMBERS rows they are joined by a shuffle.

All is DataFrame functions; the driver renames files, as many as rows / most allow.

Edge cases: null moments form the leaf `null`; nulls come first in every order; rows that tie in moment and order go by a
hash of their columns, rows that repeat whole are kept as often as they come; an empty table leaves a folder without
data files; columns of any name go into the files (map columns can't be hashed and are an error).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.operators.ranges import running
from granary.session import removed, shared_dir, stored, table

BROADCAST_MEMBERS = 200_000
NULL_CODE = -1
#: Members of a node as one number: year, month, day and hour + 1, where what a level doesn't have is 0.
_CODES = {
    "year_code": "y * 16384L",
    "month_code": "y * 16384L + m * 1024",
    "day_code": "y * 16384L + m * 1024 + d * 32",
    "hour_code": f"coalesce(y * 16384L + m * 1024 + d * 32 + h + 1, {NULL_CODE}L)",
}
_UNITS = {"y": F.year, "m": F.month, "d": F.dayofmonth, "h": F.hour}


def free(name: str, columns: Sequence[str]) -> str:
    """name, or name with marks behind it that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(columns: Sequence[str]) -> Column:
    """A hash of all columns that tells nulls apart by their places."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`").isNull() for c in columns])


def keyed(rows: DataFrame, moment: Column, order: Sequence[Column]) -> DataFrame:
    """The rows as structs, their moment and its units, what orders them, and a code for each level."""
    out = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), moment.alias("moment"), *[c.alias(f"o{i}") for i, c in enumerate(order)], row_hash(rows.columns).alias("tie"))
    return out.withColumns({k: f("moment") for k, f in _UNITS.items()}).withColumns({k: F.expr(v) for k, v in _CODES.items()})


def _runs(nodes: DataFrame, most: int, step: int, last: bool) -> DataFrame:
    """code, leaf, n of the members of each leaf below nodes (label, code, children, counts); a member's code is
    the node's plus child * step."""
    form = "'%02d'" if step < 16384 else "'%04d'"
    packed = F.expr(f"""
        aggregate(children, cast(array() AS array<struct<first:int,last:int,n:bigint,big:boolean>>), (runs, c) -> CASE
          WHEN coalesce(try_element_at(counts, c), 0L) > {most}
            THEN concat(runs, array(named_struct('first', c, 'last', c, 'n', try_element_at(counts, c), 'big', true)))
          WHEN NOT coalesce(try_element_at(runs, -1).big, true) AND try_element_at(runs, -1).n + coalesce(try_element_at(counts, c), 0L) <= {most}
            THEN concat(slice(runs, 1, size(runs) - 1), array(named_struct('first', try_element_at(runs, -1).first, 'last', c, 'n', try_element_at(runs, -1).n + coalesce(try_element_at(counts, c), 0L), 'big', false)))
          ELSE concat(runs, array(named_struct('first', c, 'last', c, 'n', coalesce(try_element_at(counts, c), 0L), 'big', false))) END)""")
    leaves = nodes.select("label", "code", F.explode(packed).alias("run")).filter(f"run.n > 0 AND ({str(last).lower()} OR NOT run.big)")
    named = leaves.select("code", "run", F.expr(f"concat(label, format_string({form}, run.first), '-', format_string({form}, run.last))").alias("leaf"))
    return named.select(F.expr(f"explode(transform(sequence(run.first, run.last), c -> code + c * {step}L + {int(last)}))").alias("code"), "leaf", F.col("run.n").alias("n"))


def layout(rows: DataFrame, most: int) -> DataFrame:
    """code, leaf, n: the members of each leaf, and the rows of that leaf; rows as keyed() gives them."""
    hours = stored(rows.groupBy("y", "m", "d", "h").agg(F.count(F.lit(1)).alias("n")), "hours")
    full = hours.filter("y IS NOT NULL")
    above = lambda df, keys, child: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(child, "n"))).alias("counts"))
    days = above(full, ["y", "m", "d"], "h")
    months = above(days, ["y", "m"], "d")
    years = above(months, ["y"], "m")
    root = years.groupBy().agg(F.min("y").alias("a"), F.max("y").alias("b"), F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("counts")).filter("a IS NOT NULL")
    node = lambda df, label, code, children: df.selectExpr(f"{label} AS label", f"{code} AS code", f"{children} AS children", "counts")
    big = f"n > {most}"
    found = [
        _runs(node(root, "''", "0L", "sequence(a, b)"), most, 16384, False),
        _runs(node(years.filter(big), "format_string('%04d/', y)", _CODES["year_code"], "sequence(1, 12)"), most, 1024, False),
        _runs(node(months.filter(big), "format_string('%04d/%02d/', y, m)", _CODES["month_code"], "sequence(1, day(last_day(make_date(y, m, 1))))"), most, 32, False),
        _runs(node(days.filter(big), "format_string('%04d/%02d/%02d/', y, m, d)", _CODES["day_code"], "sequence(0, 23)"), most, 1, True),
        hours.filter("y IS NULL").selectExpr(f"{NULL_CODE}L AS code", "'null' AS leaf", "n"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return stored(out, "layout")


def arranged(rows: DataFrame, members: DataFrame, most: int, order: Sequence[str]) -> DataFrame:
    """The rows with leaf and part. Only leaves above `most` rows need places, which come from ranges."""
    small = members.count() <= BROADCAST_MEMBERS
    for level in _CODES:
        side = members.select(F.col("code").alias(level), F.col("leaf").alias(f"leaf_{level}"), F.col("n").alias(f"n_{level}"))
        rows = rows.join(F.broadcast(side) if small else side, level, "left")
    rows = rows.select("row", "moment", *order, "tie", F.coalesce(*[f"leaf_{x}" for x in _CODES], F.lit("null")).alias("leaf"), F.coalesce(*[f"n_{x}" for x in _CODES]).alias("n"))
    out = rows.filter(f"n <= {most}").withColumn("part", F.lit(1)).drop("n")
    large = members.filter(f"n > {most}").select("leaf", "n").distinct()
    starts = sorted((r["leaf"], r["n"]) for r in large.collect())  # at most rows / most
    if starts:
        offsets, before = [], 0
        for leaf, n in starts:
            offsets.append((leaf, before))
            before += n
        spark = rows.sparkSession
        placed = running(rows.filter(f"n > {most}").drop("n"), ["leaf", "moment", *order, "tie"], {"place": F.lit(1)}, "places")
        first = spark.createDataFrame(offsets, "leaf string, before bigint")
        part = F.expr(f"CAST((place - before - 1) DIV {most} + 1 AS INT)")
        out = out.unionByName(placed.join(F.broadcast(first), "leaf").withColumn("part", part).drop("place", "before"))
    return out


def names(columns: Sequence[str]) -> tuple[str, str]:
    """The folder's partition columns, which no column of the table is called."""
    return free("leaf", columns), free("part", columns)


def staged(rows: DataFrame, stage: str, most: int, moment: Column, order: Sequence[Column]) -> None:
    """Writes the rows in their layout below stage."""
    at, part = names(rows.columns)
    held, by = keyed(rows, moment, order), [f"o{i}" for i in range(len(order))]
    done = arranged(held, layout(held, most), most, by)
    done = done.repartition("leaf", "part").withColumn("leaf", F.translate("leaf", "/", ".")).sortWithinPartitions("leaf", "part", "moment", *by, "tie")
    done = done.select("row.*", *[F.col(x).alias(y) for x, y in (("leaf", at), ("part", part)) if y not in rows.columns])
    done.write.partitionBy(at, part).option("maxRecordsPerFile", most).parquet(stage)


def manifest(spark: SparkSession, folder: str, schema: T.StructType, digests: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """leaf, part, path, n_rows, content of each file below folder; content is a hash of its rows in their order.

    digests: SHA-256 of a column's texts in the file's order, comma-joined; sums: of columns. A file's hashes are
    gathered, so `most` bounds what a group holds."""
    at, part = names(schema.names)
    digests, sums = digests or {}, sums or {}
    held = spark.read.schema(T.StructType([*schema.fields, T.StructField(at, T.StringType()), T.StructField(part, T.IntegerType())])).parquet(folder)
    texts = {"content": row_hash(schema.names).cast("string")} | {k: F.coalesce(v, F.lit("")) for k, v in digests.items()}
    seen = held.select(F.translate(F.col(at), ".", "/").alias("leaf"), F.col(part).cast("bigint").alias("part"), F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.row_index").alias("i"), *[v.alias(f"t_{k}") for k, v in texts.items()]).alias("x"), *[v.cast("bigint").alias(f"s_{k}") for k, v in sums.items()])
    out = seen.groupBy("leaf", "part", "path").agg(F.count(F.lit(1)).alias("n_rows"), F.sort_array(F.collect_list("x")).alias("xs"), *[F.sum(f"s_{k}").alias(k) for k in sums])
    return out.select("leaf", "part", "path", "n_rows", *sums, *[F.sha2(F.concat_ws(",", F.col(f"xs.t_{k}")), 256).alias(k) for k in texts])


def changes(spark: SparkSession, folder: str, stage: str, schema: T.StructType) -> DataFrame:
    """leaf, part, old, new (paths or null), stays: the files of the folder against those of the stage."""
    old, new = manifest(spark, folder, schema), manifest(spark, stage, schema)
    both = old.select("leaf", "part", F.col("path").alias("old"), F.col("content").alias("was")).join(new.select("leaf", "part", F.col("path").alias("new"), "content"), ["leaf", "part"], "full")
    return both.select("leaf", "part", "old", "new", F.coalesce(F.col("was") == F.col("content"), F.lit(False)).alias("stays"))


def moved(plan: DataFrame, folder: str, stage: str) -> None:
    """Makes the moves of a plan as changes() gives it; a move that was made before is passed over."""
    spark = plan.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    inside = lambda x: "/".join(x.split("/")[-3:])
    for r in plan.filter("NOT stays").toLocalIterator():
        if r["old"] is not None and (r["new"] is None or inside(r["old"]) != inside(r["new"])):
            fs.delete(path(f"{folder}/{inside(r['old'])}"), False)
        if r["new"] is not None and fs.exists(source := path(f"{stage}/{inside(r['new'])}")):
            target = path(f"{folder}/{inside(r['new'])}")
            fs.mkdirs(target.getParent())
            if not fs.rename(source, target):
                raise OSError(f"{source.toString()} can't be renamed to {target.toString()}")


def rewritten(rows: DataFrame, folder: str, most: int, moment: Column, order: Sequence[Column]) -> DataFrame:
    """Lays the rows out in folder, which is new or was written by this; returns leaf, part, rewritten of each file.

    most: rows of a leaf and of a file. moment: the timestamp that places a row; order: what orders rows of one moment."""
    spark = rows.sparkSession
    stage = f"{folder}.stage-{uuid.uuid4().hex}"
    staged(rows, stage, most, moment, order)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        fs.rename(path(stage), path(folder))
        return manifest(spark, folder, rows.schema).select("leaf", "part", F.lit(True).alias("rewritten"))
    plan = stored(changes(spark, folder, stage, rows.schema), "moves")
    moved(plan, folder, stage)
    removed(spark, stage)
    return plan.filter("new IS NOT NULL").select("leaf", "part", (~F.col("stays")).alias("rewritten"))


#: Starting files hold what arrived before this.
CUTOFF = "2024-03-01 00:00:00"
FILES = 650


def click_moment(rows: DataFrame) -> Column:
    """ts, moved back up to 21^3 days for an eighth of the ids, and set to its Monday for another eighth."""
    kind = rows.schema["ts"].dataType.simpleString()
    k = "(crc32(CAST(click_id AS STRING)) % 128)"
    back = f"CAST(({k} + 6) * ({k} + 6) * ({k} + 6) AS INT)"
    return F.expr(f"CASE WHEN {k} < 16 THEN ts - make_dt_interval({back}) WHEN {k} > 111 THEN CAST(trunc(CAST(ts AS DATE), 'week') AS {kind}) ELSE ts END")


def op13_time_partitions(spark, sf_dir):
    clicks = table(spark, sf_dir, "clicks")
    early = F.coalesce(F.col("arrived_at") < F.lit(CUTOFF).cast(clicks.schema["arrived_at"].dataType), F.lit(False))
    most, moment, order = 1 + clicks.count() // FILES, click_moment(clicks), [F.col("arrived_at"), F.col("click_id")]
    folder = f"{shared_dir(spark)}/time-partitions-{uuid.uuid4().hex}/clicks"
    rewritten(clicks.filter(early), folder, most, moment, order)
    fate = rewritten(clicks, folder, most, moment, order)
    files = manifest(spark, folder, clicks.schema, {"ids_sha256": F.col("click_id").cast("string")}, {"n_new": ~early})
    return files.join(fate, ["leaf", "part"]).select("leaf", "part", "n_rows", "n_new", F.lit(",".join(clicks.columns)).alias("columns"), "ids_sha256", "path", "rewritten")
