"""The waypoint history as a table: each scan rewrites what its files' buckets hold, and lists come out in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilelake.operators import waypoints as W
from tilelake.sources.tables import KeyedTable


def vault(spark: SparkSession, root: str, records: T.StructType, buckets: int = 64) -> KeyedTable:
    """The history below root, in buckets by file; records: the schema of what scans find (W.parse with W.GROUP, source)."""
    fields = [T.StructField(c, records[c].dataType) for c in (*W.KEY, *W.ATTRIBUTES, "source")]
    times = [T.StructField("present", T.BooleanType()), T.StructField("first_seen", T.LongType()), T.StructField("last_seen", T.LongType())]
    return KeyedTable(spark, root, T.StructType([*fields, *times]), W.GROUP, buckets)


def sync(table: KeyedTable, batch: DataFrame, scanned: DataFrame, now_ms: int) -> int:
    """Take a scan into the table: see W.sync. Only buckets of files that were scanned, or have records, are rewritten."""
    files = scanned.select(*W.GROUP).union(batch.select(*W.GROUP)).distinct()
    return table.update(files, lambda old: W.sync(old, batch, files.join(scanned.select(*W.GROUP).distinct(), list(W.GROUP), "left_semi"), now_ms).drop("was_present"), {"synced_ms": now_ms})


ORDER = ("world", "dim", "name", "mw_file", "x", "y_key", "z")


def export(history: DataFrame, path: str, with_archived: bool = False, world: str | None = None) -> DataFrame:
    """Write the present (or all) waypoints' lines to path, ordered, and return them as (world, mw_file, line, number).

    Tasks sort ranges of the order; a line's number is its place in its range and the sizes of the ranges before, of which
    there is one number a range: nothing goes through one task.
    """
    rows = history if with_archived else history.where("present")
    rows = rows if world is None else rows.where(F.col("world") == world)
    lines = rows.select(*ORDER, W.format_line().alias("line"))
    dealt = lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("world", "mw_file", "line", F.monotonically_increasing_id().alias("at"))
    dealt.write.mode("overwrite").parquet(path)
    return numbered(history.sparkSession, path)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """An export's lines with their numbers from 1, as it was written."""
    written = spark.read.parquet(path).withColumn("range", F.shiftright("at", 33))
    sizes = written.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect()  # one row a range
    before, starts = 0, []
    for r, n in sizes:
        starts.append((r, before))
        before += n
    starts = spark.createDataFrame(starts, "range long, before long")
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return written.join(F.broadcast(starts), "range").select("world", "mw_file", "line", place.alias("number"))
