"""Uploaded regions: what can't be taken is set aside, the rest is kept as it came and merged into what is stored.

An upload is one row: number (its place in the order of arrival), player, layer, rx, rz, mtime_ms, t_ms (when it came),
error (why it doesn't decode, else null), truncated, and tiles, the tiles that it holds as (tx, tz, value). A truncated
one is refused, as the client has the whole file and will send it again.

Merging is one after another in the order of arrival: an upload at least as new as what is stored puts all its tiles over
it, an older one only fills gaps, and the stored time is the greater of the two. Taken together that is a running maximum
for each region and one aggregate for each tile, so a batch may hold any number of uploads.

Previews of an uploaded region are evicted later, when its tiles have had time to arrive: evictions() holds each region
for DELAY_MS of event time, in a stream's state until the watermark has passed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilelake.operators import index as I
from tilelake.sources.tables import KeyedTable

DELAY_MS = 2500
UPLOAD = "number long, player string, layer string, rx int, rz int, mtime_ms long, t_ms long, error string, truncated boolean, tiles array<struct<tx: int, tz: int, value: string>>"
STORED = "layer string, rx int, rz int, mtime_ms long, tx int, tz int, value string"
BACKUP = "player string, layer string, rx int, rz int, mtime_ms long, number long, tiles array<struct<tx: int, tz: int, value: string>>"


def refused(uploads: DataFrame) -> DataFrame:
    """number, player, layer, rx, rz, why: uploads that aren't taken."""
    why = F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable: "), "error")).when(F.col("truncated"), "truncated")
    return uploads.select("number", "player", *I.KEY, why.alias("why")).where("why is not null")


def taken(uploads: DataFrame) -> DataFrame:
    return uploads.where("error is null and not coalesce(truncated, false)")


def merged(stored: DataFrame, uploads: DataFrame) -> DataFrame:
    """Tiles (layer, rx, rz, mtime_ms, tx, tz, value) after uploads that were taken; a region without tiles has one null row."""
    old = stored.select(*I.KEY, F.lit(-1).cast("long").alias("number"), "mtime_ms").distinct()
    each = old.union(uploads.select(*I.KEY, "number", "mtime_ms"))
    before = F.max("mtime_ms").over(Window.partitionBy(*I.KEY).orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    # Over what is there, or into its gaps; what came first comes last among those that fill gaps.
    ranked = each.withColumn("over", F.coalesce(F.col("mtime_ms") >= before, F.lit(True)))
    times = each.groupBy(*I.KEY).agg(F.max("mtime_ms").alias("mtime_ms"))
    rank = F.struct("over", F.when(F.col("over"), F.col("number")).otherwise(-F.col("number")).alias("place"))
    tiles = uploads.select(*I.KEY, "number", F.explode("tiles").alias("t")).select(*I.KEY, "number", "t.tx", "t.tz", "t.value")
    tiles = stored.where("tx is not null").select(*I.KEY, F.lit(-1).cast("long").alias("number"), "tx", "tz", "value").union(tiles)
    placed = tiles.join(ranked.select(*I.KEY, "number", "over"), [*I.KEY, "number"])
    best = placed.groupBy(*I.KEY, "tx", "tz").agg(F.max_by("value", rank).alias("value"))
    return times.join(best, list(I.KEY), "left").select(*I.KEY, "mtime_ms", "tx", "tz", "value")


class UploadFeed:
    """For foreachBatch over uploads: refused ones to root/refused, the last of each player and region to root/players, and
    all that were taken into root/merged. Each table's note has the last batch that it took, so a batch that comes again
    changes nothing, whatever was done of it before."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.root = root.rstrip("/")
        self.players = KeyedTable(spark, f"{self.root}/players", BACKUP, ("player", *I.KEY), buckets)
        self.merged = KeyedTable(spark, f"{self.root}/merged", STORED, I.KEY, buckets)

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            refused(rows).write.mode("overwrite").parquet(f"{self.root}/refused/batch={number}")
            new = taken(rows)
            keys = ["player", *I.KEY]
            last = new.groupBy(*keys).agg(F.max_by(F.struct("mtime_ms", "number", "tiles"), "number").alias("u")).select(*keys, "u.*")
            self._take(self.players, last, lambda old: old.join(last.select(*keys), keys, "left_anti").unionByName(last), number)
            places = new.select(*I.KEY).distinct()
            self._take(self.merged, places, lambda old: self._into(old, new, places), number)
        finally:
            rows.unpersist()

    @staticmethod
    def _into(old: DataFrame, new: DataFrame, places: DataFrame) -> DataFrame:
        own = list(I.KEY)
        return old.join(places, own, "left_anti").unionByName(merged(old.join(places, own, "left_semi"), new))

    @staticmethod
    def _take(table: KeyedTable, rows: DataFrame, change, number: int) -> None:
        if table.manifest()["note"].get("batch", -1) < number:
            if rows.isEmpty():
                table.remark({"batch": number})
            else:
                table.update(rows, change, {"batch": number})


def evictions(uploads: DataFrame, delay_ms: int = DELAY_MS, late: str = "0 seconds") -> DataFrame:
    """layer, rx, rz, due_ms: previews to evict, for each upload delay_ms after it came; several due at once are one.

    uploads: a stream of layer, rx, rz, ts (a timestamp). What is due waits as the stream's state, one row for each region
    and time; it goes out, once, when the watermark has passed it, and nothing of it is kept after. The watermark lies the
    delay behind what is due, and thus late behind the uploads: none that is on time for these is too late for its eviction.
    """
    waits = (F.col("ts") + F.make_dt_interval(secs=F.lit(delay_ms / 1000).cast("decimal(18,6)"))).alias("due")
    known = uploads.select(*I.KEY, waits).withWatermark("due", f"{_millis(late) + delay_ms} milliseconds")
    return known.groupBy(*I.KEY, "due").agg(F.count("*").alias("n")).select(*I.KEY, F.unix_millis("due").alias("due_ms"))


def _millis(interval: str) -> int:
    """Milliseconds of an interval such as '10 seconds'."""
    return round(pd.Timedelta(interval).total_seconds() * 1000)


def due(uploads: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """The same from a table (layer, rx, rz, t_ms)."""
    return uploads.select(*I.KEY, (F.col("t_ms") + delay_ms).alias("due_ms")).distinct()
