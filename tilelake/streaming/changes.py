"""A region index that follows a stream of changed files, and a log of what really changed.

Each micro-batch (trigger it each half second) is made unique by place, its places are looked up as they are now, and
what differs from the stored index goes to the log and into the index, of which only the buckets with differences are
rewritten. A batch of more than CAP places, or one that says that notices were lost, isn't taken one by one: it asks for a
full look, which compares everything there is with the index. A full look comes at most once in REINDEX_MS; until then the
asked one waits, and later batches go on as usual.

All state is in the index table's note: the last batch, whether a full look waits, and when the last one was. It is
published together with the index, after the log; a batch that comes again after that is skipped, one that comes again
before it finds the same differences and writes the same log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.operators import index as I
from tilelake.sources.tables import KeyedTable

CAP, REINDEX_MS = 5000, 30_000
INDEX = "layer string, rx int, rz int, mtime_ms long, size long, is_zip boolean"
LOG = "layer string, rx int, rz int, change string, mtime_ms long, size long, is_zip boolean"


def index_table(spark: SparkSession, root: str, buckets: int = 64) -> KeyedTable:
    return KeyedTable(spark, root, INDEX, I.KEY, buckets)


class IndexFeed:
    """For foreachBatch over notices (layer, rx, rz, t_ms, lost).

    look(places, now_ms) gives the index rows of those places (layer, rx, rz) whose files are there, or of all places for
    None. now_ms is the latest t_ms so far. A notice with lost names no place.
    """

    def __init__(self, table: KeyedTable, look: Callable[[DataFrame | None, int], DataFrame], log: str, cap: int = CAP, reindex_ms: int = REINDEX_MS):
        self.table, self.look, self.log, self.cap, self.reindex_ms = table, look, log.rstrip("/"), cap, reindex_ms

    def __call__(self, batch: DataFrame, number: int) -> None:
        note = self.table.manifest()["note"]
        if note.get("batch", -1) >= number:
            return
        latest, lost = batch.agg(F.max("t_ms"), F.max(F.coalesce("lost", F.lit(False)))).first()
        now = max(note.get("now", 0), latest or 0)
        places = batch.where("not coalesce(lost, false)").select(*I.KEY).distinct()
        flooded = bool(lost) or places.limit(self.cap + 1).count() > self.cap
        waiting, last = note.get("waiting", False) or flooded, note.get("full")
        if waiting and (last is None or now - last >= self.reindex_ms):
            found, waiting, last, full = I.deltas(self.table.read(), self.look(None, now)), False, now, True
        elif flooded:
            found, full = None, False
        else:
            touched = self.table.read(self.table.touched(places)).join(places, list(I.KEY), "left_semi")
            found, full = I.deltas(touched, self.look(places, now)), False
        note = {"batch": number, "now": now, "waiting": waiting, "full": last}
        if found is None:
            self.table.remark(note)
            return
        where = f"{self.log}/batch={number}"
        found.withColumn("full", F.lit(full)).write.mode("overwrite").parquet(where)
        changes = self.table.spark.read.schema(f"{LOG}, full boolean").parquet(where)
        if changes.isEmpty():
            self.table.remark(note)
        else:
            self.table.update(changes, lambda index: I.apply_deltas(index, changes), note)


def changes(spark: SparkSession, log: str) -> DataFrame:
    """The log: batch, layer, rx, rz, change, the new META, and whether a full look found it."""
    return spark.read.schema(f"{LOG}, full boolean, batch int").option("basePath", log).parquet(log)
