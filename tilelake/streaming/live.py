"""Streams: highlights merged as they come, latest positions, rate limits and change batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilelake.operators.highlights import merge
from tilelake.operators.live import admit
from tilelake.sources.tables import Folder

#: Batches after which a stream's deltas are folded into one table.
FOLD_EVERY = 16


def merge_highlights(table: str, keys: tuple[str, ...] = ("dim", "x", "z"), every: int = FOLD_EVERY) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps each batch's minima in folder table/delta and folds every so many batches into table/base.

    A batch reads nothing but itself; only each fold reads and writes the whole. A batch that comes twice writes the same
    delta again, and a fold is made of the base and deltas before it, so a restart changes nothing. A fold deletes what the
    fold before it covers, so two bases and the deltas since the older one are all there ever is.
    """

    def fold(batch: DataFrame, number: int) -> None:
        merge(batch, keys=keys).write.mode("overwrite").parquet(f"{table}/delta/batch={number}")
        if (number + 1) % every == 0:
            merged_highlights(batch.sparkSession, table, number, keys, every, folded=False).write.mode("overwrite").parquet(f"{table}/base/upto={number + 1}")
            folder = Folder(batch.sparkSession, table)
            for kind in ("delta", "base"):
                for name, n in _numbered(folder, kind):
                    if n < number + 1 - every:
                        folder.delete(f"{kind}/{name}")

    return fold


def _numbered(folder: Folder, kind: str) -> list[tuple[str, int]]:
    """Names below a folder of deltas or bases, with their numbers."""
    return [(n, int(n.partition("=")[2])) for n in folder.names(kind) if "=" in n]


def merged_highlights(spark: SparkSession, table: str, last: int | None = None, keys: tuple[str, ...] = ("dim", "x", "z"), every: int = FOLD_EVERY, folded: bool = True) -> DataFrame:
    """The table after batch last (the newest if not given): the latest base and the deltas after it, which partitions prune.

    folded: whether a base that last itself completes is there already.
    """
    if last is None:
        last = max(n for _, n in _numbered(Folder(spark, table), "delta"))
    base = (last + 1 if folded else last) // every * every
    new = spark.read.parquet(f"{table}/delta").where(F.col("batch").between(base, last)).drop("batch")
    return merge(spark.read.parquet(f"{table}/base/upto={base}"), new, keys=keys) if base else merge(new, keys=keys)


def latest_positions(events: DataFrame) -> DataFrame:
    """Each player's last position: a running aggregate, for update or complete mode."""
    return events.groupBy("player").agg(F.max_by(F.struct("event_id", "t_ms", "dim", "x", "z"), F.struct("t_ms", "event_id")).alias("p")).select("player", "p.*")


def rate_limited(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """Events (player, t_ms, event_id) with passed, by a token bucket for each player that lives from batch to batch."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, -1)
        rows = pd.concat(parts).sort_values(["t_ms", "event_id"])
        passed, tokens, last = admit(rows["t_ms"].to_numpy(np.int64), rate, burst, tokens, last if last >= 0 else None)
        state.update((float(tokens), int(last)))
        yield rows.assign(passed=passed)[["event_id", "player", "t_ms", "passed"]]

    return events.groupBy("player").applyInPandasWithState(fold, "event_id long, player long, t_ms long, passed boolean", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by dimension and hour with a watermark (beyond what the archive tools offer)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "dim").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "dim", "n")
