"""Live positions: latest ones, trails, paths, staleness, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilelake.functions.coords import rgb565

TRAIL_POINTS, TRAIL_MS, TELEPORT_BLOCKS_A_SECOND = 30, 60_000, 150
STALE_MS = 30_000
#: Arrivals, and milliseconds, that one task puts in order at a time.
ORDER_BLOCK, PATH_BLOCK_MS = 1 << 16, 3_600_000


def latest(events: DataFrame) -> DataFrame:
    """Each player's last position: one aggregate, partial before the shuffle."""
    values = F.struct("event_id", "t_ms", "dim", "x", "z")
    return events.groupBy("player").agg(F.max_by(values, F.struct("t_ms", "event_id")).alias("p")).select("player", "p.*")


def in_order(events: DataFrame, block: int = ORDER_BLOCK) -> DataFrame:
    """Events in order of arrival (event_id) that aren't older than one of their player before them.

    A player's running maximum is taken in blocks of arrivals: within a block over its rows, before it over one row a block,
    so that a task sorts a block or a player's blocks, never all of a player's events.
    """
    columns, events = events.columns, events.withColumn("block", F.floor(F.col("event_id") / block))
    tops = events.groupBy("player", "block").agg(F.max("t_ms").alias("top"))
    earlier = Window.partitionBy("player").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("player", "block", F.max("top").over(earlier).alias("earlier"))
    inner = Window.partitionBy("player", "block").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    both = events.withColumn("inner", F.max("t_ms").over(inner)).join(tops, ["player", "block"])
    latest_ = F.greatest("inner", "earlier")
    return both.where(latest_.isNull() | (F.col("t_ms") >= latest_)).select(*columns)


def trails(events: DataFrame) -> DataFrame:
    """The points of each player's trail: the last 30 within 60 seconds of the last, since a change of dimension or a teleport.

    Only those 60 seconds of each player are put in order: what came before cannot reset what follows it.
    """
    last = events.groupBy("player").agg(F.max("t_ms").alias("last_ms"))
    events = events.join(last, "player").where(F.col("last_ms") - F.col("t_ms") <= TRAIL_MS)
    order = Window.partitionBy("player").orderBy("t_ms", "event_id")
    gap = F.greatest(F.lit(1.0), (F.col("t_ms") - F.lag("t_ms").over(order)) / 1000)
    far = F.hypot(F.col("x") - F.lag("x").over(order), F.col("z") - F.lag("z").over(order)) > gap * TELEPORT_BLOCKS_A_SECOND
    reset = F.when((F.col("dim") != F.lag("dim").over(order)) | far, 1).otherwise(0)
    parts = events.withColumn("reset", reset).withColumn("part", F.sum("reset").over(order))
    back = Window.partitionBy("player").orderBy(F.desc("t_ms"), F.desc("event_id"))
    ranked = parts.withColumns({"back": F.row_number().over(back), "last_part": F.first("part").over(back)})
    return ranked.where((F.col("back") <= TRAIL_POINTS) & (F.col("part") == F.col("last_part"))).select("player", "event_id", "t_ms", "x", "z")


def path_length(events: DataFrame, block_ms: int = PATH_BLOCK_MS) -> DataFrame:
    """Blocks walked by each player in each dimension, point to point.

    Points are put in order within stretches of block_ms; from one stretch to the next goes a step from its last point to the
    other's first, found among one row a stretch.
    """
    order, place = F.struct("t_ms", "event_id"), F.struct("x", "z")
    far = lambda x, z, a, b: F.hypot(x - a, z - b)
    events = events.withColumn("block", F.floor(F.col("t_ms") / block_ms))
    inside = Window.partitionBy("player", "dim", "block").orderBy("t_ms", "event_id")
    steps = events.select("player", "dim", far(F.col("x"), F.col("z"), F.lag("x").over(inside), F.lag("z").over(inside)).alias("step"))
    ends = events.groupBy("player", "dim", "block").agg(F.min_by(place, order).alias("first"), F.max_by(place, order).alias("last"))
    along = F.lag("last").over(Window.partitionBy("player", "dim").orderBy("block"))
    across = ends.withColumn("from", along).select("player", "dim", far(F.col("first.x"), F.col("first.z"), F.col("from.x"), F.col("from.z")).alias("step"))
    return steps.union(across).groupBy("player", "dim").agg(F.sum("step").alias("blocks"))


def nether_blocks(lengths: DataFrame) -> DataFrame:
    """Lengths of overworld paths with what they are in the nether, an eighth, in whole blocks; null elsewhere."""
    return lengths.withColumn("nether_blocks", F.when(F.col("dim") == "minecraft:overworld", F.floor(F.col("blocks") / 8 + 0.5)))


def roster_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """player and event of two rosters (player): added or removed."""
    both = before.select("player", F.lit(1).alias("b"), F.lit(0).alias("a")).union(after.select("player", F.lit(0), F.lit(1)))
    seen = both.groupBy("player").agg(F.max("b").alias("b"), F.max("a").alias("a")).where("a <> b")
    return seen.select("player", F.when(F.col("a") == 1, "added").otherwise("removed").alias("event"))


def roster(events: DataFrame, now_ms: int) -> DataFrame:
    return latest(events).select("player", "t_ms", (F.lit(now_ms) - F.col("t_ms") > STALE_MS).alias("stale"))


def change_batches(events: DataFrame, every_ms: int = 500, most: int = 5000) -> DataFrame:
    """Changed places of each half second, once each; a batch of too many is marked for a full index instead."""
    batch = F.floor(F.col("t_ms") / every_ms)
    return events.groupBy(batch.alias("batch"), "dim").agg(F.countDistinct("x", "z").alias("places"), F.count("*").alias("events")).withColumn("overflow", F.col("places") > most)


def admit(times_ms: np.ndarray, rate: float, burst: float, tokens: float, last_ms: int | None) -> tuple[np.ndarray, float, int | None]:
    """Which of some ascending times a token bucket lets pass, and the bucket after them."""
    passed = np.zeros(len(times_ms), bool)
    for k, t in enumerate(times_ms.tolist()):
        if last_ms is not None:
            tokens = min(burst, tokens + max(0, t - last_ms) / 1000 * rate)
        last_ms = t
        if tokens >= 1:
            tokens -= 1
            passed[k] = True
    return passed, tokens, last_ms


def rate_limit(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """event_id, player, t_ms, passed: a token bucket for each player. What passes depends on all before: no window can say it.

    Rows come sorted within partitions dealt by player and are folded as they stream by, so a player may hold any number.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        player, tokens, last = None, burst, None
        for rows in batches:
            out = []
            for who, part in rows.groupby("player", sort=False):
                if who != player:
                    player, tokens, last = who, burst, None
                passed, tokens, last = admit(part["t_ms"].to_numpy(), rate, burst, tokens, last)
                out.append(part.assign(passed=passed))
            if out:
                yield pd.concat(out)[["event_id", "player", "t_ms", "passed"]]

    ordered = events.select("event_id", "player", "t_ms").repartition("player").sortWithinPartitions("player", "t_ms", "event_id")
    return ordered.mapInPandas(fold, "event_id long, player long, t_ms long, passed boolean")


PREVIEW_CHUNKS = 300_000
FLUSH_MS, QUICK_FLUSH_MS, QUICK_PLACES, MOST_PLACES = 10_000, 2_000, 64, 512


def preview_canvas(stored: DataFrame, batch: DataFrame, most: int = PREVIEW_CHUNKS) -> DataFrame:
    """Chunks (dim, cx, cz, first, last, value) of a live preview after a batch of the same columns.

    A chunk keeps when it first came and what came last; of each dimension the most chunks that came first latest stay.
    Chunks are ranked within squares of 64 x 64 before the dimension, so no task orders more than its squares' best.
    """
    both = stored.unionByName(batch.select(*stored.columns))
    each = both.groupBy("dim", "cx", "cz").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max_by("value", "last").alias("value"))
    square = [F.shiftright("cx", 6), F.shiftright("cz", 6)]
    order = [F.desc("first"), "cx", "cz"]
    near = each.withColumn("n", F.row_number().over(Window.partitionBy("dim", *square).orderBy(*order))).where(F.col("n") <= most)
    return near.withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy(*order))).where(F.col("n") <= most).drop("n")


def evict_regions(canvas: DataFrame, regions: DataFrame) -> DataFrame:
    """The canvas without the chunks of regions (dim, rx, rz) whose own files are there now."""
    placed = canvas.withColumns({"rx": F.shiftright("cx", 5), "rz": F.shiftright("cz", 5)})
    return placed.join(regions.select("dim", "rx", "rz").distinct(), ["dim", "rx", "rz"], "left_anti").drop("rx", "rz")


def flushes(changes: DataFrame) -> DataFrame:
    """dim, t_ms, n of each flush of changed places (dim, t_ms, place): the first at once, later ones ten seconds after the
    last, or two where at most 64 places wait; n is null where more than 512 wait, which means all.

    When a flush is due depends on the flushes before it, so rows are folded in order; but after ten quiet seconds the next
    row always flushes. Dimensions are cut there, found from one row for each ten seconds, and the parts are folded on their
    own; what still waits at the end of a part is counted into the next one's first flush. A task keeps at most 513 places.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last, waiting = None, None, set()
        tail = lambda: (*at[:1], at[1] + 1, -1, None, None, None, sorted(waiting))
        for rows in batches:
            out = []
            for dim, part, t, place in rows.itertuples(index=False):
                if (dim, part) != at:
                    if at is not None:
                        out.append(tail())
                    at, last, waiting = (dim, part), t, set()
                    out.append((dim, part, -1, t, None, place, None))
                    continue
                if len(waiting) <= MOST_PLACES:
                    waiting.add(place)
                if t - last >= (QUICK_FLUSH_MS if len(waiting) <= QUICK_PLACES else FLUSH_MS):
                    out.append((dim, part, t, t, len(waiting) if len(waiting) <= MOST_PLACES else None, None, None))
                    last, waiting = t, set()
            if out:
                yield pd.DataFrame(out, columns=names)
        if at is not None:
            yield pd.DataFrame([tail()], columns=names)

    names = ["dim", "part", "slot", "t_ms", "n", "place", "waiting"]
    beat = F.floor(F.col("t_ms") / FLUSH_MS).alias("beat")
    beats = changes.groupBy("dim", beat).agg(F.min("t_ms").alias("t0"), F.max("t_ms").alias("t1"))
    before = F.lag("t1").over(Window.partitionBy("dim").orderBy("beat"))
    beats = beats.withColumn("quiet", F.when(F.col("t0") - before >= FLUSH_MS, 1).otherwise(0))
    beats = beats.select("dim", "beat", F.sum("quiet").over(Window.partitionBy("dim").orderBy("beat")).alias("part"))
    ordered = changes.select("dim", "t_ms", "place", beat).join(beats, ["dim", "beat"]).select("dim", "part", "t_ms", "place")
    ordered = ordered.repartition("dim", "part").sortWithinPartitions("dim", "part", "t_ms", "place")
    found = ordered.mapInPandas(fold, "dim string, part long, slot long, t_ms long, n long, place string, waiting array<string>")
    found = found.groupBy("dim", "part", "slot").agg(*(F.max(c).alias(c) for c in ("t_ms", "n", "place", "waiting"))).where("t_ms is not null")
    first = F.size(F.array_union(F.coalesce("waiting", F.array().cast("array<string>")), F.array("place"))).cast("bigint")
    return found.select("dim", "t_ms", F.when(F.col("place").isNull(), F.col("n")).when(first <= MOST_PLACES, first).alias("n"))


CHUNK_PIXELS, TILE_CHUNKS = 16, 32


def preview_pixels(canvas: DataFrame, zoom: int) -> DataFrame:
    """dim, x, y, tx, tz, r, g, b of preview tiles 2^-zoom regions wide, from chunks (dim, cx, cz, pixels, r, g, b).

    pixels: 256 colours of 16 bits, row by row, 0 where there is nothing. While a chunk has two pixels or more of a tile's
    side each takes the nearest sample; below that a chunk is one pixel of its mean colour r, g, b, and of several chunks
    on one pixel the last by (cz, cx) shows.
    """
    span = 1 << -zoom
    across, side = span * TILE_CHUNKS, CHUNK_PIXELS // span
    tile = [F.floor(F.col(c) / across).cast("bigint").alias(o) for c, o in (("cx", "x"), ("cz", "y"))]
    at = {c: F.pmod(F.col(c), F.lit(across)) for c in ("cx", "cz")}
    if side >= 2:
        step = CHUNK_PIXELS // side
        # The samples alone go through explode, never a chunk's 256 pixels once for each.
        samples = F.array(*(F.get("pixels", F.lit(q * step * CHUNK_PIXELS + p * step)) for q in range(side) for p in range(side))) if step > 1 else F.col("pixels")
        each = canvas.select("dim", *tile, (at["cx"] * side).alias("fx"), (at["cz"] * side).alias("fz"), F.posexplode(samples).alias("k", "v")).where("v <> 0")
        place = (F.col("fx") + F.col("k") % side).cast("bigint").alias("tx"), (F.col("fz") + F.expr(f"k div {side}")).cast("bigint").alias("tz")
        return each.select("dim", "x", "y", *place, *(v.alias(k) for k, v in rgb565(F.col("v")).items()))
    place = [F.floor(at[c] * CHUNK_PIXELS / span).cast("bigint").alias(o) for c, o in (("cx", "tx"), ("cz", "tz"))]
    shown = canvas.select("dim", *tile, *place, F.struct("cz", "cx").alias("order"), F.struct(*"rgb").alias("c"))
    return shown.groupBy("dim", "x", "y", "tx", "tz").agg(F.max_by("c", "order").alias("c")).select("dim", "x", "y", "tx", "tz", "c.*")
