"""Chunk highlights: window scans, tile grids, merges that keep the oldest sighting or the greatest height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the file format, in the order in which names are tried: part of the name, label, colour, meaning.
PALETTE = [
    ("NewChunksLiquidInverse", "New chunks (liquid, inverse)", 0x2AB5A0, "timestamp"),
    ("PaletteNewChunksInverse", "New chunks (palette, inverse)", 0x1E88E5, "timestamp"),
    ("PaletteNewChunks", "New chunks (palette)", 0xFF7A00, "timestamp"),
    ("NewChunks", "New chunks (liquid)", 0xFF3B30, "timestamp"),
    ("OldChunks", "Old chunks", 0xE6C229, "timestamp"),
    ("ModernChunks", "Modern chunks", 0x58D05B, "timestamp"),
    ("Portals", "Portals", 0xC678DD, "timestamp"),
    ("LavaColumns", "Lava columns", 0xFF8C1A, "height"),
    ("OldBiomes", "Old biomes", 0x3D9DF2, "timestamp"),
    ("Breadcrumbs", "Breadcrumbs", 0xEEEEEE, "timestamp"),
]
#: Lava columns below this height aren't drawn; alpha grows by so much with each block.
LAVA_MIN_HEIGHT, LAVA_ALPHA_SHIFT, LAVA_ALPHA_STEP = 5, 0, 8
#: Numeric table names of old files.
LEGACY_DIMENSIONS = {"0": "minecraft:overworld", "-1": "minecraft:the_nether", "1": "minecraft:the_end"}


def palette_field(name: Column, field: int) -> Column:
    """The label (1), colour (2) or meaning (3) of the first palette entry whose pattern the name contains."""
    out = None
    for entry in PALETTE:
        hit = F.contains(name, F.lit(entry[0]))
        out = F.when(hit, entry[field]) if out is None else out.when(hit, entry[field])
    return out.otherwise("timestamp") if field == 3 else out


def hex_colour(rgb: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(rgb.cast("bigint")), 6, "0")))


def canonical_dimension(name: Column) -> Column:
    """Resource key of a dimension table's name."""
    named = F.create_map(*(F.lit(v) for kv in LEGACY_DIMENSIONS.items() for v in kv))
    return F.coalesce(F.try_element_at(named, name), name)


def window(df: DataFrame, x0: int, z0: int, x1: int, z1: int) -> DataFrame:
    """Rows in the half-open window; plain comparisons, which reach the Parquet scan."""
    return df.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("z") >= z0) & (F.col("z") < z1))


def tile_grid(df: DataFrame, x0: int, z0: int, span: int, tile_size: int, value: str | None = None, largest: bool = False, min_value: int | None = None) -> DataFrame:
    """cell_x, cell_z, n, and value where asked for: chunks in each cell of a square tile.

    value names the column whose least (or largest) is kept; without it that column isn't read. min_value leaves out rows
    below it. The aggregate is partial before the shuffle, so at most cells^2 rows leave each task.
    """
    cells = min(tile_size, span)
    df = window(df, x0, z0, x0 + span, z0 + span)
    if min_value is not None:
        df = df.where(F.col(value) >= min_value)
    at = {c: F.expr(f"cast((({o} - {lo}) * {cells}) div {span} as int)") for c, o, lo in (("cell_x", "x", x0), ("cell_z", "z", z0))}
    aggs = [F.count("*").alias("n")] + ([(F.max if largest else F.min)(value).alias("value")] if value else [])
    return df.groupBy(*(c.alias(k) for k, c in at.items())).agg(*aggs)


def dense_grid(spark: SparkSession, grid: DataFrame, cells: int) -> DataFrame:
    """All cells of a tile, with n 0 and no value where the grid has none."""
    side = [spark.range(cells).select(F.col("id").cast("int").alias(c)) for c in ("cell_x", "cell_z")]
    every = side[0].select("cell_x", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell_z"))
    return every.join(grid, ["cell_x", "cell_z"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def row_cap(df: DataFrame, cap: int) -> DataFrame:
    """One row: rows (at most cap) and truncated, true only if there is a row beyond the cap."""
    n = df.limit(cap + 1).agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(cap)).cast("bigint").alias("rows"), (F.col("n") > cap).alias("truncated"))


def normalise(df: DataFrame, keys: tuple[str, ...], priority: str, order: str) -> DataFrame:
    """One row for each key: that of the highest priority (least number), then the first in order, then by its other columns."""
    others = [c for c in df.columns if c not in (*keys, priority, order)]
    return df.groupBy(*keys).agg(F.min(F.struct(priority, order, *others)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def merge(*sides: DataFrame, value: str = "found_time", largest: bool = False, keys: tuple[str, ...] = ("dim", "x", "z")) -> DataFrame:
    """Union by key: the least value, or the largest; a null never wins. Commutative and idempotent."""
    both = sides[0].select(*keys, value)
    for s in sides[1:]:
        both = both.unionByName(s.select(*keys, value))
    return both.groupBy(*keys).agg((F.max if largest else F.min)(value).alias(value))


def merge_report(dest: DataFrame, source: DataFrame, keys: tuple[str, ...] = ("dim", "x", "z")) -> DataFrame:
    """For each dimension: source_rows, dest_before, overlap and dest_after = dest_before + source_rows - overlap.

    One shuffle by key marks where each key occurs; no join is needed.
    """
    both = dest.select(*keys, F.lit(1).alias("d"), F.lit(0).alias("s")).unionByName(source.select(*keys, F.lit(0).alias("d"), F.lit(1).alias("s")))
    at = both.groupBy(*keys).agg(F.max("d").alias("d"), F.max("s").alias("s"))
    sums = {"source_rows": F.sum("s"), "dest_before": F.sum("d"), "overlap": F.sum(F.col("d") * F.col("s")), "dest_after": F.count("*")}
    return at.groupBy("dim").agg(*(v.cast("bigint").alias(k) for k, v in sums.items()))


def dry_run(dest: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ("dim", "x", "z")) -> DataFrame:
    """For each source (column src) and dimension, counts against the destination as it is, not as earlier sources leave it."""
    own = dest.select(*keys).distinct().withColumn("hit", F.lit(1))
    src = sources.select("src", *keys).distinct().join(own, list(keys), "left")
    before = own.groupBy("dim").agg(F.count("*").alias("dest_before"))
    counts = src.groupBy("src", "dim").agg(F.count("*").alias("source_rows"), F.count("hit").alias("overlap"))
    out = counts.join(before, "dim", "left").withColumn("dest_before", F.coalesce("dest_before", F.lit(0)))
    return out.withColumn("dest_after", F.col("dest_before") + F.col("source_rows") - F.col("overlap"))


def live_upsert(stored: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("dim", "x", "z")) -> DataFrame:
    """The table after a batch of sightings: keys, found_time, changed. New keys and lowered times change.

    A stored null stays: it is not replaced by a time.
    """
    new = batch.groupBy(*keys).agg(F.min("found_time").alias("new"))
    out = stored.select(*keys, F.col("found_time").alias("old"), F.lit(True).alias("known")).join(new, list(keys), "full_outer")
    known = F.coalesce("known", F.lit(False))
    time = F.when(~known, F.col("new")).when(F.col("old").isNull() | F.col("new").isNull(), F.col("old")).otherwise(F.least("old", "new"))
    changed = F.when(~known, True).otherwise(F.coalesce(F.col("new") < F.col("old"), F.lit(False)))
    return out.select(*keys, time.alias("found_time"), changed.alias("changed"))


def lava_alpha(height: Column) -> Column:
    return F.when(height >= LAVA_MIN_HEIGHT, F.greatest(F.lit(0), F.least(F.lit(255), LAVA_ALPHA_SHIFT + height * LAVA_ALPHA_STEP)).cast("int"))
