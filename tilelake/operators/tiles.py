"""Tiles and pixels: box downscaling, composition, coalescing merges, palettes and slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest cell sizes, in pixels, for which the 8 and the 32 pixel thumbnail of a region are enough.
MIP_PIXELS, THUMB_PIXELS = 8, 32


def box_downscale(pixels: DataFrame, factor: int, key: str = "region") -> DataFrame:
    """Mean colour weighted by alpha and mean alpha of factor x factor boxes, in whole numbers; an empty box is 0."""
    at = {c: F.floor(F.col(c) / factor).cast("bigint") for c in ("px", "pz")}
    weight = F.sum("a")
    colour = {c: F.coalesce(F.expr(f"try_divide(sum({c} * a) - sum({c} * a) % greatest(sum(a), 1), greatest(sum(a), 1))").cast("bigint"), F.lit(0)) for c in "rgb"}
    out = pixels.groupBy(key, *(v.alias(c) for c, v in at.items())).agg(*(v.alias(c) for c, v in colour.items()), weight.alias("total"))
    return out.select(key, "px", "pz", *(F.when(F.col("total") > 0, F.col(c)).otherwise(0).alias(c) for c in "rgb"), F.expr(f"total div {factor * factor}").alias("a"))


def sub_pixel(pixels: DataFrame, regions_per_pixel: int) -> DataFrame:
    """Regions smaller than a pixel: colour by alpha, alpha by covered area but at least 64 of 255."""
    cover = F.sum("a") / 255.0
    sums = pixels.groupBy("region").agg(*((F.sum(F.col(c) * F.col("a")) / F.sum("a")).alias(c) for c in "rgb"), F.greatest(F.lit(64.0), 255 * F.least(F.lit(1.0), cover / (64.0 * regions_per_pixel))).alias("a"))
    return sums.where("r is not null")


def tier(cell: Column) -> Column:
    """Which stored size a region drawn at so many pixels is taken from."""
    return F.when(cell <= MIP_PIXELS, "mip").when(cell <= THUMB_PIXELS, "thumb").otherwise("full")


def coalesce_tiles(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every tile of either side; where both have one, the first side's, whole."""
    a, b = (s.select(*keys, F.struct(*values).alias(n)) for s, n in ((first, "__a"), (second, "__b")))
    return a.join(b, keys, "full_outer").withColumn("__t", F.coalesce("__a", "__b")).select(*keys, "__t.*", F.col("__a").isNull().alias("from_second"))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows written several times, the last: one aggregate, without a sort."""
    values = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values, order), order).alias("__v")).select(*keys, "__v.*")


def compose(pixels: DataFrame, zoom: int, cell: int, key: str = "layer") -> DataFrame:
    """Pixels (key, rx, rz, px, pz, r, g, b, a) of regions drawn at cell pixels, at their places in tiles 2^-zoom regions wide.

    A tile is the pixels that share its key, x and y: a projection, so tiles are grouped only by who writes them.
    """
    span = 1 << -zoom
    tile = lambda c: F.floor(F.col(c) / span).cast("bigint")
    at = lambda c, p: (F.pmod(F.col(c), F.lit(span)) * cell + F.col(p)).cast("bigint")
    return pixels.select(key, tile("rx").alias("x"), tile("rz").alias("y"), at("rx", "px").alias("tx"), at("rz", "pz").alias("tz"), *"rgba")


def thumbnails(stored: DataFrame, index: DataFrame, x0: int, z0: int, x1: int, z1: int) -> DataFrame:
    """Stored thumbnails (layer, roof_obsidian, roof_snow, rx, rz, mtime_ms, ...) of the closed box that are of their region's present time."""
    box = stored.where(F.col("rx").between(x0, x1) & F.col("rz").between(z0, z1))
    return box.join(index.select("layer", "rx", "rz", "mtime_ms"), ["layer", "rx", "rz", "mtime_ms"], "left_semi")


def intern(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """A palette for each group: distinct values numbered from 0 by first appearance."""
    first = rows.groupBy(group, value).agg(F.min(order).alias("first"))
    return first.select(group, value, (F.row_number().over(Window.partitionBy(group).orderBy("first", value)) - 1).cast("bigint").alias("idx"))


def slopes(heights: DataFrame, key: str = "region") -> DataFrame:
    """Height steps from the pixel to the north (vs) and north-west (ds), within a signed byte; null if either is missing."""
    north = Window.partitionBy(key, "px").orderBy("pz").rangeBetween(-1, -1)
    diagonal = Window.partitionBy(key, F.col("px") - F.col("pz")).orderBy("pz").rangeBetween(-1, -1)
    byte = lambda d: F.greatest(F.lit(-128), F.least(F.lit(127), d)).cast("int")
    out = heights.withColumns({"n": F.max("h").over(north), "nw": F.max("h").over(diagonal)})
    step = lambda c: F.when(F.col(c).isNotNull() & F.col("h").isNotNull(), byte(F.col("h") - F.col(c)))
    return out.withColumns({"vs": step("n"), "ds": step("nw")}).drop("n", "nw")


def adopted_slopes(steps: DataFrame, key: str = "region") -> DataFrame:
    """Unknown slopes take the next known one to the south-east, 0 where there is none."""
    ahead = Window.partitionBy(key, F.col("px") - F.col("pz")).orderBy("pz").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return steps.withColumns({c: F.coalesce(F.first(c, ignorenulls=True).over(ahead), F.lit(0)) for c in ("vs", "ds")})


def tint_mean(pixels: DataFrame, value: str, key: str = "region") -> DataFrame:
    """Whole-number mean of a value over a pixel and its four neighbours, as far as they exist.

    Each pixel is sent to the five places that it counts for, so one aggregate by place replaces five joins.
    """
    offsets = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(z).alias("z")) for x, z in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))
    spread = pixels.select(key, "px", "pz", value, F.explode(offsets).alias("o"))
    spread = spread.select(key, (F.col("px") + F.col("o.x")).alias("px"), (F.col("pz") + F.col("o.z")).alias("pz"), value, ((F.col("o.x") == 0) & (F.col("o.z") == 0)).alias("own"))
    return spread.groupBy(key, "px", "pz").agg(F.expr(f"sum({value}) div count(*)").alias("mean"), F.max("own").alias("own")).where("own").drop("own")


def tinted(block: Column, tint: Column) -> Column:
    """A grey texture's channel under a tint."""
    return F.floor(block * tint / 255).cast("bigint")


#: Stored sizes of a region's picture, smallest first, and the side of a whole one.
TIERS, SIZES = ("mip", "thumb", "full"), {"mip": MIP_PIXELS, "thumb": THUMB_PIXELS, "full": 512}


def tile_span(index: DataFrame, x: int, y: int, zoom: int) -> DataFrame:
    """Regions of the tile (x, y) at zoom 0 or below, which is 2^-zoom regions wide."""
    span = 1 << -zoom
    return index.where(F.col("rx").between(x * span, x * span + span - 1) & F.col("rz").between(y * span, y * span + span - 1))


def sources(index: DataFrame, stored: DataFrame, cell: int, sizes: dict[str, int] = SIZES) -> DataFrame:
    """layer, rx, rz, mtime_ms, tier: from which stored size each region of index is drawn at cell pixels.

    stored (layer, rx, rz, mtime_ms, tier) says which sizes are there; one counts if it is of the region's present time.
    Taken is the smallest that has cell pixels at least (0: the smallest of all), so that a size that isn't there, or is of
    another time, is replaced by the next larger one, for that region alone. Regions of which nothing fits are left out.
    """
    fits = [t for t in TIERS if sizes[t] >= cell]
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    best = stored.where(F.col("tier").isin(fits)).groupBy("layer", "rx", "rz", "mtime_ms").agg(F.min_by("tier", rank).alias("tier"))
    return index.select("layer", "rx", "rz", "mtime_ms").join(best, ["layer", "rx", "rz", "mtime_ms"])


def shrunk(pixels: DataFrame, factor: int, keys: list[str]) -> DataFrame:
    """box_downscale by regions of several key columns; a factor of 1 leaves pixels as they are."""
    if factor == 1:
        return pixels.select(*keys, "px", "pz", *"rgba")
    whole = pixels.withColumn("region", F.struct(*keys))
    return box_downscale(whole, factor).select("region.*", "px", "pz", *"rgba")


def tile_from_tiers(index: DataFrame, pictures: dict[str, DataFrame], zoom: int, sizes: dict[str, int] = SIZES, tile: int = 512) -> DataFrame:
    """layer, x, y, tx, tz, r, g, b, a: all tiles 2^-zoom regions wide, each region from the best size stored of it.

    pictures: by tier, pixels (layer, rx, rz, mtime_ms, px, pz, r, g, b, a) of what is stored. Each table is joined once,
    with the regions that are drawn from it, so a region is read at one size only; then it is box-filtered to its cell and
    put in its place. Regions narrower than a pixel share it (see sub_pixel): colour by alpha, alpha by covered area.
    """
    keys = ["layer", "rx", "rz"]
    cell = tile >> -zoom
    here = None
    for name, pixels in pictures.items():
        own = pixels.select(*keys, "mtime_ms", F.lit(name).alias("tier")).distinct()
        here = own if here is None else here.union(own)
    chosen = sources(index, here, cell, sizes)
    parts = []
    for name, pixels in pictures.items():
        if sizes[name] >= cell:
            own = pixels.join(chosen.where(F.col("tier") == name).select(*keys, "mtime_ms"), [*keys, "mtime_ms"], "left_semi")
            parts.append(shrunk(own, sizes[name] // max(cell, 1), keys) if cell else own.select(*keys, *"rgba", F.lit(sizes[name]).alias("side")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if cell:
        return compose(out, zoom, cell)
    return _dots(out, zoom, tile)


def _dots(pixels: DataFrame, zoom: int, tile: int) -> DataFrame:
    """Pixels of regions narrower than a pixel, gathered in whole numbers: a region weighs by its mean alpha."""
    span, shared = 1 << -zoom, ((1 << -zoom) // tile) ** 2
    at = lambda c: F.floor(F.pmod(F.col(c), F.lit(span)) * tile / span).cast("bigint")
    own = pixels.groupBy("layer", "rx", "rz", "side").agg(*(F.sum(F.col(c) * F.col("a")).alias(c) for c in "rgb"), F.sum("a").alias("a"))
    area = F.expr("side * side")
    weigh = own.select("layer", *(F.floor(F.col(c) / span).cast("bigint").alias(o) for c, o in (("rx", "x"), ("rz", "y"))), at("rx").alias("tx"), at("rz").alias("tz"), *((F.col(c) / area).alias(c) for c in "rgba"))
    sums = weigh.groupBy("layer", "x", "y", "tx", "tz").agg(*(F.sum(c).alias(c) for c in "rgba")).where("a > 0")
    cover = F.least(F.lit(255.0), F.col("a") / shared)
    return sums.select("layer", "x", "y", "tx", "tz", *(F.floor(F.least(F.col(c) / F.col("a"), F.lit(255.0)) + 1e-9).cast("bigint").alias(c) for c in "rgb"), F.floor(F.greatest(cover, F.lit(64.0)) + 1e-9).cast("bigint").alias("a"))
