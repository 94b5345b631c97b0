"""Worlds, dimensions and layers of an archive, drawings, places, colours of blocks, and small geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilelake.functions import naming as N

#: What shapes derive their colour from, and blocks that stand for a kind.
SHAPES = ("_stairs", "_slab", "_wall", "_fence_gate", "_fence", "_button", "_pressure_plate", "_trapdoor", "_door")
KINDS = (("_leaves$", "minecraft:oak_leaves"), ("(?:_log|_wood|_planks)$", "minecraft:oak_planks"), ("(?:_ore|stone)$", "minecraft:stone"), ("water", "minecraft:water"))
UNKNOWN_COLOUR = 0x7F7F7FFF
#: Blocks that had another name before, and the biome that stands for unknown ones.
RENAMED, COMMON_BIOME = {"minecraft:grass_path": "minecraft:dirt_path"}, "minecraft:plains"
#: Blocks that shine by themselves, blocks that are air, and how opaque a block on top is without a colour.
SHINING = (
    "lava", "glowstone", "shroomlight", "sea_lantern", "jack_o_lantern", "lantern", "soul_lantern", "campfire", "soul_campfire", "fire", "soul_fire", "torch", "wall_torch", "soul_torch", "soul_wall_torch",
    "nether_portal", "end_rod", "beacon", "conduit", "crying_obsidian", "ochre_froglight", "verdant_froglight", "pearlescent_froglight", "lava_cauldron", "light", "end_gateway",
)
AIR = ("air", "cave_air", "void_air")
LIQUID_ALPHA, ICE_ALPHA, OTHER_ALPHA = 191, 216, 127
DRAWING_KEYS = {"highlights": ["dim", "x", "z"], "lines": ["dim", "x1", "z1", "x2", "z2"], "texts": ["dim", "x", "z"], "ellipses": ["dim", "centerX", "centerZ", "radiusX", "radiusZ"]}
BORDER = {"minecraft:overworld": 30_000_000, "minecraft:the_nether": 3_750_000}


def layers(paths: DataFrame, root: str = "") -> DataFrame:
    """world, folder, dim, mw, layer, files, bytes of region files (path, size) below root/world/dimension/multiworld[/caves/n].

    Transient files, caches and folders that are no dimension or multiworld are left out; layer is surface or a number.
    """
    part = F.split(F.substring("path", len(root) + 1, 1 << 20), "/")
    at = lambda k: F.get(part, F.lit(k))
    named = paths.withColumns({"world": at(0), "folder": at(1), "mw": at(2), "name": F.element_at(part, -1), "depth": F.size(part), "sub": at(3), "n": at(4)})
    rx, _, _ = N.region_coordinates(F.col("name"))
    cave = (F.col("depth") == 6) & (F.col("sub") == "caves") & F.col("n").rlike("^-?[0-9]+$")
    kept = named.where(rx.isNotNull() & ~N.is_transient(F.col("name")) & N.is_multiworld(F.col("mw")) & ((F.col("depth") == 4) | cave))
    kept = kept.withColumns({"dim": N.dimension_of_folder(F.col("folder")), "layer": F.when(F.col("depth") == 6, F.col("n")).otherwise("surface")}).where("dim is not null")
    return kept.groupBy("world", "folder", "dim", "mw", "layer").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def select_worlds(worlds: DataFrame, wanted: str) -> DataFrame:
    """Worlds of exactly this name, else those whose name contains it."""
    exact = worlds.where(F.col("world") == wanted)
    return worlds.where((F.col("world") == wanted) | (F.contains("world", F.lit(wanted)) & ~exact.exists()))


def merge_drawings(dest: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """All of the destination's drawings and the source's others, by key; columns that both have."""
    common = [c for c in dest.columns if c in source.columns]
    both = dest.select(*common, F.lit(0).alias("__s")).unionByName(source.select(*common, F.lit(1).alias("__s")))
    others = F.struct(*(c for c in common if c not in keys))
    return both.groupBy(*keys).agg(F.min_by(F.struct(others.alias("v"), "__s"), "__s").alias("r")).select(*keys, "r.v.*", (F.col("r.__s") == 1).alias("added"))


def places_in_view(places: DataFrame, dim: float, text: str, x0: float, z0: float, x1: float, z1: float) -> DataFrame:
    """Places (name, tags, dimension, x, z) of a dimension whose name or tags contain text, with shown: in the closed box."""
    hit = F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("tags"), F.lit(text.lower()))
    return places.where((F.col("dimension") == dim) & hit).withColumn("shown", F.col("x").between(x0, x1) & F.col("z").between(z0, z1))


def canonical_state(block: Column, properties: Column) -> Column:
    """block[k=v,...] of a map of properties, sorted by key; the block alone without any."""
    parts = F.array_join(F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.when(F.size(properties) > 0, F.concat(block, F.lit("["), parts, F.lit("]"))).otherwise(block)


def colours(blocks: DataFrame, table: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, rgba, missing for each block name.

    Candidates are tried in order: the name, its alias, its name of today, the material of a derived shape, a block of its
    kind (missing).
    All become rows (name, rank, candidate), met with the small colour table once; the best that is known wins.
    """
    short = F.regexp_replace("name", "^minecraft:", "")
    suffix = F.regexp_extract(short, f"({'|'.join(SHAPES)})$", 1)
    base = F.concat(F.lit("minecraft:"), F.expr("substring(regexp_replace(name, '^minecraft:', ''), 1, length(regexp_replace(name, '^minecraft:', '')) - length(suffix))"))
    kind = None
    for pattern, stand_in in KINDS:
        kind = F.when(short.rlike(pattern), stand_in) if kind is None else kind.when(short.rlike(pattern), stand_in)
    renamed = F.try_element_at(F.create_map(*(F.lit(v) for pair in RENAMED.items() for v in pair)), F.col("name"))
    shaped = lambda end: F.when(F.col("suffix") != "", F.concat(base, F.lit(end)))
    named = blocks.select("name").distinct().join(aliases.select(F.col("name"), F.col("target")), "name", "left").withColumn("suffix", suffix)
    tried = named.select("name", F.posexplode(F.array("name", "target", renamed, shaped(""), shaped("_planks"), shaped("_block"), kind)).alias("rank", "candidate"))
    found = tried.where("candidate is not null").join(table.select(F.col("name").alias("candidate"), "rgba"), "candidate")
    best = found.groupBy("name").agg(F.min_by(F.struct("rgba", "rank"), "rank").alias("b"))
    return blocks.select("name").distinct().join(best, "name", "left").select("name", F.coalesce("b.rgba", F.lit(UNKNOWN_COLOUR).cast("long")).alias("rgba"), F.coalesce(F.col("b.rank") == 6, F.lit(True)).alias("missing"))


def biome_colours(biomes: DataFrame, table: DataFrame) -> DataFrame:
    """name with its row of table (name and colours) for each biome, that of plains where it has none; known says which."""
    values = [c for c in table.columns if c != "name"]
    common = table.where(F.col("name") == COMMON_BIOME).select(*values).first()
    instead = F.struct(*(F.lit(None if common is None else common[c]).cast(table.schema[c].dataType).alias(c) for c in values))
    own = biomes.select("name").distinct().join(table.select("name", F.struct(*values).alias("own")), "name", "left")
    return own.select("name", F.coalesce("own", instead).alias("c"), F.col("own").isNotNull().alias("known")).select("name", "c.*", "known")


def block_kinds(blocks: DataFrame) -> DataFrame:
    """air, shining, alpha (of 255, as a block on top) and roof of blocks (name, alpha; 0 where no colour is known)."""
    named = lambda names: F.col("name").isin(*(f"minecraft:{n}" for n in names))
    liquid = F.contains("name", F.lit("water")) | F.contains("name", F.lit("lava"))
    alpha = F.when(F.col("alpha") != 0, F.col("alpha")).when(liquid, LIQUID_ALPHA).when(F.contains("name", F.lit("ice")), ICE_ALPHA).otherwise(OTHER_ALPHA)
    roof = F.when(named(("obsidian", "crying_obsidian")), "obsidian").when(named(("snow",)), "snow").otherwise("none")
    return blocks.withColumns({"air": named(AIR), "shining": named(SHINING), "alpha": alpha, "roof": roof})


def drawings_in_window(drawings: DataFrame, dim: str, x0: int, x1: int, z0: int, z1: int) -> DataFrame:
    """Drawn highlights (dim, x, z, color) of one dimension in a half-open window: comparisons alone, so they reach the scan."""
    return drawings.where((F.col("dim") == dim) & (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("z") >= z0) & (F.col("z") < z1))


def merge_drawing_tables(dest: dict[str, DataFrame], source: dict[str, DataFrame], keys: dict[str, list[str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables of either side after source went into dest, and a row of counts for each of source's.

    keys: the key columns that each table declares. Of rows with equal keys the destination's counts; a table that declares
    none takes all rows and has no overlap. Columns that only the source has are left out and those that only the
    destination has are null in rows from the source; a table that the destination lacks is taken as it is.
    """
    merged, counts = dict(dest), None
    for name, new in source.items():
        own, key = dest.get(name), keys.get(name, [])
        if own is None:
            merged[name] = new.dropDuplicates(key) if key else new
            rows = new.select(F.lit(0).alias("d"), F.lit(1).alias("s"))
            overlap = F.lit(0)
        else:
            common = [c for c in new.columns if c in own.columns]
            added = new.select(*common)
            if key:
                added = added.join(own.select(*key).distinct(), key, "left_anti").dropDuplicates(key)
            merged[name] = own.unionByName(added, allowMissingColumns=True)
            rows = own.select(*(key or [F.lit(1).alias("k")]), F.lit(1).alias("d"), F.lit(0).alias("s")).unionByName(new.select(*(key or [F.lit(1).alias("k")]), F.lit(0).alias("d"), F.lit(1).alias("s")))
            if key:  # a row for each key: how many of either side
                rows = rows.groupBy(*key).agg(F.sum("d").alias("d"), F.sum("s").alias("s"))
            overlap = F.sum(F.when(F.col("d") > 0, F.col("s")).otherwise(0)) if key else F.lit(0)
        one = rows.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("d"), F.lit(0)).alias("dest_before"), F.coalesce(overlap, F.lit(0)).alias("overlap"))
        one = one.select(F.lit(name).alias("name"), *(F.col(c).cast("bigint").alias(c) for c in one.columns)).withColumn("dest_after", F.col("dest_before") + F.col("source_rows") - F.col("overlap"))
        counts = one if counts is None else counts.union(one)
    return merged, counts


def drawing_report(dest: DataFrame, source: DataFrame) -> DataFrame:
    """What a merge of drawings (dim, family, key) does to each table: rows of the source, of the destination before and after, and
    rows of the source whose key the destination has. key: a family's key columns as one text or struct."""
    both = dest.select("dim", "family", "key", F.lit(1).alias("d"), F.lit(0).alias("s")).union(source.select("dim", "family", "key", F.lit(0), F.lit(1)))
    keyed = both.groupBy("dim", "family", "key").agg(F.sum("d").alias("d"), F.sum("s").alias("s"))
    out = keyed.groupBy("dim", "family").agg(F.sum("s").alias("source_rows"), F.sum("d").alias("dest_before"), F.sum(F.when(F.col("d") > 0, F.col("s")).otherwise(0)).alias("overlap"))
    return out.where("source_rows > 0").withColumn("dest_after", F.col("dest_before") + F.col("source_rows") - F.col("overlap"))


def drawing_counts(drawings: DataFrame) -> DataFrame:
    """Drawings of each dimension and family (dim, family), so that an empty overlay differs from one that isn't there."""
    return drawings.groupBy("dim", "family").agg(F.count("*").alias("n"))


def pyramid_levels(sets: DataFrame) -> DataFrame:
    """dataset, z, rows, cols, tiles of each level of tile pyramids (dataset, z_min, z_max, rows, cols at z_max)."""
    levels = sets.select("dataset", F.explode(F.sequence("z_min", "z_max")).alias("z"), "z_max", "rows", "cols")
    size = lambda c: F.ceil(F.col(c) / F.pow(F.lit(2.0), F.col("z_max") - F.col("z"))).cast("bigint").alias(c)
    return levels.select("dataset", "z", size("rows"), size("cols")).withColumn("tiles", F.col("rows") * F.col("cols"))


def diagonal_in_view(views: DataFrame, limit: int, sign: int = 1) -> DataFrame:
    """Ends of the line x = sign z within windows (x0, z0, x1, z1) and the world's border; none where they don't meet."""
    z_low, z_high = (F.col("z0"), F.col("z1")) if sign == 1 else (-F.col("z1"), -F.col("z0"))
    out = views.withColumns({"lo": F.greatest("x0", z_low, F.lit(-limit)), "hi": F.least("x1", z_high, F.lit(limit))})
    return out.where("lo <= hi")


def region_box(boxes: DataFrame, bounds: DataFrame) -> DataFrame:
    """Regions that boxes of blocks (x1, z1, x2, z2, corners in any order) touch, within each layer's bounds."""
    low = lambda a, b, edge: F.greatest(F.floor(F.least(a, b) / 512), F.col(edge)).cast("bigint")
    high = lambda a, b, edge: F.least(F.floor(F.greatest(a, b) / 512), F.col(edge)).cast("bigint")
    out = boxes.join(bounds, "layer")
    out = out.select("id", "layer", low("x1", "x2", "rx0").alias("rx0"), low("z1", "z2", "rz0").alias("rz0"), high("x1", "x2", "rx1").alias("rx1"), high("z1", "z2", "rz1").alias("rz1"))
    return out.where("rx0 <= rx1 and rz0 <= rz1")


def in_bitset(rows: DataFrame, bits: str = "bits") -> DataFrame:
    """Whether cell (ix, iy) of a side x side bitset, most significant bit first, is set."""
    k = F.col("iy") * F.col("side") + F.col("ix")
    byte = F.conv(F.hex(F.substring(bits, F.floor(k / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("__byte", byte).withColumn("set", F.expr("shiftright(__byte, cast(7 - (iy * side + ix) % 8 as int)) & 1") == 1).drop("__byte")


#: State numbers are 16-bit: a table of them has so many rows at most, so it may be broadcast. What isn't in it is air.
MOST_STATES, AIR_STATE = 1 << 16, "minecraft:air"


def state_table(names: DataFrame) -> DataFrame:
    """id and key of states (id, name): the name with its properties sorted, however they were written.

    Fails if there are more than fit, if two states share a key, or if none is air.
    """
    block = F.substring_index("name", "[", 1)
    inner = F.regexp_extract("name", r"^[^\[]*\[(.*?)\]?$", 1)
    pairs = F.transform(F.split(inner, ","), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p)).alias("value")))
    keyed = names.select("id", F.when(inner == "", block).otherwise(canonical_state(block, F.map_from_entries(pairs))).alias("key"))
    n, air, several = keyed.agg(F.count("*"), F.count_if(F.col("key") == AIR_STATE), F.count("*") - F.countDistinct("key")).first()
    if n > MOST_STATES or not air or several:
        raise ValueError(f"{n} states, {air} of them air, {several} keys that others have")
    return keyed


def state_ids(entries: DataFrame, states: DataFrame) -> DataFrame:
    """entries (block, properties) with key, id and known: the number of their state, air's where there is none."""
    air = states.where(F.col("key") == AIR_STATE).select(F.col("id").alias("air"))
    keyed = entries.withColumn("key", canonical_state(F.col("block"), F.col("properties")))
    out = keyed.join(F.broadcast(states), "key", "left")
    return out.withColumn("known", F.col("id").isNotNull()).withColumn("id", F.coalesce("id", F.lit(air.first()[0])))


def unknown_states(resolved: DataFrame, weight: str | None = None) -> DataFrame:
    """key and n: what state_ids took for air, how often."""
    n = F.count("*") if weight is None else F.sum(weight)
    return resolved.where("not known").groupBy("key").agg(n.cast("bigint").alias("n"))


def clipped(segments: DataFrame) -> DataFrame:
    """The parts of segments (ax, az, bx, bz) inside their windows (x0, z0, x1, z1), as the same columns; others go.

    Each side of the window cuts the range [t0, t1] of the segment's parameter that is inside; a segment along a side is
    inside if it isn't beyond it. A segment that only touches a window is a point of it.
    """
    dx, dz = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")
    low, high, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for step, room in ((-dx, F.col("ax") - F.col("x0")), (dx, F.col("x1") - F.col("ax")), (-dz, F.col("az") - F.col("z0")), (dz, F.col("z1") - F.col("az"))):
        t = room.cast("double") / F.when(step != 0, step)
        low = F.when(step < 0, F.greatest(low, t)).otherwise(low)
        high = F.when(step > 0, F.least(high, t)).otherwise(high)
        inside = inside & ((step != 0) | (room >= 0))
    out = segments.withColumns({"t0": low, "t1": high}).where(inside & (F.col("t0") <= F.col("t1")))
    at = lambda a, d, t, end, b: F.when(F.col(t) == end, F.col(b).cast("double")).otherwise(F.col(a) + F.col(t) * d)
    ends = {"ax": at("ax", dx, "t0", 0.0, "ax"), "az": at("az", dz, "t0", 0.0, "az"), "bx": at("ax", dx, "t1", 1.0, "bx"), "bz": at("az", dz, "t1", 1.0, "bz")}
    kept = [c for c in segments.columns if c not in ends]
    return out.select(*kept, *(v.alias(k) for k, v in ends.items()))


def guides(views: DataFrame) -> DataFrame:
    """Guide lines of windows (x0, z0, x1, z1, limit): kind (border, axis, diagonal) and the ends of what shows of each line."""
    n, p, o = -F.col("limit"), F.col("limit"), F.lit(0).cast("bigint")
    lines = [("border", n, n, p, n), ("border", n, p, p, p), ("border", n, n, n, p), ("border", p, n, p, p), ("axis", n, o, p, o), ("axis", o, n, o, p), ("diagonal", n, n, p, p), ("diagonal", n, p, p, n)]
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).alias("line"), *(c.alias(name) for name, c in zip(("ax", "az", "bx", "bz"), cs))) for i, (k, *cs) in enumerate(lines)))
    return clipped(views.withColumn("s", F.explode(each)).select(*views.columns, "s.*"))
