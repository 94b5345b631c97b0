"""Merging two archives: which worlds and layers belong together, what is copied, and how settings files join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilelake.functions.naming import base_domain, dimension_of_folder
from tilelake.operators.highlights import palette_field


def pair_worlds(a: DataFrame, b: DataFrame, aliases: DataFrame | None = None, auto: bool = False) -> DataFrame:
    """world_a, world_b, how, taken_by: exact names first, then aliases (either way round), then names of one server.

    A world of a claims the first world of b, by name, that a pass offers; the first claimant gets it, and each world has one
    partner at most. A claim on a world that has a partner is blocked (taken_by: that partner) and such a world may still
    claim in the next pass. Names of one server are only suggested unless auto. As a claim is the first of all that b offers,
    taken or not, each pass is an aggregate and a join, in whatever order the rows come.
    """
    a, b = a.select(F.col("world").alias("world_a")).distinct(), b.select(F.col("world").alias("world_b")).distinct()
    pairs = a.join(b, a["world_a"] == b["world_b"]).select("world_a", "world_b", F.lit("exact").alias("how"))
    blocked = None
    if aliases is not None:
        both = aliases.select(F.col("x").alias("world_a"), F.col("y").alias("world_b")).union(aliases.select("y", "x"))
        pairs, blocked = _pass(pairs, blocked, both.join(a, "world_a", "left_semi").join(b, "world_b", "left_semi"), "alias")
    left, right = (s.withColumn("server", base_domain(F.col(n))) for s, n in ((a, "world_a"), (b, "world_b")))
    firsts = right.groupBy("server").agg(F.min("world_b").alias("world_b"))
    offered = left.join(firsts, "server").where("world_a <> world_b")
    if auto:
        pairs, blocked = _pass(pairs, blocked, offered, "domain")
        suggested = None
    else:
        free, taken = _claims(pairs, offered)
        blocked = taken if blocked is None else blocked.union(taken)
        suggested = free.select("world_a", "world_b", F.lit("suggested"), F.lit(None).cast("string"))
    out = pairs.withColumn("taken_by", F.lit(None).cast("string")).union(blocked)
    return out if suggested is None else out.union(suggested)


def _claims(pairs: DataFrame, offered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of worlds without a partner: on free worlds, and blocked ones."""
    claim = offered.join(pairs.select("world_a"), "world_a", "left_anti").groupBy("world_a").agg(F.min("world_b").alias("world_b"))
    taken = claim.join(pairs.select("world_b", F.col("world_a").alias("taken_by")), "world_b").select("world_a", "world_b", F.lit("blocked").alias("how"), "taken_by")
    return claim.join(pairs.select("world_b"), "world_b", "left_anti").select("world_a", "world_b"), taken


def _pass(pairs: DataFrame, blocked: DataFrame | None, offered: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
    free, taken = _claims(pairs, offered)
    won = free.groupBy("world_b").agg(F.min("world_a").alias("world_a")).select("world_a", "world_b", F.lit(how).alias("how"))
    late = free.join(won.select("world_b", F.col("world_a").alias("taken_by")), "world_b").where("world_a <> taken_by").select("world_a", "world_b", F.lit("blocked").alias("how"), "taken_by")
    out = taken.union(late)
    return pairs.union(won), out if blocked is None else blocked.union(out)


def plan(a: DataFrame, b: DataFrame, prefer: str = "newer") -> DataFrame:
    """What a merge does with each region (layer, rx, rz) of indexes a and b: the dry run.

    action: copy_a, copy_b or merge; primary: the side whose tiles win (newer, of equal times a; or the preferred side);
    mtime_ms: that of the result; a_ms, b_ms: those of the sides.
    """
    keys = ["layer", "rx", "rz"]
    x, y = (s.select(*keys, F.col("mtime_ms").alias(f"{n}_ms"), F.col("size").alias(f"{n}_size")) for s, n in ((a, "a"), (b, "b")))
    both = x.join(y, keys, "full_outer")
    action = F.when(F.col("b_ms").isNull(), "copy_a").when(F.col("a_ms").isNull(), "copy_b").otherwise("merge")
    newer = F.when(F.col("action") == "copy_b", "b").when((F.col("action") == "merge") & (F.col("b_ms") > F.col("a_ms")), "b").otherwise("a")
    side = newer if prefer == "newer" else F.when(F.col("action") == "merge", prefer).otherwise(newer)
    out = both.withColumn("action", action)
    return out.select(*keys, "action", side.alias("primary"), F.greatest("a_ms", "b_ms").alias("mtime_ms"), "a_ms", "b_ms", (F.coalesce("a_size", F.lit(0)) + F.coalesce("b_size", F.lit(0))).alias("bytes"))


def layer_units(layers: DataFrame) -> DataFrame:
    """Layers (side, world, dim, mw, cave) of paired worlds, matched by what the folder means: world, key, mw, cave, a, b, folder.

    key is the dimension's resource key, or the folder's own name where it is none; a and b are the sides' folders, folder
    the result's: b's, else a's. Where one side has two folders of one meaning, a or b is null and mixed says which side: these
    two must be made one before a merge.
    """
    key = F.coalesce(dimension_of_folder(F.col("dim")), "dim").alias("key")
    own = lambda side: F.when(F.lower("side") == side, F.col("dim"))
    out = layers.groupBy("world", key, "mw", "cave").agg(*(f(own(s)).alias(f"{s}{n}") for s in "ab" for n, f in ((0, F.min), (1, F.max))))
    two = lambda s: F.col(f"{s}0") < F.col(f"{s}1")
    mixed = F.when(two("a") & two("b"), "ab").when(two("a"), "a").when(two("b"), "b")
    one = lambda s: F.when(F.col(f"{s}0") == F.col(f"{s}1"), F.col(f"{s}0"))
    return out.select("world", "key", "mw", "cave", one("a").alias("a"), one("b").alias("b"), F.coalesce("b1", "a1").alias("folder"), mixed.alias("mixed"))


def plan_report(planned: DataFrame) -> DataFrame:
    """For each layer: regions only in a, only in b and in both, regions out and bytes read."""
    return planned.groupBy("layer").agg(
        F.count_if(F.col("action") == "copy_a").alias("only_a"), F.count_if(F.col("action") == "copy_b").alias("only_b"), F.count_if(F.col("action") == "merge").alias("conflicts"),
        F.count("*").alias("regions_out"), F.sum("bytes").alias("bytes"),
    )


def mixed_units(layers: DataFrame) -> DataFrame:
    """Layers (side, world, dim, mw, layer) whose dimension one side names both ways (null and DIM0): these cannot be paired."""
    return layers.where(F.col("dim").isin("null", "DIM0")).groupBy("side", "world", "mw", "layer").agg((F.min("dim") < F.max("dim")).alias("mixed")).where("mixed").drop("mixed")


def merge_meaning(names: DataFrame, group: str) -> DataFrame:
    """For each group of file names (group, name), destination included: height if any of them holds heights, else timestamp."""
    height = F.max(palette_field(F.col("name"), 3) == "height")
    return names.groupBy(group).agg(F.when(height, "height").otherwise("timestamp").alias("meaning"))


def merge_tiles(planned: DataFrame, a: DataFrame, b: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merge itself: tiles (layer, rx, rz, tx, tz, ...) of the result, and regions with mtime_ms, tiles and note.

    planned: of plan. Where both sides have a tile the primary's counts, whole. bad (layer, rx, rz, side): files that cannot be
    read; the other side is then kept as it is, with its own time, and the note says so; of a region that neither side can
    be read of nothing is left. A region copied from one side alone is as it was, readable or not. Tiles are grouped once, by
    their own key, and meet the plan by region.
    """
    keys = ["layer", "rx", "rz"]
    known = _readable(planned, bad)
    values = [c for c in a.columns if c not in (*keys, "tx", "tz")]
    both = a.select(*keys, "tx", "tz", F.struct(*values).alias("v"), F.lit("a").alias("from_side")).union(b.select(*keys, "tx", "tz", F.struct(*values).alias("v"), F.lit("b").alias("from_side")))
    placed = both.join(known.select(*keys, "primary", "bad_a", "bad_b"), keys).where("not (from_side = 'a' and bad_a or from_side = 'b' and bad_b)")
    best = placed.groupBy(*keys, "tx", "tz").agg(F.max_by(F.struct("v", "from_side"), (F.col("from_side") == F.col("primary")).cast("int")).alias("t"))
    tiles = best.select(*keys, "tx", "tz", "t.v.*", "t.from_side")
    return tiles, merged_regions(planned, tiles, bad)


def _readable(planned: DataFrame, bad: DataFrame) -> DataFrame:
    """Planned regions with bad_a and bad_b: which side of a merge cannot be read."""
    keys = ["layer", "rx", "rz"]
    flags = bad.groupBy(*keys).agg(F.max(F.lower("side") == "a").alias("bad_a"), F.max(F.lower("side") == "b").alias("bad_b"))
    return planned.join(flags, keys, "left").withColumns({c: F.coalesce(c, F.lit(False)) & (F.col("action") == "merge") for c in ("bad_a", "bad_b")})


def merged_regions(planned: DataFrame, tiles: DataFrame, bad: DataFrame) -> DataFrame:
    """Regions of the result, counted in its tiles (of merge_tiles, or as these were written): action, mtime_ms, tiles, from_b, note."""
    keys = ["layer", "rx", "rz"]
    note = F.when(F.col("bad_a") & F.col("bad_b"), "both unreadable").when(F.col("bad_a"), "a unreadable, copied b").when(F.col("bad_b"), "b unreadable, copied a")
    time = F.when(F.col("bad_a") & F.col("bad_b"), None).when(F.col("bad_a"), F.col("b_ms")).when(F.col("bad_b"), F.col("a_ms")).otherwise(F.col("mtime_ms"))
    counted = tiles.groupBy(*keys).agg(F.count("*").alias("tiles"), F.count_if(F.col("from_side") == "b").alias("from_b"))
    known = _readable(planned, bad).withColumn("note", note).join(counted, keys, "left")
    return known.select(*keys, "action", time.alias("mtime_ms"), F.coalesce("tiles", F.lit(0)).alias("tiles"), F.coalesce("from_b", F.lit(0)).alias("from_b"), "note")


#: A settings line that names a multiworld: the id is what stands before the second colon; without one there is no id, but
#: the line still says where named lines stand.
NAMED = "MWName:"


def named_id(line: Column) -> Column:
    rest = F.substring(line, len(NAMED) + 1, F.length(line))
    return F.when(line.startswith(NAMED) & F.contains(rest, F.lit(":")), F.substring_index(rest, ":", 1))


def newer_is_b() -> Column:
    """Whether, of a file that both sides have (a_ms, b_ms), b's is the newer; equal ones are a's, and no time is the oldest."""
    return F.col("b_ms").isNotNull() & (F.col("a_ms").isNull() | (F.col("b_ms") > F.col("a_ms")))


def merge_settings(lines: DataFrame, key: str, id_of: Column | None = None) -> DataFrame:
    """Lines (key, side, mtime_ms, ord, line) of two sides' settings files as one file: key, ord, line.

    The newer file (of equal ones a) keeps all its lines; the older one adds the named lines whose id the newer hasn't,
    after the newer's last line that names one, with or without id, or at the top if it has none. Lines are read and
    shuffled once, by file, as both windows ask for; within their task they are sorted by id, and then as they are written.
    """
    of = {s: F.col("side") == s.upper() for s in "ab"}
    by_id, by_file = Window.partitionBy(key, "id"), Window.partitionBy(key)
    tagged = lines.where(F.col(key).isNotNull()).repartition(key).withColumn("id", named_id(F.col("line")) if id_of is None else id_of)
    tagged = tagged.withColumns({f"id_{s}": F.max(own).over(by_id) for s, own in of.items()})
    named = F.when(F.col("line").startswith(NAMED), F.col("ord"))
    facts = {f"{s}_ms": F.max(F.when(own, F.col("mtime_ms"))).over(by_file) for s, own in of.items()}
    facts |= {f"last_{s}": F.max(F.when(own, named)).over(by_file) for s, own in of.items()} | {f"in_{s}": F.max(own).over(by_file) for s, own in of.items()}
    known = tagged.withColumns(facts).withColumn("by_b", F.col("in_b") & (~F.col("in_a") | newer_is_b()))
    own = of["b"] == F.col("by_b")
    of_newer = lambda n: F.when(F.col("by_b"), F.col(f"{n}_b")).otherwise(F.col(f"{n}_a"))
    kept = known.where(own | (F.col("id").isNotNull() & ~of_newer("id")))
    placed = kept.select(key, F.when(own, F.col("ord")).otherwise(F.coalesce(of_newer("last"), F.lit(-1))).alias("after"), (~own).cast("int").alias("late"), "ord", "line")
    return placed.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("after", "late", "ord")) - 1).cast("bigint").alias("ord"), "line")
