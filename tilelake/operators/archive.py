"""Archives as listings: where worlds are, what each dimension is, which layer is meant, what is copied, what a change touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilelake.functions import naming as N
from tilelake.operators.index import issues

#: Folders that hold worlds, in the order in which they are tried, and what marks a world's own folder.
LAYOUTS = ("xaero/world-map/", "config/xaero/world-map/", "world-map/", "")
WORLD_FILE, DATABASE, DATABASE_BACKUPS, NOT_A_WORLD = "server_config.txt", r"^XaeroPlus.*\.db$", "XaeroPlus-db-backups", "temp_to_add"
DEFAULT_MULTIWORLD = "mw$default"


def _part(parts: Column, k: int) -> Column:
    return F.get(parts, F.lit(k))


def _is_world(parts: Column, at: int) -> Column:
    """Whether a path's parts show that part at is a world's folder."""
    inner, depth = _part(parts, at + 1), F.size(parts) - at
    folder = (depth > 2) & N.dimension_of_folder(inner).isNotNull()
    return F.coalesce(folder | ((depth == 2) & ((inner == WORLD_FILE) | inner.rlike(DATABASE))), F.lit(False))


def world_files(paths: DataFrame, layouts: tuple[str, ...] = LAYOUTS) -> DataFrame:
    """root, layout, world, path, rest of files (root, path) that belong to a world's map.

    Of the layouts the first one that shows a world counts for a root: a folder of worlds, or else the folder itself as a
    world. A file is looked at by itself and roots meet only in an aggregate, so no task holds a root's listing.
    """
    forms = [(2 * k + single, prefix, single) for k, prefix in enumerate(layouts) for single in (0, 1)]
    tried = F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(p).alias("layout"), F.lit(bool(s)).alias("single")) for r, p, s in forms))
    below = paths.select("root", "path", F.explode(F.filter(tried, lambda t: F.col("path").startswith(t["layout"]))).alias("t")).select("root", "path", "t.*")
    inner = F.substring("path", F.length("layout") + 1, F.length("path"))
    outer = F.when(F.col("layout") == "", F.element_at(F.split("root", "/"), -1)).otherwise(F.element_at(F.split("layout", "/"), -2))
    below = below.withColumn("rest", F.when(F.col("single"), F.concat(outer, F.lit("/"), inner)).otherwise(inner)).withColumn("parts", F.split("rest", "/"))
    shown = below.where(_is_world(F.col("parts"), 0))
    worlds = shown.select("root", "rank", _part(F.col("parts"), 0).alias("world")).distinct()
    best = worlds.groupBy("root").agg(F.min("rank").alias("rank"))
    found = below.withColumn("world", _part(F.col("parts"), 0)).join(worlds.join(best, ["root", "rank"]), ["root", "rank", "world"])
    return found.select("root", "layout", "world", "path", F.substring("rest", F.length("world") + 2, F.length("rest")).alias("rest"))


def minimap_worlds(paths: DataFrame, mapped: DataFrame) -> DataFrame:
    """world and its waypoint files, of worlds that only the minimap's listing (path) knows; mapped: world.

    Waypoint files lie in a dimension's folder of a world; the game's own snapshots hold deleted ones and are left out.
    """
    parts = F.split("path", "/")
    own = lambda c: ~N.is_minimap_backup(c) & (c != NOT_A_WORLD)
    named = N.waypoint_file(_part(parts, 2))[1].isNotNull()
    found = paths.where((F.size(parts) == 3) & own(_part(parts, 0)) & own(_part(parts, 1)) & named).select(_part(parts, 0).alias("world"))
    return found.join(mapped.select("world").distinct(), "world", "left_anti").groupBy("world").agg(F.count("*").alias("files"))


def dimension_labels(dims: DataFrame, types: DataFrame) -> DataFrame:
    """Dimension folders (world, folder, config_type) with dim, type, label and place in a list.

    The type is the folder's own setting, or the minimap's (world, ord, level, type), if that is one of the game's three;
    else the dimension itself. The label is that of the dimension, of its type, or the folder.
    """
    named = types.groupBy("world", F.col("level").alias("dim")).agg(F.min_by("type", "ord").alias("named"))
    out = dims.withColumn("dim", N.dimension_of_folder(F.col("folder"))).join(named, ["world", "dim"], "left")
    kind = F.coalesce("config_type", "named")
    out = out.withColumn("type", F.when(kind.isin(*N.DISPLAY), kind).otherwise(F.col("dim")))
    place = F.when(F.col("folder").isin("null", "DIM0"), 0).when(F.col("folder") == "DIM-1", 1).when(F.col("folder") == "DIM1", 2).otherwise(3)
    return out.select("world", "folder", "dim", "type", F.coalesce(N.display_name(F.col("dim")), N.display_name(F.col("type")), "folder").alias("label"), place.alias("place"))


def default_layers(layers: DataFrame) -> DataFrame:
    """world, folder, mw, missing: what a world's map is where nobody says which.

    The overworld's folder, else the only one; of it the default multiworld, else the only one. missing says which choice
    (dim or mw) is left open. Two partial aggregates: multiworlds of a folder, folders of a world.
    """
    only = F.when(F.min("mw") == F.max("mw"), F.min("mw"))
    folders = layers.groupBy("world", "folder").agg(F.coalesce(F.max(F.when(F.col("mw") == DEFAULT_MULTIWORLD, DEFAULT_MULTIWORLD)), only).alias("mw"))
    rank = F.when(F.col("folder") == "null", 0).when(F.col("folder") == "DIM0", 1).otherwise(2)
    best = folders.groupBy("world").agg(F.min_by(F.struct("folder", "mw"), F.struct(rank.alias("r"), "folder")).alias("b"), F.min(rank).alias("rank"), F.count("*").alias("n"))
    sure = (F.col("rank") < 2) | (F.col("n") == 1)
    out = best.select("world", F.when(sure, F.col("b.folder")).alias("folder"), F.when(sure, F.col("b.mw")).alias("mw"))
    return out.withColumn("missing", F.when(F.col("folder").isNull(), "dim").when(F.col("mw").isNull(), "mw"))


def ancestors(path: Column) -> Column:
    """Folders above a path, the outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def classify(events: DataFrame, worlds: DataFrame, maps: DataFrame, databases: DataFrame) -> DataFrame:
    """What changed paths (path) touch: ord, world, kind, and folder, mw, layer, rx, rz of a region or db of a database.

    worlds: ord, world, root; of several roots above a path the first world counts, even where the path is nothing in it.
    maps: ord, folder, mw; databases: ord, db. Each path meets its own ancestors by equality, so no range join is needed.
    """
    tried = events.select("path").distinct().withColumn("root", F.explode(ancestors(F.col("path")))).join(worlds.select("ord", "world", "root"), "root")
    first = tried.groupBy("path").agg(F.min_by(F.struct("ord", "world", "root"), "ord").alias("w")).select("path", "w.*")
    parts = F.split(F.substring("path", F.length("root") + 2, F.length("path")), "/")
    rx, rz, _ = N.region_coordinates(F.element_at("p", -1))
    cave = (F.size("p") == 5) & (_part(F.col("p"), 2) == "caves")
    layer = F.when(F.size("p") == 3, "surface").when(cave, _part(F.col("p"), 3).try_cast("int").cast("string"))
    split = first.withColumn("p", parts).withColumns({"folder": _part(F.col("p"), 0), "mw": _part(F.col("p"), 1), "layer": layer, "rx": rx, "rz": rz, "db": F.when(F.size("p") == 1, F.regexp_replace(_part(F.col("p"), 0), "-(?:wal|shm)$", ""))})
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    regions = split.where("layer is not null and rx is not null").join(maps.select("ord", "folder", "mw"), ["ord", "folder", "mw"], "left_semi")
    changed = split.where(F.col("db").endswith(".db")).join(databases.select("ord", "db"), ["ord", "db"], "left_semi")
    out = regions.select("ord", "world", F.lit("region").alias("kind"), "folder", "mw", "layer", "rx", "rz", *none("string", "db"))
    return out.union(changed.select("ord", "world", F.lit("database"), *none("string", "folder", "mw", "layer"), *none("int", "rx", "rz"), "db")).distinct()


def known_uploads(uploads: DataFrame, layers: DataFrame) -> DataFrame:
    """Uploads (id, player, world, folder, mw, layer) with known: both the player's own tree and the merged one have the layer.

    layers: root, world, folder, mw, layer. The surface is there with any layer of a multiworld.
    """
    both = F.explode(F.array(F.concat(F.lit("players/"), F.col("player")), F.lit("merged"))).alias("root")
    place = ["root", "world", "folder", "mw", "layer"]
    have = layers.select(*place).union(layers.select(*place[:4], F.lit("surface"))).distinct().withColumn("here", F.lit(1))
    out = uploads.select("id", both, *place[1:]).join(have, place, "left")
    return out.groupBy("id").agg((F.count("here") == 2).alias("known"))


def copies(files: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Of files (tree, path, size) of worlds that one side has alone, those that a merge copies whole.

    A map's caches and snapshots, the minimap's snapshots and temporary files stay behind. present (tree, path, size): what
    an interrupted run has copied; files of the same size there are left.
    """
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    left_in_map = lambda p: N.is_cache_folder(p) | (p == DATABASE_BACKUPS) | N.backup_version(p)[0].isNotNull()
    behind = F.when(F.col("tree") == "minimap", F.exists(folders, N.is_minimap_backup)).otherwise(F.exists(folders, left_in_map))
    out = files.where(~behind & ~N.is_transient(F.element_at(F.split("path", "/"), -1)))
    return out if present is None else out.join(present.select("tree", "path", "size"), ["tree", "path", "size"], "left_anti")


def datasets(files: DataFrame, depth: int = 4) -> DataFrame:
    """Folders of data sets: those whose meta.json (path, valid) is valid, at most depth deep and in no other's folder."""
    name = F.regexp_replace("path", "/?meta\\.json$", "")
    level = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    sets = files.where(F.col("valid") & F.col("path").rlike("(?:^|/)meta\\.json$")).select(name.alias("folder")).distinct().where(level <= depth)
    outer = sets.where("folder <> ''").select("folder", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("folder")))).alias("above"))
    inside = outer.join(sets.select(F.col("folder").alias("above")), "above", "left_semi")
    return sets.join(inside.select("folder"), "folder", "left_anti")


def waypoint_counts(files: DataFrame) -> DataFrame:
    """For each world files and waypoints that the game still writes, and archived ones apart.

    files: ord, path, world, archived, n; a path that several roots list counts once, as the first one says.
    """
    once = files.groupBy("path").agg(F.min_by(F.struct("world", "archived", "n"), "ord").alias("f")).select("f.*")
    part = lambda test, name: [F.count_if(test).alias(f"{name}files"), F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(f"{name}waypoints")]
    return once.groupBy("world").agg(*part(~F.col("archived"), ""), *part(F.col("archived"), "archived_"))


def alternates_examples(others: DataFrame) -> DataFrame:
    """For each layer: coordinates with only a backup and conflict copies, how many, and the first three paths of each.

    others: layer, rx, rz, source, live, path, ord. Several backups of one coordinate count once, as the first listed.
    """
    backups = others.where((F.col("source") == "backup") & ~F.col("live")).groupBy("layer", "rx", "rz").agg(F.min_by(F.struct("path", "ord"), "ord").alias("f"))
    found = backups.select(F.lit("backup only").alias("kind"), F.col("layer").alias("detail"), "f.path", "f.ord")
    found = found.union(others.where("source = 'conflict'").select(F.lit("sync conflict"), "layer", "path", "ord"))
    return issues(found).withColumnRenamed("detail", "layer")


def counterparts(points: DataFrame, maps: DataFrame) -> DataFrame:
    """Where points (id, world, type, mw, x, z) of the overworld are in the nether and the other way round: id, dim, mw, x, z.

    maps: world, type, pos, mw. The other dimension's multiworld is the one of the same name, else its first.
    """
    other = F.when(F.col("type") == "minecraft:overworld", "minecraft:the_nether").when(F.col("type") == "minecraft:the_nether", "minecraft:overworld")
    first = maps.groupBy("world", "type").agg(F.min_by("mw", "pos").alias("first_mw"))
    same = maps.select("world", "type", "mw", F.lit(True).alias("same")).distinct()
    moved = points.select("id", "world", F.col("type").alias("own"), other.alias("type"), "mw", "x", "z").where("type is not null")
    out = moved.join(first, ["world", "type"]).join(same, ["world", "type", "mw"], "left")
    scaled = lambda c: F.floor(F.when(F.col("own") == "minecraft:overworld", F.col(c) / 8).otherwise(F.col(c) * 8)).cast("bigint")
    return out.select("id", F.col("type").alias("dim"), F.when(F.col("same"), F.col("mw")).otherwise(F.col("first_mw")).alias("mw"), scaled("x").alias("x"), scaled("z").alias("z"))


def tiles_hit(tiles: DataFrame, regions: DataFrame, deepest: int = 16) -> DataFrame:
    """Tiles (z <= 0, x, y; each 2^-z regions wide) that changed regions (rx, rz) lie in.

    A region is sent to its one tile of each zoom and met by equality.
    """
    zoom = F.explode(F.sequence(F.lit(-deepest), F.lit(0))).alias("z")
    touched = regions.select("rx", "rz").distinct().select("rx", "rz", zoom)
    touched = touched.select("z", F.expr("cast(floor(rx / power(2, -z)) as bigint)").alias("x"), F.expr("cast(floor(rz / power(2, -z)) as bigint)").alias("y"))
    return tiles.join(touched, ["z", "x", "y"], "left_semi")


def merge_stats(parts: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """Statistics of conversions by key: sums, and the first error that any part reports, in the order of ord."""
    return parts.groupBy(key).agg(*(F.sum(c).alias(c) for c in sums), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))).alias("first_error"))


#: Where a root's live waypoint trees lie, and how folders begin that hold copies of whole trees.
LIVE_TREES, TREE_COPIES = ("xaero/minimap", "config/xaero/minimap", "minimap"), "XaeroWaypoints"


def normal_path(path: Column) -> Column:
    """A path without empty parts and single dots."""
    return F.array_join(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")), "/")


def waypoint_trees(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """root, tree, kind, world, folder, dim, mw, path of the waypoint files among paths, each once by its normal path.

    A tree is tree/world/[dimension folder/]file, one of a root's three live ones or a folder that holds a copy of one.
    Backup folders of any depth repeat the shape of what they lie in: before the world they are trees of their own, in a
    world they hold its dimension folders; what lies in one, or in a copied tree, is archived. Where roots lie in one
    another a file belongs to the innermost in whose trees it is. Each path meets its own ancestors by equality.
    """
    file = paths.select(normal_path(F.col("path")).alias("path")).distinct()
    roots = roots.select(normal_path(F.col("root")).alias("root")).distinct()
    # No folder below the deepest root can be one, so no path needs more of its ancestors.
    deepest = roots.agg(F.max(F.when(F.col("root") == "", 0).otherwise(F.size(F.split("root", "/"))))).first()[0] or 0
    above = file.select("path", F.explode(ancestors_to(F.col("path"), deepest)).alias("root"))
    below = above.join(roots, "root")
    inner = F.when(F.col("root") == "", F.col("path")).otherwise(F.substring("path", F.length("root") + 2, F.length("path")))
    below = below.select("path", "root", inner.alias("inner")).where(F.col("inner").rlike(IN_TREE))
    part = lambda k: F.regexp_extract("inner", IN_TREE, k)
    fields = {"top": part(1), "outer": part(2), "world": part(3), "nested": part(4), "folder": F.when(part(5) != "", part(5)), "name": part(6)}
    below = below.select("path", "root", *(v.alias(k) for k, v in fields.items()))
    mw, known = N.waypoint_file(F.col("name"))
    folder = F.col("folder")
    found = below.where(known.isNotNull() & (F.col("world") != NOT_A_WORLD) & (folder.isNull() | (folder != NOT_A_WORLD)))
    kind = F.when(~F.col("top").isin(*LIVE_TREES) | (F.col("outer") != "") | (F.col("nested") != ""), "archived").otherwise("live")
    tree = F.rtrim(F.concat_ws("/", "top", "outer"), F.lit("/"))
    found = found.select("path", "root", tree.alias("tree"), kind.alias("kind"), "world", "folder", N.dimension_of_minimap_folder(folder).alias("dim"), mw.alias("mw"))
    values = F.struct("root", "tree", "kind", "world", "folder", "dim", "mw")
    return found.groupBy("path").agg(F.max_by(values, F.length("root")).alias("f")).select("f.*", "path")


def ancestors_to(path: Column, deepest: int) -> Column:
    """The root and the folders above a path down to a depth."""
    parts = F.size(F.split(path, "/"))
    return F.array_compact(F.array(F.lit(""), *(F.when(parts > k, F.substring_index(path, "/", k)) for k in range(1, deepest + 1))))


#: What lies in a tree, by its path below the root: tree, backups before the world, world, backups in it, folder, name. The
#: first tree that fits counts, and leading backups are all taken, as nothing is given back.
IN_TREE = rf"(?s)\A(?>({'|'.join(LIVE_TREES)}|{TREE_COPIES}[^/]*)/)((?:backup-*/)*+)([^/]+)/((?:backup-*/)*+)(?:([^/]+)/)?([^/]+)\z"


def world_rows(files: DataFrame, waypoints: DataFrame) -> DataFrame:
    """root, world, dims, databases, waypoint_files: what a scan shows of each world of world_files (root, world, rest).

    dims are dimension folders, the game's own first (overworld, nether, end), then others by name; databases are the names
    of the world's own. waypoints (world, path): how many live files a world has. A world without either is none.
    """
    parts = F.split("rest", "/")
    place = lambda f: F.when(f.isin("null", "DIM0"), 0).when(f == "DIM-1", 1).when(f == "DIM1", 2).otherwise(3)
    folder = F.when((F.size(parts) > 1) & N.dimension_of_folder(_part(parts, 0)).isNotNull(), _part(parts, 0))
    database = F.when((F.size(parts) == 1) & F.col("rest").rlike(DATABASE), F.col("rest"))
    # One row a folder or database before they are gathered: a world has few of either, whatever the files in them.
    each = files.select("root", "world", folder.alias("folder"), database.alias("database")).where("folder is not null or database is not null").distinct()
    gathered = each.groupBy("root", "world").agg(F.sort_array(F.collect_set(F.when(F.col("folder").isNotNull(), F.struct(place(F.col("folder")).alias("p"), "folder")))).alias("d"), F.sort_array(F.collect_set("database")).alias("databases"))
    counted = waypoints.groupBy("world").agg(F.count("*").alias("n"))
    out = gathered.join(counted, "world", "left")
    return out.select("root", "world", F.col("d.folder").alias("dims"), "databases", F.coalesce("n", F.lit(0)).alias("waypoint_files"))


def named_layers(layers: DataFrame, settings: DataFrame) -> DataFrame:
    """Layers (world, folder, mw, ...) with display: the name that the folder's settings (world, folder, ord, id, value) give the
    multiworld, the last of several, else the multiworld's own."""
    names = settings.groupBy("world", "folder", F.col("id").alias("mw")).agg(F.max_by("value", "ord").alias("named"))
    return layers.join(names, ["world", "folder", "mw"], "left").withColumn("display", F.coalesce("named", "mw")).drop("named")


def merged_counterparts(layers: DataFrame, merged: DataFrame) -> DataFrame:
    """id, world of where layers (id, world, folder, mw, layer) lie among those of a merged archive (world, folder, mw, layer).

    The merged world is that of the same name, or else the first by name of the same server; if that one lacks the folder,
    multiworld or layer there is no counterpart, even if another world of the server has them.
    """
    worlds = merged.select("world").distinct()
    own = layers.select("world").distinct()
    same = own.join(worlds, "world", "left_semi").select("world", F.col("world").alias("other"))
    firsts = worlds.groupBy(N.world_key(F.col("world")).alias("server")).agg(F.min("world").alias("other"))
    alike = own.join(same, "world", "left_anti").withColumn("server", N.world_key(F.col("world"))).join(firsts, "server").select("world", "other")
    to = layers.join(same.union(alike), "world").select("id", F.col("other").alias("world"), "folder", "mw", "layer")
    return to.join(merged.select("world", "folder", "mw", "layer").distinct(), ["world", "folder", "mw", "layer"], "left_semi").select("id", "world")
