"""Queries on archives as listings: roots, defaults, routing of changes, copies, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilelake.functions import naming as N
from tilelake.operators import archive as R
from tilelake.operators import catalog as C
from tilelake.operators import index as I
from tilelake.operators import live as L
from tilelake.operators import tiles as T
from tilelake.operators import waypoints as W
from tilelake.plans.catalog_queries import _pick, _q
from tilelake.plans.index_queries import _A, _ALL, _OTHERS, NOW_MS, _all, _others
from tilelake.plans.views import epoch_ms, highlights, positions, region_index, table, with_views


ROOTED = ("xaero/world-map/", "world-map/", "", "xaero/world-map/")
ROUTED = ("null/mw$default/", "null/mw$default/caves/3/", "Data.db-wal", "Other.db", "null/mw$x/", "null/mw$default/x")
UNDER = ("a", "cache_3", "65540_backup_1", "backup--", "XaeroPlus-db-backups", "b/caches")
MINI, MINI_FILES = ("Overworld", "backup--", "dim%-1", "temp_to_add"), ("mw$default_1.txt", "config.txt", "waypoints.txt")
TYPED, TYPES = ("null", "DIM-1", "a$b%c", "odd"), ("minecraft:the_end", "mod:x")
SPECS, TINTS, ROOFS = ("surface", "cave:12", "cave:x", "cave:-4"), ("#00ff10", "0a0b0c", "##ABCDEF", "12345"), ("12, 200", "256,1", "7,8", "x")


def _k():
    return F.col("o_orderkey")


def _text(k, prefix=""):
    return F.concat(F.lit(prefix), k.cast("string"))


def _rooted(s, d):
    k = _k() % 40
    layout = F.when(k % 8 == 7, "config/xaero/world-map/").when(k % 5 == 4, "").otherwise(_pick(ROOTED, k))
    world = F.when((k % 5 == 4) & (k % 8 != 7), "").otherwise(F.concat(_text(_k() % 3, "w"), F.lit("/")))
    root = F.when(k % 8 == 7, "r3").when(k % 5 == 4, "r4").otherwise(_text(k % 4, "r"))
    folder = F.when(root == "r3", F.when(k % 8 == 7, "DIM1").otherwise("cache")).otherwise(_pick(("null", "DIM-1"), F.floor(_k() / 7)))
    return table(s, d, "orders").select(F.concat(F.lit("home/"), root).alias("root"), F.concat(layout, world, folder, F.lit("/mw$default/"), _text(_k()), F.lit("_0.zip")).alias("path"))


def _minimap(s, d):
    o = table(s, d, "orders")
    paths = o.select(F.concat(_text(F.col("o_custkey"), "w"), F.lit("/"), _pick(MINI, _k()), F.lit("/"), _pick(MINI_FILES, F.floor(_k() / 3))).alias("path"))
    return R.minimap_worlds(paths, o.where("o_custkey % 3 = 0").select(_text(F.col("o_custkey"), "w").alias("world")))


def _dimensions(s, d):
    p = F.col("p_partkey")
    world, part = _text(F.floor(p / 40), "w").alias("world"), table(s, d, "part")
    dims = part.select(world, _pick(TYPED, p).alias("folder"), F.when(p % 3 > 0, _pick(TYPES, p % 3 - 1)).alias("config_type")).distinct()
    types = part.select(world, p.alias("ord"), _pick(("a:b/c", "minecraft:overworld"), F.floor(p / 3)).alias("level"), _pick(("minecraft:the_nether", "mod:y", "minecraft:the_end"), F.floor(p / 5)).alias("type"))
    return R.dimension_labels(dims, types).select("world", "folder", *(F.coalesce(c, F.lit("-")).alias(c) for c in ("dim", "type")), "label", "place")


def _defaults(s, d):
    c = F.col("o_custkey")
    layers = table(s, d, "orders").select(_text(c, "w").alias("world"), _pick(("DIM0", "DIM1", "DIM-1", "null", "a$b"), _k() * c % 7).alias("folder"), _pick(("mw$default", "mw$b", "mw$c"), _k() % 4 * c).alias("mw"))
    return R.default_layers(layers).select("world", *(F.coalesce(v, F.lit("-")).alias(v) for v in ("folder", "mw", "missing")))


def _classified(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("ord")).where("ord < 8")
    worlds = n.select("ord", _text(F.col("ord"), "v").alias("world"), F.when(F.col("ord") == 5, "s").otherwise(_text(F.col("ord"), "s/w")).alias("root"))
    name = F.when(_k() % 6 < 6, F.concat(_text(F.col("o_custkey") % 96 - 48), F.lit("_"), _text(_k() % 96 - 48), F.lit(".zip")))
    path = F.concat(_text(_k() % 9, "s/w"), F.lit("/"), _pick(ROUTED, F.floor(_k() / 9)), F.when(_pick(ROUTED, F.floor(_k() / 9)).rlike("[.]db"), "").otherwise(name))
    out = R.classify(table(s, d, "orders").select(path.alias("path")), worlds, n.select("ord", F.lit("null").alias("folder"), F.lit("mw$default").alias("mw")), n.select("ord", F.lit("Data.db").alias("db")))
    return out.select("ord", "world", "kind", *(F.coalesce(c, F.lit("-")).alias(c) for c in ("folder", "mw", "layer", "db")), *(F.coalesce(c, F.lit(-999)).alias(c) for c in ("rx", "rz")))


def _uploads(s, d):
    c, o = F.col("o_custkey"), table(s, d, "orders")
    place = [_text(_k() % 5, "w").alias("world"), F.lit("null").alias("folder"), F.lit("mw$default").alias("mw"), F.when(_k() % 2 == 0, "surface").otherwise(_text(_k() % 4)).alias("layer")]
    here = o.where("o_orderstatus <> 'P'").select(F.when(_k() % 3 == 0, "merged").otherwise(_text(c % 50, "players/p")).alias("root"), *place)
    return R.known_uploads(o.select(_k().alias("id"), _text(c % 50, "p").alias("player"), *place), here)


def _copied(s, d):
    files = table(s, d, "orders").select("o_custkey", F.when(_k() % 2 == 0, "world-map").otherwise("minimap").alias("tree"), F.concat(_pick(UNDER, F.floor(_k() / 5)), F.lit("/"), _text(_k()), _pick((".zip", ".zip.tmp", ".txt"), F.floor(_k() / 2))).alias("path"), F.floor("o_totalprice").cast("bigint").alias("size"))
    return R.copies(files.drop("o_custkey"), files.where("o_custkey % 3 = 0").select("tree", "path", (F.col("size") + F.col("o_custkey") % 2).alias("size")))


def _datasets(s, d):
    p = F.col("p_partkey")
    folder = F.concat(_text(F.floor(p / 8), "a"), F.when(p % 8 > 0, "/b").otherwise(""), F.when(p % 8 > 3, "/c").otherwise(""), F.when(p % 8 > 5, "/d/e").otherwise(""))
    return R.datasets(table(s, d, "part").select(F.concat(folder, F.lit("/meta.json")).alias("path"), ((p + F.col("p_size")) % 3 == 0).alias("valid")))


def _counted(s, d):
    c = F.col("c_custkey")
    return R.waypoint_counts(table(s, d, "customer").select(c.alias("ord"), _text(F.floor(c / 2), "f").alias("path"), _text(F.col("c_nationkey"), "w").alias("world"), (c % 3 == 0).alias("archived"), (c % 17).alias("n")))


def _tiles(s, d):
    p = F.col("p_partkey")
    tiles = table(s, d, "part").select((-(p % 4)).cast("int").alias("z"), F.floor(p / 4 % 9 - 4).cast("bigint").alias("x"), F.floor(p / 36 % 9 - 4).cast("bigint").alias("y")).distinct()
    return R.tiles_hit(tiles, region_index(s, d).where("mtime_ms % 5 = 0 and rx % 7 = 0"), 4)


def _converted(s, d):
    parts = table(s, d, "lineitem").select((F.col("l_suppkey")).alias("region"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_linenumber").cast("bigint").alias("present"), F.col("l_quantity").cast("bigint").alias("mapped"), F.when(F.col("l_linenumber") == 5, _text(F.col("l_orderkey"), "error ")).alias("error"))
    return R.merge_stats(parts, "region", ["present", "mapped"]).withColumn("first_error", F.coalesce("first_error", F.lit("-")))


def _probes(s, d):
    z = F.col("size")
    return _all(s, d).select("layer", F.when(z % 7 > 0, F.concat(_text(z % 7), F.lit("."), _text(z % 3))).alias("version"), (z % 11 == 0).alias("truncated"), F.when(z % 13 == 0, "bad").alias("error"), (z % 1024).alias("chunks"))


def _specs(s, d):
    p = F.col("p_partkey")
    o, w = N.roof(_pick(ROOFS, F.floor(p / 2)))
    return table(s, d, "part").select("p_partkey", F.coalesce(N.layer_of_spec(_pick(SPECS, p)), F.lit("-")).alias("layer"), F.coalesce(N.tint(_pick(TINTS, F.floor(p / 4))), F.lit(-1)).alias("tint"), F.coalesce(o, F.lit(-1)).alias("obsidian"), F.coalesce(w, F.lit(-1)).alias("snow"), F.coalesce(N.cave_mode(p % 4), F.lit("-")).alias("mode"))


def _level_types(s, d):
    p = F.col("p_partkey")
    line = F.concat(_pick(("dimensionType:", "other:", "dimensionType:"), p), F.replace("p_name", F.lit(" "), F.lit("$")), F.when(p % 5 > 0, F.lit(":")).otherwise(""), F.replace("p_type", F.lit(" "), F.lit("$")))
    return W.dimension_types(table(s, d, "part").select("p_partkey", line.alias("line"))).drop("line")


def _kinds(s, d):
    p = F.col("p_partkey")
    return C.block_kinds(table(s, d, "part").select("p_partkey", F.concat(F.lit("minecraft:"), _pick(("lava", "obsidian", "snow", "ice", "cave_air", "stone", "light", "water"), p)).alias("name"), F.when(p % 3 == 0, F.col("p_size")).otherwise(0).cast("int").alias("alpha")))


def _drawn_both(s, d):
    rows = highlights(s, d).select("side", "dim", _pick(tuple(C.DRAWING_KEYS), F.col("x") + 128).alias("family"), F.concat_ws(",", "x", "z").alias("key")).distinct()
    return C.drawing_report(rows.where("side = 'A'"), rows.where("side = 'B'"))


def _drawn(s, d):
    return C.drawing_counts(highlights(s, d).select("dim", F.element_at(F.array(*map(F.lit, C.DRAWING_KEYS)), (F.col("src") % 4 + 1).cast("int")).alias("family")))


def _thumbs(s, d):
    rows = region_index(s, d).select("layer", F.when(F.col("is_zip"), 200).otherwise(0).alias("roof_obsidian"), F.lit(0).alias("roof_snow"), "rx", "rz", "mtime_ms", "size", "ord")
    return T.thumbnails(T.last_wins(rows, ["layer", "roof_obsidian", "roof_snow", "rx", "rz"], "ord"), _all(s, d), -20, -20, 20, 20)


def _composed(s, d):
    h = table(s, d, "lineitem")
    cell = lambda c: F.pmod(F.floor(F.col(c) / 64), F.lit(8)).cast("bigint")
    rows = h.select((F.col("l_suppkey") % 5).alias("layer"), (F.col("l_partkey") % 64 - 32).alias("rx"), (F.col("l_orderkey") % 64 - 32).alias("rz"), cell("l_partkey").alias("px"), cell("l_orderkey").alias("pz"), "l_linenumber")
    keys = ["layer", "rx", "rz", "px", "pz"]
    one = rows.groupBy(*keys).agg(F.max("l_linenumber").cast("bigint").alias("r"), F.count("*").alias("g"))
    return T.compose(one.select(*keys, "r", "g", F.lit(0).alias("b"), F.lit(255).alias("a")), -6, 8)


def _counterparts(s, d):
    p = positions(s, d)
    points = p.select(F.col("event_id").alias("id"), _text(F.col("player") % 20, "w").alias("world"), F.col("dim").alias("type"), _text(F.col("event_id") % 3, "mw$").alias("mw"), "x", "z")
    c = F.col("c_custkey")
    maps = table(s, d, "customer").select(_text(c % 20, "w").alias("world"), F.when(c % 3 == 0, "minecraft:overworld").otherwise("minecraft:the_nether").alias("type"), c.alias("pos"), _text(c % 2, "mw$").alias("mw"))
    return R.counterparts(points, maps)


def _roster_changes(s, d):
    p = positions(s, d).withColumn("player", F.col("player") * 50 + F.col("x") % 50)
    return L.roster_changes(p.where("event_id % 2 = 0"), p.where("event_id % 2 = 1"))


def _days(s, d):
    key = F.replace("o_orderpriority", F.lit("-"), F.element_at(F.array(F.lit(":"), F.lit("_"), F.lit("/")), (_k() % 3 + 1).cast("int")))
    key = F.when(_k() % 2 == 0, F.lower(F.replace(key, F.lit(" "), F.lit("")))).otherwise(key)
    return table(s, d, "orders").select("o_orderkey", N.day(epoch_ms("o_orderdate") - _k() * 1000).alias("day"), N.safe_dimension_key(key).alias("safe"))


TREES = ("xaero/minimap/", "config/xaero/minimap/", "minimap/", "XaeroWaypoints_BACKUP24/", "XaeroWaypoints/backup/", "xaero/minimap/backup--/", "other/", "minimap/backup/backup-/")
WORLD_FOLDERS = ("", "Overworld/", "dim%-1/", "backup/dim%mod$a/", "backup-/backup/", "temp_to_add/", "Nether/deep/", "odd/")


def _trees(s, d):
    """Waypoint files below two roots, one in the other; some paths are written in two ways."""
    o, k, c = table(s, d, "orders"), _k(), F.col("o_custkey")
    root = F.when(k % 3 == 0, "/arch/").when(k % 3 == 1, "/arch/x//").otherwise("/else/")
    world = F.when(c % 11 == 0, "temp_to_add").otherwise(_text(c, "w"))
    path = F.concat(root, F.when(k % 2 == 0, "./").otherwise(""), _pick(TREES, F.floor(k / 5)), world, F.lit("/"), _pick(WORLD_FOLDERS, F.floor(k / 7)), _pick(MINI_FILES, F.floor(k / 11)))
    roots = s.createDataFrame([("/arch",), ("/arch/x",), ("/none",)], "root string")
    return R.waypoint_trees(o.select(path.alias("path")), roots)


def _world_rows(s, d):
    o, k = table(s, d, "orders"), _k()
    rest = F.when(k % 5 == 0, F.concat(F.lit("XaeroPlus"), _text(k % 3), F.lit(".db"))).when(k % 5 == 1, "notes/x.zip").otherwise(F.concat(_pick(("null", "DIM1", "DIM-1", "a$b%c", "mod$z"), F.floor(k / 5)), F.lit("/mw$default/0_0.zip")))
    files = o.select(F.lit("r").alias("root"), _text(F.col("o_custkey"), "w").alias("world"), rest.alias("rest"))
    points = o.where("o_orderkey % 3 = 0").select(_text(F.col("o_custkey"), "w").alias("world"), _text(k).alias("path"))
    return R.world_rows(files, points).select("world", F.array_join("dims", ",").alias("dims"), F.array_join("databases", ",").alias("databases"), "waypoint_files")


def _named_layers(s, d):
    o, k, c = table(s, d, "orders"), _k(), F.col("o_custkey")
    place = [_text(c, "w").alias("world"), _pick(("null", "DIM1"), k).alias("folder")]
    layers = o.select(*place, _text(k % 4, "mw$").alias("mw")).distinct()
    return R.named_layers(layers, o.where("o_orderkey % 3 = 0").select(*place, k.alias("ord"), _text(k % 4, "mw$").alias("id"), _text(k, "name ").alias("value")))


def _merged_places(s, d):
    """Layers of customers' worlds, and a merged archive that has some worlds by name and others of the same server."""
    c, k = table(s, d, "customer"), F.col("c_custkey")
    end = lambda n: _pick(("", ".net", ".com", ".org"), n)
    world = lambda n: F.concat(F.lit("Multiplayer_"), F.lit("Play"), F.floor(n / 3).cast("string"), end(n))
    rest = [_pick(("null", "DIM1"), F.col("c_nationkey")).alias("folder"), F.lit("mw$default").alias("mw"), _pick(("surface", "3"), F.floor(k / 2)).alias("layer")]
    return R.merged_counterparts(c.select(k.alias("id"), world(k).alias("world"), *rest), c.where("c_custkey % 5 < 3").select(world(k + 1).alias("world"), *rest))


QUERIES = {
    "merged_counterparts": _merged_places,
    "archive_waypoint_trees": lambda s, d: _trees(s, d).select("root", "tree", "kind", "world", *(F.coalesce(c, F.lit("-")).alias(c) for c in ("folder", "dim", "mw")), "path"),
    "archive_world_rows": _world_rows,
    "archive_named_layers": _named_layers,
    "archive_version_histogram": lambda s, d: I.version_histogram(_probes(s, d)),
    "archive_roots": lambda s, d: R.world_files(_rooted(s, d)).groupBy("root", "layout", "world").agg(F.count("*").alias("files"), F.min("rest").alias("first"), F.max("rest").alias("last")),
    "archive_minimap_worlds": _minimap,
    "archive_dimensions": _dimensions,
    "archive_default_layers": _defaults,
    "archive_classify": _classified,
    "archive_known_uploads": _uploads,
    "archive_copies": _copied,
    "archive_datasets": _datasets,
    "archive_waypoint_counts": _counted,
    "archive_alternates_examples": lambda s, d: R.alternates_examples(_others(s, d).withColumn("path", F.concat_ws("_", "rx", "rz", "ord"))),
    "archive_tiles_hit": _tiles,
    "archive_merge_stats": _converted,
    "archive_probe_versions": lambda s, d: I.probe_versions(_probes(s, d)),
    "archive_probe_stats": lambda s, d: I.probe_stats(_probes(s, d)),
    "spec_parsing": _specs,
    "settings_level_types": _level_types,
    "block_kinds": _kinds,
    "drawing_counts": _drawn,
    "drawing_report": _drawn_both,
    "region_coverage_rectangles": lambda s, d: I.coverage_rectangles(_all(s, d), -4, NOW_MS),
    "region_coverage_pixels": lambda s, d: I.coverage_rectangles(_all(s, d), -11, NOW_MS),
    "tile_compose": _composed,
    "live_path_nether": lambda s, d: L.nether_blocks(L.path_length(positions(s, d)).withColumn("blocks", F.floor(F.coalesce("blocks", F.lit(0.0))))).select("player", "dim", "blocks", F.coalesce("nether_blocks", F.lit(-1)).alias("nether_blocks")),
    "live_roster_changes": _roster_changes,
    "nether_counterparts": _counterparts,
    "days_and_keys": _days,
    "thumbnails_current": _thumbs,
}

_at = lambda values, by: f"list_extract([{_q(values)}], cast({by} as bigint) % {len(values)} + 1)"
_WORLDS = "ws: select n_nationkey ord, 'v' || n_nationkey world, case when n_nationkey = 5 then 's' else 's/w' || n_nationkey end root from nation where n_nationkey < 8"
_PROBES = "pr: select layer, case when size % 7 > 0 then (size % 7) || '.' || (size % 3) else '?' end version, size % 11 = 0 truncated, size % 13 = 0 bad, size % 1024 chunks from f"
_RECTANGLES = f"select layer, x, y, px, py, {{4}} side, floor((79200 - 40 * age) / 720.0::double)::bigint r, floor((108000 - 60 * age) / 720.0::double)::bigint g, floor((136800 - 80 * age) / 720.0::double)::bigint b, 230 a from (select *, row_number() over (partition by layer, x, y, px, py order by rx desc, rz desc) n from (select *, cast((rx - x * {{0}}) * 512 // {{1}} as int) px, cast((rz - y * {{0}}) * 512 // {{1}} as int) py from (select layer, rx, rz, cast(floor(rx / {{2}}.0::double) as bigint) x, cast(floor(rz / {{3}}.0::double) as bigint) y, least(greatest(0, {NOW_MS} - mtime_ms) // 86400000, 720) age from f))) where n = 1"
_AT = "list_extract({0}, cast(({1}) % {2} as int) + 1)"


def _listed(values, number):
    return _AT.format("[" + ", ".join(f"'{v}'" for v in values) + "]", number, len(values))


_PLAYED = "'Multiplayer_Play' || ({0}) // 3 || list_extract(['', '.net', '.com', '.org'], cast(({0}) % 4 as int) + 1)"
_PLAYED_KEY = "lower(regexp_replace(replace({0}, 'Multiplayer_', ''), '\\.(org|net|com)$', ''))"
_REST = "case when c_nationkey % 2 = 0 then 'null' else 'DIM1' end folder, case when c_custkey // 2 % 2 = 0 then 'surface' else '3' end layer"
_TREE_PATHS = f"tp: select distinct k % 3 r, case k % 3 when 0 then 'arch/' when 1 then 'arch/x/' else 'else/' end pre, {_listed(TREES, 'k // 5')} t, case when c % 11 = 0 then 'temp_to_add' else 'w' || c end w, {_listed(WORLD_FOLDERS, 'k // 7')} f, {_listed(MINI_FILES, 'k // 11')} n from (select o_orderkey k, o_custkey c from orders)"
ORACLES = {
    "merged_counterparts": with_views("select l.id, l.other world from (select lo.*, case when lo.world in (select world from mg) then lo.world else (select min(world) from mg where mk = lk) end other from lo) l semi join mg on mg.world = l.other and mg.folder = l.folder and mg.layer = l.layer", f"lo: select c_custkey id, {_PLAYED.format('c_custkey')} world, {_PLAYED_KEY.format(_PLAYED.format('c_custkey'))} lk, {_REST} from customer", f"mg: select {_PLAYED.format('c_custkey + 1')} world, {_PLAYED_KEY.format(_PLAYED.format('c_custkey + 1'))} mk, {_REST} from customer where c_custkey % 5 < 3"),
    "archive_waypoint_trees": with_views("select case r when 0 then 'arch' else 'arch/x' end root, rtrim(t, '/') tree, case when contains(t, 'backup') or starts_with(t, 'Xaero') or contains(f, 'backup') then 'archived' else 'live' end kind, w world, case f when 'Overworld/' then 'Overworld' when 'dim%-1/' then 'dim%-1' when 'backup/dim%mod$a/' then 'dim%mod$a' when 'odd/' then 'odd' else '-' end folder, case f when 'Overworld/' then 'minecraft:overworld' when 'dim%-1/' then 'minecraft:the_nether' when 'backup/dim%mod$a/' then 'mod:a' else '-' end dim, case n when 'waypoints.txt' then '-' else 'mw$default' end mw, pre || t || w || '/' || f || n path from tp where r < 2 and t <> 'other/' and w <> 'temp_to_add' and f not in ('temp_to_add/', 'Nether/deep/') and n <> 'config.txt'", _TREE_PATHS),
    "archive_world_rows": "select * from (select world, coalesce(string_agg(distinct db, ',' order by db), '') databases, count(*) filter (k % 3 = 0) waypoint_files, concat_ws(',', case when bool_or(dim = 'null') then 'null' end, case when bool_or(dim = 'DIM-1') then 'DIM-1' end, case when bool_or(dim = 'DIM1') then 'DIM1' end, case when bool_or(dim = 'a$b%c') then 'a$b%c' end, case when bool_or(dim = 'mod$z') then 'mod$z' end) dims from (select 'w' || o_custkey world, o_orderkey k, case when o_orderkey % 5 > 1 then list_extract(['null', 'DIM1', 'DIM-1', 'a$b%c', 'mod$z'], cast(o_orderkey // 5 % 5 as int) + 1) end dim, case when o_orderkey % 5 = 0 then 'XaeroPlus' || o_orderkey % 3 || '.db' end db from orders) group by world) where dims <> '' or databases <> ''",
    "archive_named_layers": "select world, folder, mw, coalesce(max_by('name ' || k, k) filter (k % 3 = 0), mw) display from (select 'w' || o_custkey world, case when o_orderkey % 2 = 0 then 'null' else 'DIM1' end folder, 'mw$' || o_orderkey % 4 mw, o_orderkey k from orders) group by 1, 2, 3",
    "archive_version_histogram": with_views("select layer, version, count(*) n from pr group by 1, 2 union all select 'all', version, count(*) n from pr group by 2", "idx", _ALL, _PROBES),
    "archive_roots": with_views("select 'home/' || root root, lay layout, case when root = 'r4' then 'r4' else 'w' || k0 % 3 end world, count(*) files, min(rest) as first, max(rest) as last from (select *, folder || '/mw$default/' || k0 || '_0.zip' rest from p where folder <> 'cache') group by 1, 2, 3",
        f"p: select k0, case when k % 8 = 7 then 'config/xaero/world-map/' when k % 5 = 4 then '' else {_at(ROOTED, 'k')} end lay, case when k % 8 = 7 then 'r3' when k % 5 = 4 then 'r4' else 'r' || k % 4 end root, case when k % 8 = 7 then 'DIM1' when k % 5 <> 4 and k % 4 = 3 then 'cache' when k0 // 7 % 2 = 0 then 'null' else 'DIM-1' end folder from (select o_orderkey k0, o_orderkey % 40 k from orders)"),
    "archive_minimap_worlds": f"select 'w' || o_custkey world, count(*) files from (select o_custkey, {_at(MINI, 'o_orderkey')} folder, {_at(MINI_FILES, 'o_orderkey // 3')} file from orders) where folder in ('Overworld', 'dim%-1') and file <> 'config.txt' and o_custkey % 3 <> 0 group by 1",
    "archive_dimensions": with_views("select world, folder, coalesce(dim, '-') dim, coalesce(type, '-') type, case when dim = 'a:b/c' then 'c' when dim = 'minecraft:overworld' then 'Overworld' when dim = 'minecraft:the_nether' then 'Nether' when type = 'minecraft:the_end' then 'The End' else folder end as label, case folder when 'null' then 0 when 'DIM-1' then 1 else 3 end place from (select *, case when coalesce(ct, named) in ('minecraft:overworld', 'minecraft:the_nether', 'minecraft:the_end') then coalesce(ct, named) else dim end type from ds left join ty using (world, dim))",
        f"pp: select 'w' || p_partkey // 40 world, p_partkey p from part", f"ds: select distinct world, {_at(TYPED, 'p')} folder, case p % 3 when 1 then 'minecraft:the_end' when 2 then 'mod:x' end ct, case p % 4 when 0 then 'minecraft:overworld' when 1 then 'minecraft:the_nether' when 2 then 'a:b/c' end dim from pp",
        f"ty: select world, {_at(('a:b/c', 'minecraft:overworld'), 'p // 3')} dim, min_by({_at(('minecraft:the_nether', 'mod:y', 'minecraft:the_end'), 'p // 5')}, p) named from pp group by 1, 2"),
    "archive_default_layers": with_views("select world, coalesce(folder, '-') folder, case when folder is null then '-' else coalesce(mw, '-') end mw, case when folder is null then 'dim' when mw is null then 'mw' else '-' end missing from (select world, folder, (select case when bool_or(l.mw = 'mw$default') then 'mw$default' when count(distinct l.mw) = 1 then min(l.mw) end from l where l.world = w.world and l.folder = w.folder) mw from w)",
        f"l: select distinct 'w' || o_custkey world, {_at(('DIM0', 'DIM1', 'DIM-1', 'null', 'a$b'), 'o_orderkey * o_custkey % 7')} folder, {_at(('mw$default', 'mw$b', 'mw$c'), 'o_orderkey % 4 * o_custkey')} mw from orders",
        "w: select world, case when bool_or(folder = 'null') then 'null' when bool_or(folder = 'DIM0') then 'DIM0' when count(distinct folder) = 1 then min(folder) end folder from l group by 1"),
    "archive_classify": with_views("select distinct ord, world, case when r in (0, 1) then 'region' else 'database' end kind, case when r < 2 then 'null' else '-' end folder, case when r < 2 then 'mw$default' else '-' end mw, case r when 0 then 'surface' when 1 then '3' else '-' end layer, case when r = 2 then 'Data.db' else '-' end db, case when r < 2 then rx else -999 end rx, case when r < 2 then rz else -999 end rz from (select e.*, ws.*, row_number() over (partition by k order by ws.ord) n from e join ws on e.top = ws.root or ws.root = 's') where n = 1 and root <> 's' and r in (0, 1, 2)",
        _WORLDS, "e: select o_orderkey k, 's/w' || o_orderkey % 9 top, o_orderkey // 9 % 6 r, o_custkey % 96 - 48 rx, o_orderkey % 96 - 48 rz from orders"),
    "archive_known_uploads": with_views("select id, exists (select 1 from h where h.root = 'merged' and h.world = u.world and (h.layer = u.layer or u.layer = 'surface')) and exists (select 1 from h where h.root = 'players/' || u.player and h.world = u.world and (h.layer = u.layer or u.layer = 'surface')) known from u",
        "u: select o_orderkey id, o_orderstatus st, 'p' || o_custkey % 50 player, 'w' || o_orderkey % 5 world, case when o_orderkey % 2 = 0 then 'surface' else cast(o_orderkey % 4 as varchar) end layer from orders", "h: select distinct case when id % 3 = 0 then 'merged' else 'players/' || player end root, world, layer from u where st <> 'P'"),
    "archive_copies": with_views("select tree, path, size from c where ext <> 1 and (case when tree = 'minimap' then under <> 3 else under in (0, 3) end) and not (o_custkey % 6 = 0)",
        f"c: select o_custkey, case when o_orderkey % 2 = 0 then 'world-map' else 'minimap' end tree, {_at(UNDER, 'o_orderkey // 5')} || '/' || o_orderkey || {_at(('.zip', '.zip.tmp', '.txt'), 'o_orderkey // 2')} path, o_orderkey // 5 % 6 under, o_orderkey // 2 % 3 ext, cast(floor(o_totalprice) as bigint) size from orders"),
    "archive_datasets": with_views("select folder from m where not exists (select 1 from m o where starts_with(m.folder, o.folder || '/'))", "m: select distinct 'a' || p_partkey // 8 || case when p_partkey % 8 > 0 then '/b' else '' end || case when p_partkey % 8 > 3 then '/c' else '' end folder from part where (p_partkey + p_size) % 3 = 0 and p_partkey % 8 < 6"),
    "archive_waypoint_counts": "select world, count(*) filter (k % 3 <> 0) files, cast(coalesce(sum(k % 17) filter (k % 3 <> 0), 0) as bigint) waypoints, count(*) filter (k % 3 = 0) archived_files, cast(coalesce(sum(k % 17) filter (k % 3 = 0), 0) as bigint) archived_waypoints from (select min(c_custkey) k, min_by('w' || c_nationkey, c_custkey) world from customer group by c_custkey // 2) group by 1",
    "archive_alternates_examples": with_views("select kind, layer, count(*) n, string_agg(rx || '_' || rz || '_' || ord, ',' order by ord) filter (r <= 3) examples from (select *, row_number() over (partition by kind, layer order by ord) r from i2) group by 1, 2", "idx", _A, _OTHERS, "i2: select 'backup only' kind, layer, rx, rz, min(ord) ord from o where source = 'backup' and not live group by layer, rx, rz union all select 'sync conflict', layer, rx, rz, ord from o where source = 'conflict'"),
    "archive_tiles_hit": with_views("select z, x, y from t where exists (select 1 from g where rx >= x * sp and rx < (x + 1) * sp and rz >= y * sp and rz < (y + 1) * sp)", "idx", "g: select distinct rx, rz from idx where mtime_ms % 5 = 0 and rx % 7 = 0", "t: select distinct cast(-(p_partkey % 4) as int) z, cast(floor(p_partkey / 4.0::double % 9 - 4) as bigint) x, cast(floor(p_partkey / 36.0::double % 9 - 4) as bigint) y, 1 << cast(p_partkey % 4 as int) sp from part"),
    "archive_merge_stats": "select l_suppkey region, cast(sum(l_linenumber) as bigint) present, cast(sum(l_quantity) as bigint) mapped, coalesce(min_by('error ' || l_orderkey, l_orderkey * 10 + l_linenumber) filter (l_linenumber = 5), '-') first_error from lineitem group by 1",
    "archive_probe_versions": with_views("select layer, version, count(*) n from pr group by 1, 2", "idx", _ALL, _PROBES),
    "archive_probe_stats": with_views("select layer, count(*) sampled, count(*) filter (truncated) truncated, count(*) filter (bad) unreadable, cast(sum(chunks) as bigint) chunks from pr group by 1", "idx", _ALL, _PROBES),
    "spec_parsing": f"select p_partkey, list_extract(['surface', '12', '-', '-4'], p_partkey % 4 + 1) layer, list_extract([65296, 658188, 11259375, -1], cast(p_partkey // 4 % 4 + 1 as bigint)) tint, list_extract([12, -1, 7, -1], cast(p_partkey // 2 % 4 + 1 as bigint)) obsidian, list_extract([200, -1, 8, -1], cast(p_partkey // 2 % 4 + 1 as bigint)) snow, list_extract(['Off', 'Layered', 'Full', '-'], p_partkey % 4 + 1) as mode from part",
    "settings_level_types": "select p_partkey, replace(p_name, ' ', ':') as level, replace(p_type, ' ', ':') as type from part where p_partkey % 3 <> 1 and p_partkey % 5 > 0",
    "block_kinds": f"select p_partkey, 'minecraft:' || b as name, case when p_partkey % 3 = 0 then p_size when b in ('lava', 'water') then 191 when b = 'ice' then 216 else 127 end alpha, b = 'cave_air' air, b in ('lava', 'light') shining, case b when 'obsidian' then 'obsidian' when 'snow' then 'snow' else 'none' end roof from (select *, {_at(('lava', 'obsidian', 'snow', 'ice', 'cave_air', 'stone', 'light', 'water'), 'p_partkey')} b from part)",
    "drawing_counts": with_views(f"select dim, {_at(tuple(C.DRAWING_KEYS), 'src')} family, count(*) n from hl group by 1, 2", "hl"),
    "region_coverage_rectangles": with_views(_RECTANGLES.format(16, 16, 16, 16, 32), "idx", _ALL),
    "region_coverage_pixels": with_views(_RECTANGLES.format(2048, 2048, 2048, 2048, 1), "idx", _ALL),
    "tile_compose": "select l_suppkey % 5 layer, cast(case when rx < 0 then -1 else 0 end as bigint) x, cast(case when rz < 0 then -1 else 0 end as bigint) y, case when rx < 0 then rx + 64 else rx end * 8 + px tx, case when rz < 0 then rz + 64 else rz end * 8 + pz tz, cast(max(l_linenumber) as bigint) r, count(*) g, 0 b, 255 a from (select *, l_partkey % 64 - 32 rx, l_orderkey % 64 - 32 rz, l_partkey // 64 % 8 px, l_orderkey // 64 % 8 pz from lineitem) group by 1, 2, 3, 4, 5",
    "live_path_nether": with_views("select player, dim, blocks, case when dim = 'minecraft:overworld' then cast(floor(blocks / 8.0::double + 0.5) as bigint) else -1 end nether_blocks from (select player, dim, cast(floor(coalesce(sum(step), 0)) as bigint) blocks from (select player, dim, sqrt(power(x - lag(x) over w, 2) + power(z - lag(z) over w, 2)) step from pos window w as (partition by player, dim order by t_ms, event_id)) group by 1, 2)", "pos"),
    "live_roster_changes": with_views("select player, case when bool_or(event_id % 2 = 1) then 'added' else 'removed' end as event from (select event_id, player * 50 + x % 50 player from pos) group by player having count(distinct event_id % 2) = 1", "pos"),
    "nether_counterparts": with_views("select id, dim, coalesce((select any_value(mw) from m where m.world = o.world and m.type = o.dim and m.mw = o.mw), f.mw) mw, cast(floor(case when dim = 'minecraft:the_nether' then x / 8.0::double else x * 8 end) as bigint) x, cast(floor(case when dim = 'minecraft:the_nether' then z / 8.0::double else z * 8 end) as bigint) z from o join f on f.world = o.world and f.type = o.dim", "pos",
        "m: select 'w' || c_custkey % 20 world, case when c_custkey % 3 = 0 then 'minecraft:overworld' else 'minecraft:the_nether' end as type, c_custkey pos, 'mw$' || c_custkey % 2 mw from customer", "f: select world, type, min_by(mw, pos) mw from m group by 1, 2",
        "o: select event_id id, 'w' || player % 20 world, case dim when 'minecraft:overworld' then 'minecraft:the_nether' when 'minecraft:the_nether' then 'minecraft:overworld' end dim, 'mw$' || event_id % 3 mw, x, z from pos"),
    "days_and_keys": "select o_orderkey, strftime(epoch_ms(epoch_ms(o_orderdate) - o_orderkey * 1000), '%Y-%m-%d') as day, regexp_full_match(k, '[a-z0-9:_./-]+') and contains(k, ':') safe from (select *, case when o_orderkey % 2 = 0 then lower(replace(k0, ' ', '')) else k0 end k from (select *, replace(o_orderpriority, '-', list_extract([':', '_', '/'], o_orderkey % 3 + 1)) k0 from orders))",
    "drawing_report": with_views("select dim, family, count(*) source_rows, any_value(n) dest_before, count(k) overlap, any_value(n) + count(*) - count(k) dest_after from (select * from r where side = 'B') b left join (select dim, x, z, 1 k from r where side = 'A') a using (dim, x, z) join (select dim, family, count(*) n from r where side = 'A' group by 1, 2) using (dim, family) group by 1, 2", "hl", f"r: select distinct side, dim, x, z, {_at(tuple(C.DRAWING_KEYS), 'x + 128')} family from hl"),
    "thumbnails_current": with_views("select t.* from t join f using (layer, rx, rz, mtime_ms) where rx between -20 and 20 and rz between -20 and 20", "idx", _ALL, "t: select layer, roof_obsidian, 0 roof_snow, rx, rz, mtime_ms, size, ord from (select *, case when is_zip then 200 else 0 end roof_obsidian, row_number() over (partition by layer, is_zip, rx, rz order by ord desc) n from idx) where n = 1"),
}
