"""Queries on merging two archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilelake.operators import merging as M
from tilelake.operators.merge_run import Archive, MergeRun, Options
from tilelake.operators.tiles import last_wins
from tilelake.plans.index_queries import _A, _B, _side
from tilelake.plans.file_queries import shared_folder
from tilelake.plans.views import epoch_ms, highlights, region_index, table, with_views


def _plan(s, d):
    return M.plan(_side(s, d, "A"), _side(s, d, "B"))


def _tiles(s, d):
    """Each file of the index as a tile of its region, the last of each place; of every 13th size the file can't be read."""
    rows = region_index(s, d).select("side", "layer", "rx", "rz", (F.col("ord") % 4).alias("tx"), (F.floor(F.col("ord") / 4) % 4).alias("tz"), "size", "ord")
    tiles = lambda side: last_wins(rows.where(F.col("side") == side).drop("side"), ["layer", "rx", "rz", "tx", "tz"], "ord")
    bad = [_side(s, d, side).where("size % 13 = 0").select("layer", "rx", "rz", F.lit(side).alias("side")) for side in "AB"]
    return M.merge_tiles(M.plan(_side(s, d, "A"), _side(s, d, "B")), tiles("A"), tiles("B"), bad[0].union(bad[1]))


def _mixed(s, d):
    k = F.col("o_orderkey")
    world = F.concat(F.lit("w"), F.col("o_custkey").cast("string"))
    return M.mixed_units(table(s, d, "orders").select(F.when(k % 2 == 0, "A").otherwise("B").alias("side"), world.alias("world"), F.when(k % 3 == 0, "null").when(k % 3 == 1, "DIM0").otherwise("DIM1").alias("dim"), F.lit("mw$default").alias("mw"), (k % 2).alias("layer")))


def _meaning(s, d):
    p = F.col("p_partkey")
    name = F.when(p % 11 == 0, "XLavaColumns.db").otherwise(F.concat(F.lit("Portals"), p.cast("string"), F.lit(".db")))
    return M.merge_meaning(table(s, d, "part").select(F.floor(p / 4).alias("merge"), name.alias("name")), "merge")


def _world_name(k):
    end = F.element_at(F.array(F.lit(""), F.lit(".net"), F.lit(".com"), F.lit(".org.net")), (k % 4 + 1).cast("int"))
    return F.concat(F.when(k % 3 == 0, "Multiplayer_").otherwise(""), F.lit("Play"), F.floor(k / 4).cast("string"), end)


def _worlds(s, d, auto=False):
    """A world for each customer, of every fifth on both sides, four to a server; aliases between neighbours."""
    k, c = F.col("c_custkey"), table(s, d, "customer")
    w = c.select(k, _world_name(k).alias("world"))
    aliases = c.where("c_custkey % 7 = 0").select(_world_name(k).alias("x"), _world_name(k + k % 4 + 1).alias("y"))
    return M.pair_worlds(w.where("c_custkey % 5 <= 2"), w.where("c_custkey % 5 >= 2"), aliases, auto).withColumn("taken_by", F.coalesce("taken_by", F.lit("-")))


def _settings_files(o, file, end=":n"):
    """Lines of orders as settings files of two sides, merged. end: what a named line ends in."""
    end = F.lit(end) if isinstance(end, str) else end
    line = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("MWName:mw"), (F.col("o_custkey") % 13).cast("string"), end)).otherwise(F.concat(F.lit("note "), F.col("o_custkey").cast("string")))
    side = F.when(F.floor(F.col("o_orderkey") / 40) % 2 == 0, "A").otherwise("B")
    lines = o.select(file.alias("file"), side.alias("side"), (file % 3 * F.when(side == "B", 1).otherwise(0)).alias("mtime_ms"), F.col("o_orderkey").alias("ord"), line.alias("line"))
    return M.merge_settings(lines, "file")


def _settings(s, d):
    """All orders, in files of up to 500 lines."""
    return _settings_files(table(s, d, "orders"), F.floor(F.col("o_orderkey") / 500))


def _settings_loose(s, d):
    """The same, but every seventh order's line has no second colon: it names nothing, though it has its place."""
    return _settings_files(table(s, d, "orders"), F.floor(F.col("o_orderkey") / 500), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(":n"))


def _settings_all(s, d):
    """All orders, in files of up to 1000 lines: their number grows with the table."""
    return _settings_files(table(s, d, "orders"), F.floor(F.col("o_orderkey") / 1000))


def _world_of(side, number):
    """Six worlds of each side, of which four have the same name."""
    return F.concat(F.lit("w"), (number % 6 + F.when(side == "A", 0).otherwise(2)).cast("string"))


def _archive(s, d, name):
    """One side of two archives made of the tables: regions and tiles of orders, files of customers, highlights of items."""
    k, c, side = F.col("o_orderkey"), F.col("o_custkey"), F.lit(name)
    orders = table(s, d, "orders").where(F.floor(k / 97) % 2 == (0 if name == "A" else 1))
    regions = orders.select(
        _world_of(side, c).alias("world"), F.when(k % 3 == 0, "DIM-1").otherwise("null" if name == "A" else "DIM0").alias("dim"), F.lit("mw$default").alias("mw"), F.when(c % 4 == 0, 3).alias("cave"),
        (c % 200).cast("int").alias("rx"), (k % 50).cast("int").alias("rz"), epoch_ms("o_orderdate").alias("mtime_ms"), F.floor("o_totalprice").cast("long").alias("size"), (k % 2 == 0).alias("is_zip"), k.alias("ord"),
    )
    place = ["world", "dim", "mw", "cave", "rx", "rz"]
    tiles = regions.groupBy(*place, (F.col("ord") % 4).alias("tx"), (F.floor(F.col("ord") / 4) % 4).alias("tz")).agg(F.max("ord").alias("value"))
    bad = F.col("size") % 13 == 0
    n = F.col("c_custkey")
    customers = table(s, d, "customer").where(n % 2 == (0 if name == "A" else 1))
    files = customers.groupBy(_world_of(side, n).alias("world"), F.concat(F.lit("f"), (F.floor(n / 4) % 50).cast("string")).alias("path")).agg(F.max(n).alias("mtime_ms"), F.count("*").alias("size"))
    path = F.concat(F.lit("d"), (F.floor(k / 500)).cast("string"))
    line = F.when(c % 3 == 0, F.concat(F.lit("MWName:mw"), (c % 13).cast("string"), F.lit(":n"))).otherwise(F.concat(F.lit("note "), c.cast("string")))
    settings = orders.select(_world_of(side, F.floor(k / 500)).alias("world"), path.alias("path"), F.lit(5).cast("long").alias("mtime_ms"), k.alias("ord"), line.alias("line"))
    points = customers.select(_world_of(side, n).alias("world"), F.concat(F.lit("p"), (F.floor(n / 50)).cast("string")).alias("path"), F.lit(5).cast("long").alias("mtime_ms"), n.alias("ord"), F.concat(F.lit("note "), (n % 9).cast("string")).alias("line"))
    h = highlights(s, d).where(F.col("side") == name)
    spots = h.select(_world_of(side, F.floor(F.col("ord") / 10)).alias("world"), F.concat(F.lit("h"), (F.col("src") % 2).cast("string"), F.lit(".db")).alias("path"), F.lit(7 if name == "A" else 9).cast("long").alias("mtime_ms"), "dim", "x", "z", "found_time")
    return Archive(f"archive://{name}", regions, tiles, bad, files, settings, points, spots)


def _run(s, d):
    """The whole merge, and once more: the second run makes nothing and reads what the first one wrote."""
    a, b, out = _archive(s, d, "A"), _archive(s, d, "B"), shared_folder(s)
    MergeRun(s, a, b, out, Options(apply=True)).run()
    again = MergeRun(s, a, b, out, Options(apply=True, resume=True))
    report = again.run()
    if again.made:
        raise AssertionError(f"made again: {again.made}")
    return report


def _run_tiles(s, d):
    """Tiles that a dry run says would be written."""
    dry = MergeRun(s, _archive(s, d, "A"), _archive(s, d, "B"), "archive://out", scratch=shared_folder(s))
    dry.run()
    t = dry.rows("tiles")
    return t.select("layer.world", "layer.key", F.col("layer.cave").alias("cave"), "rx", "rz", "tx", "tz", "value", "from_side")


QUERIES = {
    "merge_run_report": _run,
    "merge_run_tiles": _run_tiles,
    "merge_plan": lambda s, d: _plan(s, d).drop("a_ms", "b_ms"),
    "merge_tiles": lambda s, d: _tiles(s, d)[0],
    "merge_tile_regions": lambda s, d: _tiles(s, d)[1].withColumns({"mtime_ms": F.coalesce("mtime_ms", F.lit(-1)), "note": F.coalesce("note", F.lit("-"))}),
    "merge_mixed_units": _mixed,
    "merge_meaning": _meaning,
    "merge_world_pairs_auto": lambda s, d: _worlds(s, d, True),
    "merge_plan_report": lambda s, d: M.plan_report(_plan(s, d)),
    "merge_settings": _settings,
    "merge_settings_all": _settings_all,
    "merge_settings_loose": _settings_loose,
    "merge_world_pairs": _worlds,
}

_PLAN = "p: select layer, rx, rz, case when b.size is null then 'copy_a' when a.size is null then 'copy_b' else 'merge' end as action, case when a.size is null or b.mtime_ms > a.mtime_ms then 'b' else 'a' end as \"primary\", greatest(a.mtime_ms, b.mtime_ms) mtime_ms, coalesce(a.size, 0) + coalesce(b.size, 0) bytes from a full join b using (layer, rx, rz)"
def _settings_sql(lines, loose="false"):
    return with_views(
        "select file, row_number() over (partition by file order by aft, late, ord) - 1 ord, line from (select file, ord aft, 0 late, ord, line from t where own union all select * from ad)",
        f"l: select o_orderkey // {lines} file, case when o_orderkey // 40 % 2 = 0 then 'A' else 'B' end side, o_orderkey ord, case when o_custkey % 3 = 0 then 'MWName:mw' || o_custkey % 13 || case when {loose} then '' else ':n' end else 'note ' || o_custkey end line, case when o_custkey % 3 = 0 and not {loose} then 'mw' || o_custkey % 13 end id from orders",
        *_MERGED,
    )


_MERGED = [
    "sides: select file, case when bool_or(side = 'B') and (file % 3 > 0 or not bool_or(side = 'A')) then 'B' else 'A' end own_side from l group by file",
    "t: select l.*, side = own_side own from l join sides using (file)",
    "known: select file, id, max(ord) ord from t where own and id is not null group by 1, 2",
    "lasts: select file, max(ord) aft from t where own and starts_with(line, 'MWName:') group by 1",
    "ad: select file, coalesce(aft, -1) aft, 1 late, t.ord, line from t left join lasts using (file) left join known using (file, id) where not own and id is not null and known.ord is null",
]
_WORLD = "case when ({0}) % 3 = 0 then 'Multiplayer_' else '' end || 'Play' || ({0}) // 4 || list_extract(['', '.net', '.com', '.org.net'], ({0}) % 4 + 1)"
_CW = f"w: select c_custkey % 5 k, {_WORLD.format('c_custkey')} world from customer"
_SERVER = "lower(regexp_replace(regexp_replace(regexp_replace(replace({0}, 'Multiplayer_', ''), '(\\.org)+$', ''), '(\\.net)+$', ''), '(\\.com)+$', ''))"
_CLAIMS = [
    _CW, "a: select distinct world world_a from w where k <= 2", "b: select distinct world world_b from w where k >= 2", "e: select world_a, world_b from a join b on world_a = world_b",
    f"al: select {_WORLD.format('c_custkey')} x, {_WORLD.format('c_custkey + c_custkey % 4 + 1')} y from customer where c_custkey % 7 = 0", "al0: select x world_a, y world_b from al union select y, x from al",
    "al1: select world_a, min(world_b) world_b from al0 where world_a in (select world_a from a) and world_b in (select world_b from b) and world_a not in (select world_a from e) group by 1",
    "al2: select *, min(world_a) over (partition by world_b) f from al1 where world_b not in (select world_b from e)",
    "bl1: select x.world_a, x.world_b, 'blocked' how, e.world_a taken_by from al1 x join e using (world_b) union all select world_a, world_b, 'blocked', f from al2 where world_a <> f",
    "p2: select world_a, world_b, 'exact' how, '-' taken_by from e union all select world_a, world_b, 'alias', '-' from al2 where world_a = f",
    f"dm: select world_a, min(world_b) world_b from (select world_a, {_SERVER.format('world_a')} srv from a where world_a not in (select world_a from p2)) x join (select world_b, {_SERVER.format('world_b')} srv from b) y using (srv) where world_a <> world_b group by 1",
]
_TILED = [
    "idx", _A, _B,
    "pl: select *, action = 'merge' and asz % 13 = 0 ba, action = 'merge' and bsz % 13 = 0 bb from (select layer, rx, rz, a.mtime_ms am, b.mtime_ms bm, a.size asz, b.size bsz, case when b.size is null then 'copy_a' when a.size is null then 'copy_b' else 'merge' end as action, case when a.size is null or b.mtime_ms > a.mtime_ms then 'b' else 'a' end pri from a full join b using (layer, rx, rz))",
    "ti: select * from (select lower(side) from_side, layer, rx, rz, ord % 4 tx, ord // 4 % 4 tz, size, ord, row_number() over (partition by side, layer, rx, rz, ord % 4, ord // 4 % 4 order by ord desc) n from idx) where n = 1",
    "mt: select * from (select ti.*, row_number() over (partition by layer, rx, rz, tx, tz order by from_side = pri desc) best from ti join pl using (layer, rx, rz) where not (from_side = 'a' and ba or from_side = 'b' and bb)) where best = 1",
]
_SIDE_WORLD = "'w' || (({0}) % 6 + case when side = 'A' then 0 else 2 end)"
_RUN = [
    f"rg: select *, {_SIDE_WORLD.format('c')} world, case when k % 3 = 0 then 'minecraft:the_nether' else 'minecraft:overworld' end as key, case when c % 4 = 0 then '3' else 'surface' end cave from (select o_orderkey k, o_custkey c, case when o_orderkey // 97 % 2 = 0 then 'A' else 'B' end side, o_custkey % 200 rx, o_orderkey % 50 rz, epoch_ms(o_orderdate) mtime_ms, cast(floor(o_totalprice) as bigint) size from orders)",
    "bf: select * from (select *, row_number() over (partition by side, world, key, cave, rx, rz order by k % 2 = 0 desc, mtime_ms desc, k) n from rg) where n = 1",
    "pn: select world, key, cave, rx, rz, a.mtime_ms am, b.mtime_ms bm, a.size asz, b.size bsz, a.size is not null and b.size is not null both_, coalesce(a.size % 13 = 0, false) and b.size is not null ba, coalesce(b.size % 13 = 0, false) and a.size is not null bb, case when a.size is null or b.mtime_ms > a.mtime_ms then 'b' else 'a' end pri from (select * from bf where side = 'A') a full join (select * from bf where side = 'B') b using (world, key, cave, rx, rz)",
    "ti2: select lower(side) from_side, world, key, cave, rx, rz, k % 4 tx, k // 4 % 4 tz, max(k) as value from rg group by all",
    "mt2: select * from (select t.*, row_number() over (partition by world, key, cave, rx, rz, tx, tz order by from_side = pri desc) best from ti2 t join pn using (world, key, cave, rx, rz) where not (from_side = 'a' and ba or from_side = 'b' and bb)) where best = 1",
]
_RUN_REST = [
    f"hs: select distinct side, {_SIDE_WORLD.format('ord // 10')} world, 'h' || src % 2 || '.db' path, dim, x, z from hl",
    "hb: select world, path, dim, x, z, bool_or(side = 'B') d, bool_or(side = 'A') s from hs where (world, path) in (select (world, path) from hs group by world, path having count(distinct side) = 2) group by 1, 2, 3, 4, 5",
    "dbr: select world, path, dim, count(*) filter (s) source_rows, count(*) filter (d) dest_before, count(*) filter (s and d) overlap, count(*) dest_after from hb group by 1, 2, 3",
    "lay: select world, key || '/mw$default/' || cave item, count(*) filter (bsz is null) only_a, count(*) filter (asz is null) only_b, count(*) filter (both_) conflicts, count(*) regions_out, cast(sum(coalesce(asz, 0) + coalesce(bsz, 0)) as bigint) bytes from pn group by 1, 2",
    f"cu: select c_custkey n, case when c_custkey % 2 = 0 then 'A' else 'B' end side, {_SIDE_WORLD.format('c_custkey')} world from (select *, case when c_custkey % 2 = 0 then 'A' else 'B' end side from customer)",
    "ws: select side, world from rg union select side, world from cu",
]
_EACH = "select '{0}' as section, world, {1} item, '{2}' as name, cast({2} as bigint) n from {3}"
_REPORT = " union all ".join([
    "select 'world' as section, world, case when count(*) = 2 then world else '-' end item, case when count(*) = 2 then 'exact' when min(side) = 'A' then 'only a' else 'only b' end as name, cast(1 as bigint) n from ws group by world",
    *(_EACH.format("layer", "item", c, "lay") for c in ("only_a", "only_b", "conflicts", "regions_out", "bytes")),
    "select 'note' as section, world, key || '/mw$default/' || cave || '/' || rx || '/' || rz item, case when ba and bb then 'both unreadable' when ba then 'a unreadable, copied b' else 'b unreadable, copied a' end as name, cast(1 as bigint) n from pn where ba or bb",
    *(_EACH.format("database", "path || '/' || dim", c, "dbr") for c in ("source_rows", "dest_before", "overlap", "dest_after")),
    "select 'files' as section, world, '-' item, 'files' as name, count(distinct n // 4 % 50) n from cu group by world",
    "select 'files' as section, world, '-' item, 'waypoints' as name, count(distinct n // 50) n from cu group by world",
    f"select 'files' as section, {_SIDE_WORLD.format('k // 500')} world, '-' item, 'settings' as name, count(distinct k // 500) n from rg group by 2",
])
ORACLES = {
    "merge_run_report": with_views(_REPORT, "hl", *_RUN, *_RUN_REST),
    "merge_run_tiles": with_views("select world, key, cave, rx, rz, tx, tz, value, from_side from mt2", *_RUN),
    "merge_plan": with_views("select * from p", "idx", _A, _B, _PLAN),
    "merge_plan_report": with_views("select layer, count(*) filter (action = 'copy_a') only_a, count(*) filter (action = 'copy_b') only_b, count(*) filter (action = 'merge') conflicts, count(*) regions_out, cast(sum(bytes) as bigint) bytes from p group by layer", "idx", _A, _B, _PLAN),
    "merge_settings": _settings_sql(500),
    "merge_settings_all": _settings_sql(1000),
    "merge_settings_loose": _settings_sql(500, "o_orderkey % 7 = 0"),
    "merge_world_pairs": with_views("select world_a, world_b, how, taken_by from p2 union all select * from bl1 union all select x.world_a, x.world_b, 'blocked', p2.world_a from dm x join p2 using (world_b) union all select world_a, world_b, 'suggested', '-' from dm where world_b not in (select world_b from p2)", *_CLAIMS),
    "merge_world_pairs_auto": with_views("select world_a, world_b, how, taken_by from p2 union all select * from bl1 union all select x.world_a, x.world_b, 'blocked', p2.world_a from dm x join p2 using (world_b) union all select world_a, world_b, case when world_a = f then 'domain' else 'blocked' end, case when world_a = f then '-' else f end from (select *, min(world_a) over (partition by world_b) f from dm where world_b not in (select world_b from p2))", *_CLAIMS),
    "merge_tiles": with_views("select layer, rx, rz, tx, tz, size, ord, from_side from mt", *_TILED),
    "merge_tile_regions": with_views("select layer, rx, rz, any_value(action) as action, any_value(case when ba and bb then -1 when ba then bm when bb then am else greatest(am, bm) end) mtime_ms, count(mt.tx) tiles, count(mt.tx) filter (from_side = 'b') from_b, any_value(case when ba and bb then 'both unreadable' when ba then 'a unreadable, copied b' when bb then 'b unreadable, copied a' else '-' end) note from pl left join mt using (layer, rx, rz) group by layer, rx, rz", *_TILED),
    "merge_mixed_units": "select case when o_orderkey % 2 = 0 then 'A' else 'B' end side, 'w' || o_custkey world, 'mw$default' mw, o_orderkey % 2 layer from orders where o_orderkey % 3 < 2 group by 1, 2, 3, 4 having count(distinct o_orderkey % 3) = 2",
    "merge_meaning": "select p_partkey // 4 as merge, case when bool_or(p_partkey % 11 = 0) then 'height' else 'timestamp' end meaning from part group by 1",
}
