"""Queries on catalogues, drawings, places, colours and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilelake.operators import catalog as C
from tilelake.operators import index as I
from tilelake.plans.index_queries import _ALL, _all
from tilelake.plans.views import highlights, table, with_views


def _pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


FOLDERS, MULTI = ("null", "DIM-1", "minecraft$x%y", "cache", "DIM0"), ("mw$default", "mw1,-2,3", "caves")
SUFFIXES, BLOCKS = ("", "_stairs", "_slab", "_leaves", "_ore", "_door"), ("stone", "oak", "brick", "odd", "water_x", "pine")


def _paths(s, d):
    k = F.col("o_orderkey")
    name = F.concat((k % 20).cast("string"), F.lit("_-"), (k % 7).cast("string"), _pick((".zip", ".xaero", ".zip.tmp"), k))
    cave = F.when(k % 4 == 1, F.concat(F.lit("caves/"), (k % 5 - 2).cast("string"), F.lit("/"))).when(k % 4 == 2, F.lit("caves/x/")).otherwise("")
    return table(s, d, "orders").select(F.concat(F.lit("w"), (k % 3).cast("string"), F.lit("/"), _pick(FOLDERS, k), F.lit("/"), _pick(MULTI, k), F.lit("/"), cave, name).alias("path"), F.floor("o_totalprice").cast("bigint").alias("size"))


def _drawings(s, d, side):
    return highlights(s, d).where(F.col("side") == side).groupBy("dim", "x", "z").agg(F.max("height").alias("color"))


def _colours(s, d):
    p = F.col("p_partkey")
    blocks = table(s, d, "part").select(F.concat(F.lit("minecraft:"), _pick(BLOCKS, p), _pick(SUFFIXES, F.floor(p / 6))).alias("name"))
    known = s.range(6).select(F.concat(F.lit("minecraft:"), _pick(("stone", "oak_planks", "brick_block", "oak_leaves", "water", "sand"), F.col("id"))).alias("name"), (F.col("id") + 1).alias("rgba"))
    aliases = s.createDataFrame([("minecraft:odd", "minecraft:sand")], "name string, target string")
    return C.colours(blocks, known, aliases)


def _states(s, d):
    p = F.create_map(F.lit("z"), F.col("p_size").cast("string"), F.lit("a"), F.col("p_brand"))
    return table(s, d, "part").select("p_partkey", C.canonical_state(F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, F.expr("map_filter(map('a', ''), (k, v) -> false)")).otherwise(p)).alias("state"))


def _bits(s, d):
    rows = table(s, d, "customer").select("c_custkey", F.encode(F.substring("c_name", 1, 8), "UTF-8").alias("bits"), F.lit(8).alias("side"), (F.col("c_custkey") % 8).cast("int").alias("ix"), (F.floor(F.col("c_custkey") / 8) % 8).cast("int").alias("iy"))
    return C.in_bitset(rows).select("c_custkey", "set")


def _boxes(s, d):
    boxes = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("layer"), (F.col("s_suppkey") % 5 + 1).cast("string")).alias("layer"), (F.col("s_suppkey") * 611 - 30000).alias("x1"), (F.col("s_nationkey") * 900 - 9000).cast("bigint").alias("z1"), (F.col("s_nationkey") * 333 - 4000).cast("bigint").alias("x2"), (F.col("s_suppkey") * 77 - 3000).alias("z2"))
    return C.region_box(boxes, I.bounds(_all(s, d)))


def _resolved(s, d):
    """States of parts: a table of those with even keys, properties as written in any order, and what all parts resolve to."""
    p = F.col("p_partkey")
    part = table(s, d, "part")
    odd = F.map_from_arrays(F.array(F.lit("waterlogged"), F.lit("facing")), F.array(F.when(p % 2 == 0, "true").otherwise("false"), (p % 4).cast("string")))
    block = F.concat(F.lit("minecraft:b"), (F.floor(p / 4) % 5000).cast("string"))
    name = F.concat(block, F.lit("[waterlogged="), F.when(p % 2 == 0, "true").otherwise("false"), F.lit(",facing="), (p % 4).cast("string"), F.lit("]"))
    known = part.where("p_partkey % 3 > 0 and p_partkey < 20000").select((p + 1).alias("id"), name.alias("name"))
    table_ = C.state_table(known.union(s.createDataFrame([(0, "minecraft:air")], "id long, name string")))
    return C.state_ids(part.select("p_partkey", block.alias("block"), odd.alias("properties")), table_)


def _segments(s, d):
    """A segment and a window for each order, whole numbers, some along the window's sides or points."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return C.clipped(table(s, d, "orders").select(k.alias("o_orderkey"), (k * 7 % 41 - 20).alias("ax"), (c * 5 % 37 - 18).alias("az"), (k * 3 % 29 - 14).alias("bx"), (c * 11 % 43 - 21).alias("bz"), (k % 13 - 12).alias("x0"), (c % 9 - 10).alias("z0"), (k % 11).alias("x1"), (c % 7 + 1).alias("z1")))


def _guides(s, d):
    k = F.col("c_custkey")
    return C.guides(table(s, d, "customer").select("c_custkey", (k * 97 % 7000 - 4000).alias("x0"), (k * 31 % 5000 - 3000).alias("z0"), (k * 97 % 7000 - 4000 + 1500).alias("x1"), (k * 31 % 5000 - 3000 + 1000).alias("z1"), F.lit(2500).cast("bigint").alias("limit")))


_ENDS = ("ax", "az", "bx", "bz")
def _tables(s, d, side):
    """Drawings of one side as three tables: keyed, without a key, and one that only side B has; side A's has a column more."""
    h = highlights(s, d).where(F.col("side") == side)
    spots = h.groupBy("dim", "x", "z").agg(F.max("height").alias("color"))
    notes = h.where("ord % 50 = 0").select("dim", "x", "z")
    out = {"spots": spots.withColumn("seen", F.lit(1)) if side == "A" else spots, "notes": notes}
    return out if side == "A" else out | {"rings": h.groupBy("dim", "x").agg(F.count("*").alias("radius"))}


def _merged_tables(s, d):
    return C.merge_drawing_tables(_tables(s, d, "A"), _tables(s, d, "B"), {"spots": ["dim", "x", "z"], "rings": ["dim", "x"]})


def _biomes(s, d):
    names = table(s, d, "part").select(F.concat(F.lit("minecraft:"), F.element_at(F.split("p_type", " "), 1), (F.col("p_size") % 9).cast("string")).alias("name"))
    known = table(s, d, "part").where("p_size % 9 < 5").select(F.concat(F.lit("minecraft:"), F.element_at(F.split("p_type", " "), 1), (F.col("p_size") % 9).cast("string")).alias("name")).distinct()
    plains = s.createDataFrame([("minecraft:plains", 7, 8)], "name string, grass long, water long")
    return C.biome_colours(names, plains.union(known.select("name", F.length("name").cast("long"), F.length("name").cast("long") + 1)))


QUERIES = {
    "drawing_tables": lambda s, d: _merged_tables(s, d)[1],
    "drawing_tables_spots": lambda s, d: _merged_tables(s, d)[0]["spots"].select("dim", "x", "z", "color", F.coalesce("seen", F.lit(0)).alias("seen")),
    "drawing_window": lambda s, d: C.drawings_in_window(_drawings(s, d, "A"), "minecraft:the_end", -20, 31, -45, 12),
    "biome_colours": _biomes,
    "state_ids": lambda s, d: _resolved(s, d).select("p_partkey", "key", "id", "known"),
    "state_unknown": lambda s, d: C.unknown_states(_resolved(s, d)),
    "segments_clipped": lambda s, d: _segments(s, d).select("o_orderkey", *(F.round(F.col(c) + 0.0, 6).alias(c) for c in _ENDS)),
    "guide_lines": lambda s, d: _guides(s, d).select("c_custkey", "line", "kind", *(F.round(F.col(c) + 0.0, 3).alias(c) for c in _ENDS)),
    "catalog_layers": lambda s, d: C.layers(_paths(s, d)),
    "catalog_select_worlds": lambda s, d: C.select_worlds(C.layers(_paths(s, d)).select("world").distinct(), "w1"),
    "drawing_merge": lambda s, d: C.merge_drawings(_drawings(s, d, "A"), _drawings(s, d, "B"), C.DRAWING_KEYS["highlights"]),
    "place_filter": lambda s, d: C.places_in_view(table(s, d, "part").select(F.col("p_name").alias("name"), F.lower("p_type").alias("tags"), (F.col("p_size") % 3 - 1).cast("double").alias("dimension"), F.col("p_retailprice").alias("x"), F.col("p_partkey").cast("double").alias("z")), 0, "RING", 900, 0, 1000, 500),
    "block_colours": _colours,
    "block_states": _states,
    "pyramid_levels": lambda s, d: C.pyramid_levels(table(s, d, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("dataset"), F.lit(0).alias("z_min"), ((F.col("p_partkey") % 25).cast("int") % 5 + 1).alias("z_max"), ((F.col("p_partkey") % 25).cast("int") * 7 + 3).alias("rows"), ((F.col("p_partkey") % 25).cast("int") + 1).alias("cols"))),
    "guide_diagonals": lambda s, d: C.diagonal_in_view(table(s, d, "customer").select("c_custkey", (F.col("c_custkey") * 100 - 90000).alias("x0"), (F.col("c_nationkey") * 3000 - 30000).cast("bigint").alias("z0"), (F.col("c_custkey") * 100 - 70000).alias("x1"), (F.col("c_nationkey") * 3000 - 10000).cast("bigint").alias("z1")), 30_000_000, -1).select("c_custkey", "lo", "hi"),
    "region_box": _boxes,
    "bitset_cells": _bits,
}

_q = lambda values: ", ".join(f"'{v}'" for v in values)
_PATHS = f"pa: select 'w' || k % 3 world, list_extract([{_q(FOLDERS)}], k % 5 + 1) folder, list_extract([{_q(MULTI)}], k % 3 + 1) mw, k, k % 3 ext, cast(floor(o_totalprice) as bigint) size from (select o_orderkey k, o_totalprice from orders)"
_LAYERS = "la: select world, folder, case when folder in ('null', 'DIM0') then 'minecraft:overworld' when folder = 'DIM-1' then 'minecraft:the_nether' else 'minecraft:x/y' end dim, mw, case when k % 4 = 1 then cast(k % 5 - 2 as varchar) else 'surface' end layer, count(*) files, cast(sum(size) as bigint) bytes from pa where ext < 2 and mw <> 'caves' and folder <> 'cache' and k % 4 <> 2 group by all"
_CASE_KIND = "case when name like '%\\_leaves' escape '\\' then 4 when name like '%\\_ore' escape '\\' or name like '%stone' then 1 when contains(name, 'water') then 5 end"
_ST = "st: select p_partkey, 'minecraft:b' || p_partkey // 4 % 5000 || '[facing=' || p_partkey % 4 || ',waterlogged=' || (p_partkey % 2 = 0) || ']' as key, from part"
_KNOWN = "kn: select key, p_partkey + 1 id from st where p_partkey % 3 > 0 and p_partkey < 20000"
_SEG = [
    "sg: select o_orderkey, (o_orderkey * 7 % 41 - 20)::double ax, (o_custkey * 5 % 37 - 18)::double az, (o_orderkey * 3 % 29 - 14)::double bx, (o_custkey * 11 % 43 - 21)::double bz, o_orderkey % 13 - 12 x0, o_custkey % 9 - 10 z0, o_orderkey % 11 x1, o_custkey % 7 + 1 z1 from orders",
    "cl: select *, greatest(0, case when bx < ax then (x1 - ax) / (bx - ax) when bx > ax then (x0 - ax) / (bx - ax) else 0 end, case when bz < az then (z1 - az) / (bz - az) when bz > az then (z0 - az) / (bz - az) else 0 end) t0, least(1, case when bx < ax then (x0 - ax) / (bx - ax) when bx > ax then (x1 - ax) / (bx - ax) else 1 end, case when bz < az then (z0 - az) / (bz - az) when bz > az then (z1 - az) / (bz - az) else 1 end) t1 from sg where (ax <> bx or ax between x0 and x1) and (az <> bz or az between z0 and z1)",
]
_VIEW = "vw: select c_custkey, greatest(x0, -2500) a, least(x0 + 1500, 2500) b, greatest(z0, -2500) c, least(z0 + 1000, 2500) d, x0, z0, x0 + 1500 x1, z0 + 1000 z1 from (select c_custkey, c_custkey * 97 % 7000 - 4000 x0, c_custkey * 31 % 5000 - 3000 z0 from customer)"
_LINES = " union all ".join([
    *(f"select c_custkey, {i} line, '{k}' kind, a::double ax, {z}::double az, b::double bx, {z}::double bz from vw where a <= b and {z} between z0 and z1" for i, k, z in ((0, "border", -2500), (1, "border", 2500), (4, "axis", 0))),
    *(f"select c_custkey, {i} line, '{k}' kind, {x}::double ax, c::double az, {x}::double bx, d::double bz from vw where c <= d and {x} between x0 and x1" for i, k, x in ((2, "border", -2500), (3, "border", 2500), (5, "axis", 0))),
    "select c_custkey, 6 line, 'diagonal' kind, greatest(a, c)::double ax, greatest(a, c)::double az, least(b, d)::double bx, least(b, d)::double bz from vw where greatest(a, c) <= least(b, d)",
    "select c_custkey, 7 line, 'diagonal' kind, greatest(a, -d)::double ax, -greatest(a, -d)::double az, least(b, -c)::double bx, -least(b, -c)::double bz from vw where greatest(a, -d) <= least(b, -c)",
])
_SPOTS = [f"s{x}: select dim, x, z, max(height) color from hl where side = '{x}' group by 1, 2, 3" for x in "AB"]
_RINGS = "rg: select distinct dim, x from hl where side = 'B'"
ORACLES = {
    "drawing_tables": with_views("select 'spots' as name, (select count(*) from sB) source_rows, (select count(*) from sA) dest_before, (select count(*) from sA join sB using (dim, x, z)) overlap, (select count(*) from sA full join sB using (dim, x, z)) dest_after union all select 'notes', b, a, 0, a + b from (select count(*) filter (side = 'A') a, count(*) filter (side = 'B') b from hl where ord % 50 = 0) union all select 'rings', n, 0, 0, n from (select count(*) n from rg)", "hl", *_SPOTS, _RINGS),
    "drawing_tables_spots": with_views("select dim, x, z, coalesce(sA.color, sB.color) color, cast(sA.color is not null as int) seen from sA full join sB using (dim, x, z)", "hl", *_SPOTS),
    "drawing_window": with_views("select * from sA where dim = 'minecraft:the_end' and x >= -20 and x < 31 and z >= -45 and z < 12", "hl", *_SPOTS),
    "biome_colours": "select name, case when known then length(name) else 7 end grass, known, case when known then length(name) + 1 else 8 end water from (select 'minecraft:' || split_part(p_type, ' ', 1) || p_size % 9 as name, bool_or(p_size % 9 < 5) known from part group by 1)",
    "state_ids": with_views("select p_partkey, key, coalesce(id, 0) id, id is not null known from st left join kn using (key)", _ST, _KNOWN),
    "state_unknown": with_views("select key, count(*) n from st left join kn using (key) where id is null group by key", _ST, _KNOWN),
    "segments_clipped": with_views("select o_orderkey, round(ax + t0 * (bx - ax), 6) + 0.0::double ax, round(az + t0 * (bz - az), 6) + 0.0::double az, round(ax + t1 * (bx - ax), 6) + 0.0::double bx, round(az + t1 * (bz - az), 6) + 0.0::double bz from cl where t0 <= t1", *_SEG),
    "guide_lines": with_views(f"select c_custkey, line, kind, ax + 0.0 ax, az + 0.0 az, bx + 0.0 bx, bz + 0.0 bz from ({_LINES})", _VIEW),
    "catalog_layers": with_views("select * from la", _PATHS, _LAYERS),
    "catalog_select_worlds": with_views("select distinct world from la where world = 'w1'", _PATHS, _LAYERS),
    "drawing_merge": with_views("select dim, x, z, coalesce(a.color, b.color) color, a.color is null added from a full join b using (dim, x, z)", "hl", "a: select dim, x, z, max(height) color from hl where side = 'A' group by all", "b: select dim, x, z, max(height) color from hl where side = 'B' group by all"),
    "place_filter": "select p_name as name, lower(p_type) tags, 0.0::double dimension, p_retailprice x, p_partkey::double z, p_retailprice between 900 and 1000 and p_partkey between 0 and 500 shown from part where p_size % 3 = 1 and (contains(p_name, 'ring') or contains(lower(p_type), 'ring'))",
    "block_colours": with_views(f"select name, coalesce(min(rgba), 2139062271) rgba, coalesce(min(rank), 5) = 5 missing from (select b.name, first(c.rgba order by c.rank) rgba, min(c.rank) rank from b left join c using (name) group by b.name) group by name",
        f"b: select distinct 'minecraft:' || list_extract([{_q(BLOCKS)}], p_partkey % 6 + 1) || list_extract([{_q(SUFFIXES)}], p_partkey // 6 % 6 + 1) as name from part",
        "t: select * from (values ('minecraft:stone', 1::bigint), ('minecraft:oak_planks', 2::bigint), ('minecraft:brick_block', 3::bigint), ('minecraft:oak_leaves', 4::bigint), ('minecraft:water', 5::bigint), ('minecraft:sand', 6::bigint)) v(name, rgba)",
        f"c: select b.name, t.rgba, 0 rank from b join t on t.name = b.name union all select name, 6, 1 from b where name = 'minecraft:odd' union all select b.name, t.rgba, 2 + r from (select *, regexp_extract(name, '(_stairs|_slab|_door)$', 1) suf from b) b, (values (0, ''), (1, '_planks'), (2, '_block')) e(r, s), t where suf <> '' and t.name = substr(b.name, 1, length(b.name) - length(suf)) || s union all select name, {_CASE_KIND}, 5 from b where {_CASE_KIND} is not null"),
    "block_states": "select p_partkey, case when p_partkey % 3 = 0 then p_type else p_type || '[a=' || p_brand || ',z=' || p_size || ']' end state from part",
    "pyramid_levels": 'select dataset, z, cast(ceil(r / 2.0::double ** (zm - z)) as bigint) as "rows", cast(ceil(c / 2.0::double ** (zm - z)) as bigint) cols, cast(ceil(r / 2.0::double ** (zm - z)) as bigint) * cast(ceil(c / 2.0::double ** (zm - z)) as bigint) tiles from (select concat(chr(100), p_partkey) dataset, (p_partkey % 25) % 5 + 1 zm, (p_partkey % 25) * 7 + 3 r, (p_partkey % 25) + 1 c, unnest(cast(range((p_partkey % 25) % 5 + 2) as int[])) z from part)',
    "guide_diagonals": "select * from (select c_custkey, greatest(c_custkey * 100 - 90000, -(c_nationkey * 3000 - 10000)::bigint, -30000000) lo, least(c_custkey * 100 - 70000, -(c_nationkey * 3000 - 30000)::bigint, 30000000) hi from customer) where lo <= hi",
    "region_box": with_views("select * from (select id, layer, greatest(cast(floor(least(x1, x2) / 512.0) as bigint), rx0) rx0, greatest(cast(floor(least(z1, z2) / 512.0) as bigint), rz0) rz0, least(cast(floor(greatest(x1, x2) / 512.0) as bigint), rx1) rx1, least(cast(floor(greatest(z1, z2) / 512.0) as bigint), rz1) rz1 from bx join (select layer, min(rx) rx0, min(rz) rz0, max(rx) rx1, max(rz) rz1 from f group by layer) using (layer)) where rx0 <= rx1 and rz0 <= rz1", "idx", _ALL, "bx: select s_suppkey id, 'layer' || s_suppkey % 5 + 1 layer, s_suppkey * 611 - 30000 x1, s_nationkey * 900 - 9000 z1, s_nationkey * 333 - 4000 x2, s_suppkey * 77 - 3000 z2 from supplier".replace("'layer' || s_suppkey % 5 + 1 layer", "'layer' || cast(s_suppkey % 5 + 1 as varchar) layer")),
    "bitset_cells": "select c_custkey, (ascii(substr(c_name, (c_custkey // 8 % 8 + 1)::bigint, 1)) >> cast(7 - c_custkey % 8 as int)) & 1 = 1 as set from customer",
}
