"""Queries on pixels, tiles and level-of-detail cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilelake.operators import tiles as T
from tilelake.plans.views import cells, highlights, pixels, table, with_views


def _heights(s, d):
    return pixels(s, d).where("(px + 3 * pz) % 11 <> 0").select("region", "px", "pz", F.col("r").alias("h"))


def _tiles(s, d, side):
    h = highlights(s, d).where(F.col("side") == side)
    return T.last_wins(h.select("dim", "x", "z", "ord", "height", "found_time"), ["dim", "x", "z"], "ord")


def _cells(s, d):
    return cells(s, d).groupBy("vec_id", F.floor(F.col("cx") / 2).alias("cx"), F.floor(F.col("cz") / 2).alias("cz")).agg(F.expr("sum(v) div 4").alias("v"), F.count("*").alias("n"))


def _pictures(s, d):
    """Regions whose number grows with the table, their whole pictures of 64 x 64, and smaller ones that some have, some of
    them of an earlier time."""
    v = table(s, d, "lineitem").select(
        F.lit("surface").alias("layer"), F.floor(F.col("l_orderkey") / 4096).cast("int").alias("rx"), (F.col("l_suppkey") % 4).cast("int").alias("rz"), F.lit(7).cast("bigint").alias("mtime_ms"),
        (F.floor(F.col("l_orderkey") / 64) % 64).alias("px"), (F.col("l_partkey") % 64).alias("pz"), (F.col("l_quantity") * 5).cast("bigint").alias("r"), F.round(F.col("l_discount") * 2000).cast("bigint").alias("g"), F.round(F.col("l_tax") * 3000).cast("bigint").alias("b"), (F.col("l_linenumber").cast("bigint") * 36).alias("a"),
    )
    keys = ["layer", "rx", "rz"]
    full = v.groupBy(*keys, "mtime_ms", "px", "pz").agg(*(F.max(c).alias(c) for c in "rgba"))
    at = [*keys, "mtime_ms"]
    mips = T.shrunk(full.where("(rx + rz) % 3 < 2"), 8, at).withColumn("mtime_ms", F.expr("if((rx + rz) % 3 = 1 and rz > 1, 6, 7)").cast("bigint"))
    thumbs = T.shrunk(full.where("rx % 2 = 0"), 2, at).withColumn("mtime_ms", F.expr("if(rz = 3, 6, 7)").cast("bigint"))
    return full.select(*keys, "mtime_ms").distinct(), {"mip": mips, "thumb": thumbs, "full": full}


def _from_tiers(zoom):
    def query(s, d):
        return T.tile_from_tiers(*_pictures(s, d), zoom, {"mip": 8, "thumb": 32, "full": 64}, tile=64)

    return query


QUERIES = {
    "tile_from_tiers": _from_tiers(-4),
    "tile_from_tiers_near": _from_tiers(-2),
    "pixel_box_downscale": lambda s, d: T.box_downscale(pixels(s, d), 4),
    "pixel_sub_pixel": lambda s, d: T.sub_pixel(pixels(s, d), 4).select("region", *(F.round(c, 6).alias(c) for c in "rgba")),
    "cell_downscale": _cells,
    "tile_tiers": lambda s, d: table(s, d, "part").select("p_partkey", F.expr("shiftright(512, cast(p_partkey % 9 as int))").alias("cell")).select("p_partkey", "cell", T.tier(F.col("cell")).alias("tier")),
    "tile_last_wins": lambda s, d: _tiles(s, d, "A"),
    "tile_coalesce": lambda s, d: T.coalesce_tiles(_tiles(s, d, "A"), _tiles(s, d, "B"), ["dim", "x", "z"], ["height", "found_time"]),
    "palette_intern": lambda s, d: T.intern(highlights(s, d), "dim", "height", "ord"),
    "pixel_slopes": lambda s, d: T.slopes(_heights(s, d)).select("region", "px", "pz", *(F.coalesce(c, F.lit(-999)).alias(c) for c in ("vs", "ds"))),
    "pixel_adopted_slopes": lambda s, d: T.adopted_slopes(T.slopes(_heights(s, d))).select("region", "px", "pz", "vs", "ds"),
    "pixel_tint_mean": lambda s, d: T.tint_mean(pixels(s, d), "g").select("region", "px", "pz", "mean", T.tinted(F.col("mean"), F.lit(145)).alias("tinted")),
    "chunk_preview_mean": lambda s, d: pixels(s, d).where("g <> 0").groupBy("region").agg(*(F.expr(f"sum({c}) div count(*)").alias(c) for c in "rgb")),
}

_HEIGHTS = "ht: select region, px, pz, r h from pix where (px + 3 * pz) % 11 <> 0"
_STEPS = "sl: select region, px, pz, cast(greatest(-128, least(127, h - n.nh)) as int) vs, cast(greatest(-128, least(127, h - w.wh)) as int) ds from ht left join (select region, px, pz + 1 pz, h nh from ht) n using (region, px, pz) left join (select region, px + 1 px, pz + 1 pz, h wh from ht) w using (region, px, pz)".replace("greatest(-128, least(127, h - n.nh))", "case when n.nh is not null then greatest(-128, least(127, h - n.nh)) end").replace("greatest(-128, least(127, h - w.wh))", "case when w.wh is not null then greatest(-128, least(127, h - w.wh)) end")
_TILE = "{0}: select dim, x, z, height, found_time, ord from (select *, row_number() over (partition by dim, x, z order by ord desc) n from {1}) where n = 1"
def _shrink(name, source, factor, more=""):
    mean = lambda c: f"case when sum(a) > 0 then cast(sum({c} * a) // greatest(sum(a), 1) as bigint) else 0 end {c}"
    return f"{name}: select rx, rz, px // {factor} px, pz // {factor} pz, {', '.join(map(mean, 'rgb'))}, cast(sum(a) // {factor * factor} as bigint) a from {source} {more} group by rx, rz, px // {factor}, pz // {factor}"


_PICTURES = [
    "fu: select cast(l_orderkey // 4096 as int) rx, cast(l_suppkey % 4 as int) rz, l_orderkey // 64 % 64 px, l_partkey % 64 pz, max(cast(l_quantity * 5 as bigint)) r, max(cast(round(l_discount * 2000) as bigint)) g, max(cast(round(l_tax * 3000) as bigint)) b, max(cast(l_linenumber as bigint) * 36) a from lineitem group by 1, 2, 3, 4",
    _shrink("mi", "fu", 8), _shrink("th", "fu", 2),
    "own: select distinct rx, rz, (rx + rz) % 3 < 2 and not ((rx + rz) % 3 = 1 and rz > 1) has_mip, rx % 2 = 0 and rz <> 3 has_thumb from fu",
]
_TILED = "select 'surface' layer, cast(floor(rx / {0}.0) as bigint) x, cast(floor(rz / {0}.0) as bigint) y, rx % {0} * {1} + px tx, rz % {0} * {1} + pz tz, r, g, b, a from ({2})"
ORACLES = {
    "tile_from_tiers": with_views(_TILED.format(16, 4, "select * from m4 semi join (select * from own where has_mip) using (rx, rz) union all select * from t4 semi join (select * from own where not has_mip and has_thumb) using (rx, rz) union all select * from f4 semi join (select * from own where not has_mip and not has_thumb) using (rx, rz)"), *_PICTURES, _shrink("m4", "mi", 2), _shrink("t4", "th", 8), _shrink("f4", "fu", 16)),
    "tile_from_tiers_near": with_views(_TILED.format(4, 16, "select * from t16 semi join (select * from own where has_thumb) using (rx, rz) union all select * from f16 semi join (select * from own where not has_thumb) using (rx, rz)"), *_PICTURES, _shrink("t16", "th", 2), _shrink("f16", "fu", 4)),
    "pixel_box_downscale": with_views("select region, px // 4 px, pz // 4 pz, case when sum(a) > 0 then cast(sum(r * a) // greatest(sum(a), 1) as bigint) else 0 end r, case when sum(a) > 0 then cast(sum(g * a) // greatest(sum(a), 1) as bigint) else 0 end g, case when sum(a) > 0 then cast(sum(b * a) // greatest(sum(a), 1) as bigint) else 0 end b, cast(sum(a) // 16 as bigint) a from pix group by region, px // 4, pz // 4", "pix"),
    "pixel_sub_pixel": with_views("select region, round(sum(r * a) / sum(a), 6) r, round(sum(g * a) / sum(a), 6) g, round(sum(b * a) / sum(a), 6) b, round(greatest(64.0::double, 255 * least(1.0::double, sum(a) / 255.0::double / 256.0::double)), 6) a from pix group by region", "pix"),
    "cell_downscale": with_views("select vec_id, cx // 2 cx, cz // 2 cz, cast(sum(v) // 4 as bigint) v, count(*) n from cells group by vec_id, cx // 2, cz // 2", "cells"),
    "tile_tiers": "select p_partkey, cell, case when cell <= 8 then 'mip' when cell <= 32 then 'thumb' else 'full' end tier from (select p_partkey, cast(512 >> cast(p_partkey % 9 as int) as int) cell from part)",
    "tile_last_wins": with_views("select * from a", "hl", _TILE.format("a", "hl where side = 'A'")),
    "tile_coalesce": with_views("select dim, x, z, case when a.ord is null then b.height else a.height end height, case when a.ord is null then b.found_time else a.found_time end found_time, a.ord is null from_second from a full join b using (dim, x, z)", "hl", _TILE.format("a", "hl where side = 'A'"), _TILE.format("b", "hl where side = 'B'")),
    "palette_intern": with_views("select dim, height, row_number() over (partition by dim order by f, height) - 1 idx from (select dim, height, min(ord) f from hl group by 1, 2)", "hl"),
    "pixel_slopes": with_views("select region, px, pz, coalesce(vs, -999) vs, coalesce(ds, -999) ds from sl", "pix", _HEIGHTS, _STEPS),
    "pixel_adopted_slopes": with_views("select region, px, pz, coalesce(first_value(vs ignore nulls) over w, 0) vs, coalesce(first_value(ds ignore nulls) over w, 0) ds from sl window w as (partition by region, px - pz order by pz rows between current row and unbounded following)", "pix", _HEIGHTS, _STEPS),
    "pixel_tint_mean": with_views("select region, px, pz, mean, mean * 145 // 255 tinted from (select p.region, p.px, p.pz, cast(sum(q.g) // count(*) as bigint) mean from pix p join pix q on p.region = q.region and abs(p.px - q.px) + abs(p.pz - q.pz) <= 1 and q.px between p.px - 1 and p.px + 1 group by 1, 2, 3)", "pix"),
    "chunk_preview_mean": with_views("select region, cast(sum(r) // count(*) as bigint) r, cast(sum(g) // count(*) as bigint) g, cast(sum(b) // count(*) as bigint) b from pix where g <> 0 group by region", "pix"),
}
