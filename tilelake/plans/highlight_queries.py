"""Queries on chunk highlights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilelake.operators import highlights as H
from tilelake.plans.views import highlights, table, with_views

KEYS = ("dim", "x", "z")


def _one(df, side):
    return H.normalise(df.where(F.col("side") == side), KEYS, "src", "ord")


def _named(s, d):
    """Names of databases, and what the palette says of them."""
    patterns = F.array(*(F.lit(p[0]) for p in H.PALETTE), F.lit("Unknown"))
    name = F.concat(F.lit("db_"), F.element_at(patterns, (F.col("p_partkey") % 11 + 1).cast("int")), F.lit(".db"))
    field = lambda k: H.palette_field(F.col("name"), k)
    rows = table(s, d, "part").select("p_partkey", name.alias("name"))
    return rows.select("p_partkey", "name", field(1).alias("label"), H.hex_colour(field(2)).alias("colour"), field(3).alias("meaning"), (field(3) == "timestamp").alias("syncable"))


_NAMES = "db: select p_partkey, 'db_' || list_extract([{}], cast(p_partkey % 11 + 1 as int)) || '.db' as name from part".format(", ".join(f"'{p[0]}'" for p in H.PALETTE) + ", 'Unknown'")


def _case(field: int) -> str:
    whens = " ".join(f"when contains(name, '{p[0]}') then '{p[field]}'" for p in H.PALETTE)
    return f"case {whens} end"


QUERIES = {
    "highlight_tile_grid": lambda s, d: H.tile_grid(highlights(s, d).where("dim = 'minecraft:overworld'"), -128, -128, 256, 16, "found_time"),
    "highlight_tile_counts": lambda s, d: H.tile_grid(highlights(s, d).where("dim = 'minecraft:the_end'"), -64, -64, 64, 512),
    "highlight_lava_grid": lambda s, d: H.tile_grid(highlights(s, d).where("dim = 'minecraft:the_nether'"), -128, -128, 256, 32, "height", True, H.LAVA_MIN_HEIGHT),
    "highlight_dense_grid": lambda s, d: H.dense_grid(s, H.tile_grid(highlights(s, d).where("dim = 'minecraft:overworld'"), -64, -64, 128, 32, "found_time"), 32).withColumn("value", F.coalesce("value", F.lit(-1))),
    "highlight_window": lambda s, d: H.window(highlights(s, d).where("dim = 'minecraft:the_end'"), -20, -20, 20, 20).select("x", "z", "found_time", "src"),
    "highlight_row_cap": lambda s, d: H.row_cap(H.window(highlights(s, d), -64, -50, 64, 50), 1000),
    "highlight_dimension_counts": lambda s, d: highlights(s, d).groupBy("side", "dim").agg(F.count("*").alias("n")),
    "highlight_normalise": lambda s, d: H.normalise(highlights(s, d).where("side = 'A'"), KEYS, "src", "ord").select(*KEYS, "found_time", "ord"),
    "highlight_merge_oldest": lambda s, d: H.merge(_one(highlights(s, d), "A"), _one(highlights(s, d), "B")),
    "highlight_merge_highest": lambda s, d: H.merge(highlights(s, d), value="height", largest=True),
    "highlight_merge_report": lambda s, d: H.merge_report(highlights(s, d).where("side = 'A'"), highlights(s, d).where("side = 'B'")),
    "highlight_dry_run": lambda s, d: H.dry_run(highlights(s, d).where("side = 'A'"), highlights(s, d).where("side = 'B'")),
    "highlight_overlap": lambda s, d: highlights(s, d).where("side = 'A'").select(*KEYS).distinct().join(highlights(s, d).where("side = 'B'").select(*KEYS), list(KEYS), "left_semi").agg(F.count("*").alias("n")),
    "highlight_live_upsert": lambda s, d: H.live_upsert(_one(highlights(s, d), "A"), highlights(s, d).where("side = 'B'")),
    "highlight_lava_alpha": lambda s, d: highlights(s, d).where("dim = 'minecraft:the_nether'").select("x", "z", "ord", "height", F.coalesce(H.lava_alpha(F.col("height")), F.lit(-1)).alias("alpha")),
    "highlight_palette_of_name": _named,
    "highlight_canonical_dimension": lambda s, d: table(s, d, "part").select("p_partkey", H.canonical_dimension((F.col("p_partkey") % 5 - 1).cast("string")).alias("dim")),
}

_SIDE = "{0}: select dim, x, z, found_time, ord from (select *, row_number() over (partition by dim, x, z order by src, ord, side, found_time, height) n from hl where side = '{1}') where n = 1"
ORACLES = {
    "highlight_tile_grid": with_views("select cast((x + 128) * 16 // 256 as int) cell_x, cast((z + 128) * 16 // 256 as int) cell_z, count(*) n, min(found_time) as value from hl where dim = 'minecraft:overworld' and x >= -128 and x < 128 and z >= -128 and z < 128 group by 1, 2", "hl"),
    "highlight_tile_counts": with_views("select cast((x + 64) * 64 // 64 as int) cell_x, cast((z + 64) * 64 // 64 as int) cell_z, count(*) n from hl where dim = 'minecraft:the_end' and x >= -64 and x < 0 and z >= -64 and z < 0 group by 1, 2", "hl"),
    "highlight_lava_grid": with_views("select cast((x + 128) * 32 // 256 as int) cell_x, cast((z + 128) * 32 // 256 as int) cell_z, count(*) n, max(height) as value from hl where dim = 'minecraft:the_nether' and x >= -128 and x < 128 and z >= -128 and z < 128 and height >= 5 group by 1, 2", "hl"),
    "highlight_dense_grid": with_views("select cell_x, cell_z, coalesce(n, 0) n, coalesce(value, -1) as value from (select cast(i as int) cell_x from range(32) t(i)) cross join (select cast(i as int) cell_z from range(32) t(i)) left join g using (cell_x, cell_z)", "hl", "g: select cast((x + 64) * 32 // 128 as int) cell_x, cast((z + 64) * 32 // 128 as int) cell_z, count(*) n, min(found_time) as value from hl where dim = 'minecraft:overworld' and x >= -64 and x < 64 and z >= -64 and z < 64 group by 1, 2"),
    "highlight_window": with_views("select x, z, found_time, src from hl where dim = 'minecraft:the_end' and x >= -20 and x < 20 and z >= -20 and z < 20", "hl"),
    "highlight_row_cap": with_views("select least(count(*), 1000) as rows, count(*) > 1000 as truncated from hl where x >= -64 and x < 64 and z >= -50 and z < 50", "hl"),
    "highlight_dimension_counts": with_views("select side, dim, count(*) n from hl group by 1, 2", "hl"),
    "highlight_normalise": with_views("select dim, x, z, found_time, ord from a", "hl", _SIDE.format("a", "A")),
    "highlight_merge_oldest": with_views("select dim, x, z, min(found_time) found_time from (select * from a union all select * from b) group by 1, 2, 3", "hl", _SIDE.format("a", "A"), _SIDE.format("b", "B")),
    "highlight_merge_highest": with_views("select dim, x, z, max(height) height from hl group by 1, 2, 3", "hl"),
    "highlight_merge_report": with_views("select dim, (select count(*) from b where b.dim = t.dim) source_rows, (select count(*) from a where a.dim = t.dim) dest_before, (select count(*) from a join b using (dim, x, z) where dim = t.dim) overlap, (select count(*) from (select * from a union select * from b) u where u.dim = t.dim) dest_after from (select distinct dim from hl) t", "hl", "a: select distinct dim, x, z from hl where side = 'A'", "b: select distinct dim, x, z from hl where side = 'B'"),
    "highlight_dry_run": with_views("select dim, src, source_rows, overlap, dest_before, dest_before + source_rows - overlap dest_after from (select dim, src, count(*) source_rows, count(hit) overlap from b left join (select *, 1 hit from a) using (dim, x, z) group by 1, 2) join (select dim, count(*) dest_before from a group by 1) using (dim)", "hl", "a: select distinct dim, x, z from hl where side = 'A'", "b: select distinct src, dim, x, z from hl where side = 'B'"),
    "highlight_overlap": with_views("select count(*) n from (select distinct dim, x, z from hl where side = 'A' intersect select dim, x, z from hl where side = 'B')", "hl"),
    "highlight_live_upsert": with_views("select dim, x, z, case when old is null then new when new is null then old else least(old, new) end found_time, old is null or coalesce(new < old, false) changed from (select dim, x, z, found_time as old from a) full join (select dim, x, z, min(found_time) as new from hl where side = 'B' group by 1, 2, 3) using (dim, x, z)", "hl", _SIDE.format("a", "A")),
    "highlight_lava_alpha": with_views("select x, z, ord, height, case when height >= 5 then cast(greatest(0, least(255, height * 8)) as int) else -1 end alpha from hl where dim = 'minecraft:the_nether'", "hl"),
    "highlight_palette_of_name": with_views(f"select p_partkey, name, {_case(1)} as label, '#' || lower(lpad(printf('%x', cast({_case(2)} as bigint)), 6, '0')) colour, coalesce({_case(3)}, 'timestamp') meaning, coalesce({_case(3)}, 'timestamp') = 'timestamp' syncable from db", _NAMES),
    "highlight_canonical_dimension": "select p_partkey, case p_partkey % 5 - 1 when 0 then 'minecraft:overworld' when -1 then 'minecraft:the_nether' when 1 then 'minecraft:the_end' else cast(p_partkey % 5 - 1 as varchar) end dim from part",
}
