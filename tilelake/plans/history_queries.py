"""Queries on waypoints, settings and live positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilelake.operators import live as L
from tilelake.operators import waypoints as W
from tilelake.plans.views import dealt, positions, table, waypoint_lines, with_views

NOW_MS = 1_700_000_000_000


def _records(s, d):
    r = W.parse(waypoint_lines(s, d))
    return r.select(*(r[c] for c in r.columns), F.lit("minecraft:overworld").alias("dim"), F.concat(F.lit("mw"), F.col("side")).alias("mw_file"), F.lit("scan").alias("source"))


def _vault(s, d):
    old = _records(s, d).where("ord % 3 <> 0")
    return old.select(*W.KEY, *W.ATTRIBUTES, "source", (F.col("ord") % 4 != 1).alias("present"), F.lit(1000).cast("bigint").alias("first_seen"), F.lit(NOW_MS - 5).cast("bigint").alias("last_seen"))


def _of_batch(records):
    return records.where("ord % 5 < 3 and side = 'A'").withColumn("color", F.col("color") + 1)


def _batch(s, d):
    return _of_batch(_records(s, d))


def _synced(s, d):
    return W.sync(_vault(s, d), _batch(s, d), _records(s, d).where("side = 'A'"), NOW_MS)


def _union_files(s, d):
    """A waypoint file for each 40 customers: sets, comments, notes, records too short and records that repeat."""
    k = F.col("c_custkey")
    text = lambda v: v.cast("string")
    record = F.concat(F.lit("waypoint:n"), text(k % 6), F.lit(":N:"), text(k % 3), F.lit(":~:5:1:false:0:set"))
    line = F.when(k % 10 == 0, F.concat(F.lit("sets:gui.default:"), text(k % 3), F.lit("::x"))).when(k % 10 == 1, "# comment").when(k % 10 == 2, F.concat(F.lit("note "), text(k % 4))).when(k % 10 == 3, "").when(k % 10 == 4, "waypoint:short").otherwise(record)
    side = F.when((F.floor(k / 40) % 5 == 0) | (k % 2 == 0), "A").otherwise("B")
    return W.union_files(table(s, d, "customer").select(F.floor(k / 40).alias("file"), side.alias("side"), k.alias("ord"), line.alias("line")), ["file"])


def _first_settings(s, d, line):
    """The first value of each key that a document's lines set, a dot or colon between them."""
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return W.first_values(W.key_values(lines.withColumn("line", F.translate(line, ".", ":"))), ["doc_id"], "ord")


def _newer_of(o, file):
    return W.newer_file(o.select(file.alias("file"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B").alias("side"), (F.col("o_orderkey") % 2000 * 4 + F.col("o_custkey") % 2).alias("mtime_ms")).groupBy("file", "side").agg(F.max("mtime_ms").alias("mtime_ms")), "file")


def _newer(s, d):
    """All orders, a file for each four customers."""
    return _newer_of(table(s, d, "orders"), F.floor(F.col("o_custkey") / 4))


def _newer_all(s, d):
    """All orders, a file for each customer: their number grows with the table."""
    return _newer_of(table(s, d, "orders"), F.col("o_custkey"))


def _canvas(s, d):
    p = positions(s, d).select("dim", F.floor(F.col("x") / 16).cast("int").alias("cx"), F.floor(F.col("z") / 16).cast("int").alias("cz"), F.col("event_id").alias("first"), F.col("event_id").alias("last"), F.col("player").alias("value"))
    return L.preview_canvas(p.where("first % 2 = 0"), p.where("first % 2 = 1"), 500)


def _evicted(s, d):
    return L.evict_regions(_canvas(s, d), positions(s, d).where("event_id % 50 = 0").select("dim", F.floor(F.col("x") / 512).cast("int").alias("rx"), F.floor(F.col("z") / 512).cast("int").alias("rz")))


def _chunk_pixels(s, d, zoom):
    """A chunk for each part: its pixels' colours go with their place, some are nothing."""
    p = F.col("p_partkey")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: ((p * 31 + k * 257) % 65536 * F.when((p + k) % 5 == 0, 0).otherwise(1)).cast("int"))
    chunks = dealt(s, d, "part", "p_partkey").select(F.when(p % 2 == 0, "o").otherwise("n").alias("dim"), (p % 40 - 20).cast("int").alias("cx"), (F.floor(p / 40) - 3).cast("int").alias("cz"), pixels.alias("pixels"), *((p * m % 256).alias(c) for c, m in (("r", 3), ("g", 5), ("b", 7))))
    return L.preview_pixels(chunks, zoom)


QUERIES = {
    "live_preview_tiles": lambda s, d: _chunk_pixels(s, d, -2),
    "live_preview_tiles_far": lambda s, d: _chunk_pixels(s, d, -6),
    "live_preview_canvas": _canvas,
    "live_preview_evicted": _evicted,
    "live_flushes": lambda s, d: L.flushes(positions(s, d).select("dim", F.floor(F.col("t_ms") / 100).alias("t_ms"), F.concat_ws("_", "x", "z").alias("place"))),
    "waypoint_parse": lambda s, d: _records(s, d).select("ord", "name", "initials", "x", F.coalesce("y", F.lit(-1)).alias("y"), "z", "color", "disabled", "wp_set", "y_key", W.colour(F.col("color")).alias("rgb")),
    "waypoint_format": lambda s, d: _records(s, d).select("ord", W.format_line().alias("line")),
    "waypoint_union": lambda s, d: W.union_lines(waypoint_lines(s, d).select("side", "world", "ord", F.regexp_replace("line", "[0-9]", "").alias("line")), ["world"]),
    "waypoint_union_files": _union_files,
    "waypoint_sync": lambda s, d: _synced(s, d).select("world", "mw_file", "name", "x", "y_key", "z", "color", "present", "first_seen", "last_seen"),
    "waypoint_sync_report": lambda s, d: W.sync_report(_synced(s, d), 0, NOW_MS).drop("seen"),
    "waypoint_world_counts": lambda s, d: W.world_counts(_synced(s, d)),
    "waypoint_export": lambda s, d: W.export(_synced(s, d)).select("world", "mw_file", "line"),
    "waypoint_visible": lambda s, d: W.visible(_synced(s, d), "minecraft:overworld", "B").select("name", "x", "z"),
    "settings_first_values": lambda s, d: _first_settings(s, d, F.lower("line")),
    "settings_whole_lines": lambda s, d: _first_settings(s, d, F.col("line")),
    "settings_newer_file": _newer,
    "settings_newer_file_all": _newer_all,
    "live_latest": lambda s, d: L.latest(positions(s, d)),
    "live_in_order": lambda s, d: L.in_order(positions(s, d).withColumn("t_ms", F.col("t_ms") + F.col("x") * 100)).select("event_id", "player", "t_ms"),
    "live_trails": lambda s, d: L.trails(positions(s, d).withColumn("t_ms", F.floor(F.col("t_ms") / 1000))),
    "live_path_length": lambda s, d: L.path_length(positions(s, d)).select("player", "dim", F.round(F.coalesce("blocks", F.lit(0.0)), 4).alias("blocks")),
    "live_roster": lambda s, d: L.roster(positions(s, d), 1_706_000_000_000),
    "live_change_batches": lambda s, d: L.change_batches(positions(s, d), 60_000, 5),
    "live_rate_limit": lambda s, d: L.rate_limit(positions(s, d), 0.00005, 3),
}

_WP = r"""r: select ord, side, world, 'minecraft:overworld' dim, 'mw' || side mw_file, replace(f[2], '§§', ':') as name, f[3] initials, cast(f[4] as int) x, try_cast(f[5] as int) y, cast(f[6] as int) z, cast(f[7] as int) color, f[8] = 'true' disabled, f[10] wp_set, coalesce(try_cast(f[5] as int), -100000) y_key
    from (select *, string_split(line, ':') f from wp) where len(f) >= 10"""
_V = "v: select world, dim, mw_file, name, x, y_key, z, initials, y, color, disabled, wp_set, ord % 4 <> 1 present, 1000::bigint first_seen, 1699999999995::bigint last_seen from r where ord % 3 <> 0"
_B = "b: select *, cast(color + 1 as int) c2 from r where ord % 5 < 3 and side = 'A'"
_S = f"""sy: select world, dim, mw_file, name, x, y_key, z, coalesce(b.initials, v.initials) initials, coalesce(b.disabled, v.disabled) disabled, coalesce(b.wp_set, v.wp_set) wp_set, coalesce(b.c2, v.color) color, v.present was,
    case when b.ord is not null then true when mw_file = 'mwA' and exists (select 1 from r where r.world = coalesce(b.world, v.world) and r.side = 'A') then false else v.present end present, coalesce(v.first_seen, {NOW_MS}) first_seen, case when b.ord is not null then {NOW_MS} else v.last_seen end last_seen
    from v full join b using (world, dim, mw_file, name, x, y_key, z)"""
_LINE = "'waypoint:' || replace(name, ':', '§§') || ':' || initials || ':' || x || ':' || case when y_key = -100000 then '~' else cast(y_key as varchar) end || ':' || z || ':' || color || ':' || disabled || ':0:' || wp_set || ':false:0:0:false'"
_STEP = "sqrt((x - lag(x) over w)::double ** 2 + (z - lag(z) over w)::double ** 2)"
_CANVAS = "cv: select dim, cx, cz, first, last, value from (select *, row_number() over (partition by dim order by first desc, cx, cz) n from (select dim, cast(floor(x / 16.0) as int) cx, cast(floor(z / 16.0) as int) cz, min(event_id) as first, max(event_id) as last, max_by(player, event_id) as value from pos group by 1, 2, 3)) where n <= 500"
_CHUNKS = "ch: select case when p_partkey % 2 = 0 then 'o' else 'n' end dim, p_partkey p, p_partkey % 40 - 20 cx, p_partkey // 40 - 3 cz from part"
_CHANNEL = "cast(((v >> {0}) & {1}) * 255 + {1} // 2 as bigint) // {1} {2}"
ORACLES = {
    "live_preview_tiles": with_views(f"select dim, cast(floor(cx / 128.0) as bigint) x, cast(floor(cz / 128.0) as bigint) y, ((cx % 128 + 128) % 128) * 4 + k % 4 tx, ((cz % 128 + 128) % 128) * 4 + k // 4 tz, {_CHANNEL.format(11, 31, 'r')}, {_CHANNEL.format(5, 63, 'g')}, {_CHANNEL.format(0, 31, 'b')} from (select *, case when (p + s) % 5 = 0 then 0 else (p * 31 + s * 257) % 65536 end v from (select *, k // 4 * 4 * 16 + k % 4 * 4 s from ch, range(16) t(k))) where v <> 0", _CHUNKS),
    "live_preview_tiles_far": with_views("select dim, x, y, tx, tz, p * 3 % 256 r, p * 5 % 256 g, p * 7 % 256 b from (select *, row_number() over (partition by dim, x, y, tx, tz order by cz desc, cx desc) n from (select *, cast(floor(cx / 2048.0) as bigint) x, cast(floor(cz / 2048.0) as bigint) y, ((cx % 2048 + 2048) % 2048) * 16 // 64 tx, ((cz % 2048 + 2048) % 2048) * 16 // 64 tz from ch)) where n = 1", _CHUNKS),
    "live_preview_canvas": with_views("select * from cv", "pos", _CANVAS),
    "live_preview_evicted": with_views("select * from cv where not exists (select 1 from pos p where p.event_id % 50 = 0 and p.dim = cv.dim and floor(p.x / 512.0) = floor(cv.cx / 32.0) and floor(p.z / 512.0) = floor(cv.cz / 32.0))", "pos", _CANVAS),
    "waypoint_parse": with_views("select ord, name, initials, x, coalesce(y, -1) y, z, color, disabled, wp_set, y_key, list_extract(['#000000', '#0000aa', '#00aa00', '#00aaaa', '#aa0000', '#aa00aa', '#ffaa00', '#aaaaaa', '#555555', '#5555ff', '#55ff55', '#55ffff', '#ff5555', '#ff55ff', '#ffff55', '#ffffff', '#c74ebd', '#3ab3da', '#80c71f', '#f38baa'], color % 20 + 1) rgb from r", "wp", _WP),
    "waypoint_format": with_views(f"select ord, {_LINE} as line from r", "wp", _WP),
    "waypoint_union": with_views("select world, line, side, ord from (select *, row_number() over (partition by world, line order by side, ord) n from (select side, world, ord, regexp_replace(line, '[0-9]', '', 'g') line from wp)) where n = 1", "wp"),
    "waypoint_union_files": with_views("select file, part, side, ord, pos, text from (select *, row_number() over (partition by file, part = 0, text order by part, side, ord, pos) r from (select * from st union all select file, case when k < 5 then 2 else 1 end part, side, ord, 0 pos, case when k < 5 then line else line || ':false:0:0:false' end as text from b where k not in (0, 1, 3))) where r = 1 union all select file, 3, side, ord, 0, line from l where file % 5 = 0 or file not in (select file from b)",
        "l: select c_custkey // 40 file, c_custkey % 10 k, case when c_custkey // 40 % 5 = 0 or c_custkey % 2 = 0 then 'A' else 'B' end side, c_custkey ord, case c_custkey % 10 when 0 then 'sets:gui.default:' || c_custkey % 3 || '::x' when 1 then '# comment' when 2 then 'note ' || c_custkey % 4 when 3 then '' when 4 then 'waypoint:short' else 'waypoint:n' || c_custkey % 6 || ':N:' || c_custkey % 3 || ':~:5:1:false:0:set' end as line from customer",
        "b: select * from l where file in (select file from l group by 1 having count(distinct side) = 2)", "st: select file, 0 part, side, ord, i - 1 pos, list_extract(['gui.default', cast(ord % 3 as varchar), '', 'x'], i) as text from b, range(1, 5) r(i) where k = 0 and i <> 3"),
    "waypoint_sync": with_views("select world, mw_file, name, x, y_key, z, color, present, first_seen, last_seen from sy", "wp", _WP, _V, _B, _S),
    "waypoint_sync_report": with_views("select count(*) filter (was is null) added, count(*) filter (last_seen = 1700000000000 and not was) revived, count(*) filter (was and not present) newly_archived, count(*) total, count(*) filter (not present) archived_total from sy", "wp", _WP, _V, _B, _S),
    "waypoint_world_counts": with_views("select world, count(*) total, count(*) filter (not present) archived from sy group by world", "wp", _WP, _V, _B, _S),
    "waypoint_export": with_views(f"select world, mw_file, {_LINE} as line from sy where present", "wp", _WP, _V, _B, _S),
    "waypoint_visible": with_views("select name, x, z from sy where not disabled and present and contains(lower(name), 'b')", "wp", _WP, _V, _B, _S),
    "settings_first_values": "select doc_id, key, value from (select doc_id, ord, split_part(line, ':', 1) as key, case when contains(line, ':') then substr(line, instr(line, ':') + 1) else '' end as value, row_number() over (partition by doc_id, split_part(line, ':', 1) order by ord) n from (select doc_id, ord, replace(lower(line), '.', ':') line from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) ord from documents)) where trim(line) <> '' and not starts_with(line, '//')) where n = 1",
    "settings_whole_lines": "select doc_id, key, value from (select doc_id, ord, split_part(line, ':', 1) as key, case when contains(line, ':') then substr(line, instr(line, ':') + 1) else '' end as value, row_number() over (partition by doc_id, split_part(line, ':', 1) order by ord) n from (select doc_id, ord, replace(line, '.', ':') line from (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) ord from documents)) where trim(line) <> '' and not starts_with(line, '//')) where n = 1",
    "settings_newer_file": "select file, side, mtime_ms from (select *, row_number() over (partition by file order by mtime_ms desc, side) n from (select o_custkey // 4 file, case when o_orderkey % 2 = 0 then 'A' else 'B' end side, max(o_orderkey % 2000 * 4 + o_custkey % 2) mtime_ms from orders group by 1, 2)) where n = 1",
    "settings_newer_file_all": "select file, side, mtime_ms from (select *, row_number() over (partition by file order by mtime_ms desc, side) n from (select o_custkey file, case when o_orderkey % 2 = 0 then 'A' else 'B' end side, max(o_orderkey % 2000 * 4 + o_custkey % 2) mtime_ms from orders group by 1, 2)) where n = 1",
    "live_latest": with_views("select player, event_id, t_ms, dim, x, z from (select *, row_number() over (partition by player order by t_ms desc, event_id desc) n from pos) where n = 1", "pos"),
    "live_in_order": with_views("select event_id, player, t_ms from (select event_id, player, t_ms + x * 100 t_ms, max(t_ms + x * 100) over (partition by player order by event_id rows between unbounded preceding and 1 preceding) m from pos) where m is null or t_ms >= m", "pos"),
    "live_trails": with_views("select player, event_id, t_ms, x, z from (select *, row_number() over (partition by player order by t_ms desc, event_id desc) back, first_value(part) over (partition by player order by t_ms desc, event_id desc) lp, first_value(t_ms) over (partition by player order by t_ms desc, event_id desc) lm from q2) where back <= 30 and part = lp and lm - t_ms <= 60000", "pos", "q0: select event_id, player, t_ms // 1000 t_ms, dim, x, z from pos", f"q1: select *, case when dim <> lag(dim) over w or {_STEP} > greatest(1.0, (t_ms - lag(t_ms) over w) / 1000.0::double) * 150 then 1 else 0 end reset from q0 window w as (partition by player order by t_ms, event_id)", "q2: select *, sum(reset) over (partition by player order by t_ms, event_id) part from q1"),
    "live_path_length": with_views(f"select player, dim, round(coalesce(sum(step), 0), 4) blocks from (select player, dim, {_STEP} step from pos window w as (partition by player, dim order by t_ms, event_id)) group by 1, 2", "pos"),
    "live_roster": with_views("select player, max(t_ms) t_ms, 1706000000000 - max(t_ms) > 30000 stale from pos group by player", "pos"),
    "live_change_batches": with_views("select t_ms // 60000 batch, dim, count(distinct (x, z)) places, count(*) events, count(distinct (x, z)) > 5 overflow from pos group by 1, 2", "pos"),
}
