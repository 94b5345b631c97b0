"""Queries on region indexes and on names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilelake.functions import naming as N
from tilelake.functions.coords import region_of_block, rgb565, signed12
from tilelake.operators import index as I
from tilelake.plans.views import highlights, names, region_index, table, with_views

NOW_MS = 1_700_000_000_000


def _side(s, d, side):
    return I.best_files(region_index(s, d).where(F.col("side") == side))


def _all(s, d):
    return I.best_files(region_index(s, d))


def _others(s, d):
    files = region_index(s, d).where("side = 'B'")
    return I.alternates(_side(s, d, "A"), files.select("layer", "rx", "rz", F.when(F.col("is_zip"), "backup").otherwise("conflict").alias("source"), "ord"))


def _bad_files(s, d):
    kind = F.when(F.col("size") == 0, "empty file").when(F.col("size") % 3 == 0, "truncated").otherwise("unreadable")
    detail = F.when(F.col("size") == 0, "0 bytes").otherwise(F.concat(F.lit("code "), (F.col("size") % 7).cast("string")))
    path = F.concat_ws("/", "layer", N.region_filename(F.col("rx"), F.col("rz"), F.col("is_zip")))
    return region_index(s, d).where("size % 2 = 0").select(kind.alias("kind"), detail.alias("detail"), path.alias("path"), "ord")


def _names(s, d):
    n = F.col("name")
    rx, rz, zipped = N.region_coordinates(n)
    major, minor, slot = N.backup_version(n)
    cx, cz, _, tag = N.sync_conflict(n)
    mw, shown = N.waypoint_file(n)
    none = lambda c: F.coalesce(c.cast("bigint"), F.lit(-999))
    text = lambda c: F.coalesce(c, F.lit("-"))
    return names(s, d).select(
        "ord", "name", none(rx).alias("rx"), none(rz).alias("rz"), F.coalesce(zipped, F.lit(False)).alias("is_zip"), none(major).alias("major"), none(minor).alias("minor"), none(slot).alias("slot"),
        none(cx).alias("conflict_rx"), none(cz).alias("conflict_rz"), text(tag).alias("tag"), text(mw).alias("mw"), text(shown).alias("shown"),
        N.is_transient(n).alias("transient"), N.is_cache_folder(n).alias("cache"), N.is_multiworld(n).alias("multiworld"), N.is_minimap_backup(n).alias("backup"), text(N.dimension_of_folder(n)).alias("dim"), N.safe_segment(n).alias("safe"),
    )


def _worlds(s, d):
    w = table(s, d, "supplier").select("s_suppkey", F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Multiplayer_").otherwise(""), F.lit("Play"), (F.col("s_nationkey") % 5).cast("string"), F.element_at(F.array(*map(F.lit, (".net.org", ".com", ".ORG", ".org.net", ""))), (F.col("s_suppkey") % 5 + 1).cast("int"))).alias("world"))
    return w.select("s_suppkey", "world", N.base_domain(F.col("world")).alias("base_domain"), N.world_key(F.col("world")).alias("world_key"))


QUERIES = {
    "region_best_files": _all,
    "region_bounds": lambda s, d: I.bounds(_all(s, d)),
    "region_in_range": lambda s, d: I.in_range(I.with_buckets(_all(s, d)), -10, -20, 24).select("layer", "rx", "rz", "bx", "bz"),
    "region_diff": lambda s, d: I.diff(_side(s, d, "A"), _side(s, d, "B")),
    "region_alternates": _others,
    "region_alternates_issue": lambda s, d: I.alternates_issue(_others(s, d)),
    "region_sample": lambda s, d: I.sample(_all(s, d), 50).select("layer", "rx", "rz", "size"),
    "region_layer_stats": lambda s, d: I.layer_stats(_all(s, d)),
    "region_archive_totals": lambda s, d: I.totals(I.layer_stats(_all(s, d))),
    "region_explored_estimate": lambda s, d: _all(s, d).groupBy("layer").agg(F.count_if(F.col("size") > 0).alias("sampleable"), F.count_if(F.col("size") % 5 == 1).alias("sampled"), F.sum(F.when(F.col("size") % 5 == 1, F.col("size") % 1024).otherwise(0)).alias("chunks")).select("layer", I.explored_estimate(F.col("sampled"), F.col("chunks"), F.col("sampleable")).alias("explored"), (F.col("sampled") == F.col("sampleable")).alias("exact")),
    "region_issues": lambda s, d: I.issues(_bad_files(s, d)),
    "region_coverage": lambda s, d: I.coverage(_all(s, d), NOW_MS).select("layer", "rx", "rz", F.round("age_tint", 9).alias("age_tint")),
    "region_compare": lambda s, d: I.compare(_side(s, d, "A"), _side(s, d, "B")),
    "region_conflict_plan": lambda s, d: I.conflict_plan(_side(s, d, "A"), _side(s, d, "B")),
    "region_upload_plan": lambda s, d: I.upload_plan(_side(s, d, "A"), _side(s, d, "B")),
    "region_cold": lambda s, d: I.cold(_all(s, d), _side(s, d, "A")).select("layer", "rx", "rz"),
    "region_paths": lambda s, d: _all(s, d).select(F.concat_ws("/", F.lit("w"), "layer", N.region_filename(F.col("rx"), F.col("rz"), F.col("is_zip"))).alias("path"), N.binary_bytes(F.col("size")).alias("bytes"), N.thousands(F.col("size")).alias("size")),
    "name_parsing": _names,
    "world_keys": _worlds,
    "world_pairs": lambda s, d: _worlds(s, d).where("s_suppkey % 2 = 0").select("base_domain", F.col("world").alias("world_a")).distinct().join(_worlds(s, d).where("s_suppkey % 2 = 1").select("base_domain", F.col("world").alias("world_b")).distinct(), "base_domain"),
    "nether_regions": lambda s, d: highlights(s, d).where("dim = 'minecraft:overworld'").select(F.floor(F.col("x") * 16 / 8).cast("int").alias("nx")).groupBy(region_of_block(F.col("nx")).alias("rx")).agg(F.count("*").alias("n")),
    "packed_numbers": lambda s, d: table(s, d, "orders").select("o_orderkey", signed12(F.col("o_orderkey") % 4096).alias("height"), *(v.alias(k) for k, v in rgb565((F.col("o_custkey") * 37 % 65536).cast("int")).items())),
    "dimension_names": lambda s, d: names(s, d).where("name like 'minecraft$%'").select("ord", N.unescape_id(F.col("name")).alias("dim")).select("ord", "dim", N.escape_id(F.col("dim")).alias("folder"), N.display_name(F.col("dim")).alias("shown"), F.coalesce(N.normalise_dimension(F.concat(F.lit(" "), F.replace("dim", F.lit("$"), F.lit("x")), F.lit(" "))), F.lit("-")).alias("normal")),
    "cave_labels": lambda s, d: table(s, d, "part").select("p_partkey", N.cave_label(F.when(F.col("p_partkey") % 25 == 7, N.FULL_CAVE).otherwise((F.col("p_partkey") % 25 - 10).cast("int"))).alias("label")),
}

_BEST = "select layer, rx, rz, mtime_ms, size, is_zip, ord from (select *, row_number() over (partition by layer, rx, rz order by is_zip desc, mtime_ms desc, ord) n from {0}) where n = 1"
_ALL = "f: " + _BEST.format("idx")
_A, _B = ("{0}: {1}".format(s, _BEST.format(f"(select * from idx where side = '{s.upper()}')")) for s in "ab")
_STATS = "select layer, count(*) regions, count(*) filter (size > 0) non_empty, cast(sum(size) as bigint) bytes, count(*) filter (is_zip) zips, min(rx) rx0, max(rx) rx1, min(rz) rz0, max(rz) rz1, min(mtime_ms) filter (mtime_ms <> 0) first_ms, max(mtime_ms) filter (mtime_ms <> 0) last_ms from f group by layer"
_OTHERS = "o: select layer, rx, rz, case when is_zip then 'backup' else 'conflict' end source, ord, exists (select 1 from a where a.layer = i.layer and a.rx = i.rx and a.rz = i.rz) live from idx i where side = 'B'"
_RX = r"'^(-?[0-9]+)_(-?[0-9]+)\.(zip|xaero)$'"
_CX = r"'^(-?[0-9]+)_(-?[0-9]+)\.sync-conflict-(.*)\.(zip|xaero)$'"
_BK = "'^(-?[0-9]+)_backup_([0-9]+)$'"
_NAMES_SQL = rf"""select ord, name, case when hit then cast(regexp_extract(name, {_RX}, 1) as bigint) else -999 end rx, case when hit then cast(regexp_extract(name, {_RX}, 2) as bigint) else -999 end rz, hit and ends_with(name, '.zip') is_zip,
    case when bk then cast(regexp_extract(name, {_BK}, 1) as bigint) >> 16 else -999 end major, case when bk then cast(regexp_extract(name, {_BK}, 1) as bigint) & 65535 else -999 end minor, case when bk then cast(regexp_extract(name, {_BK}, 2) as bigint) else -999 end slot,
    case when cf then cast(regexp_extract(name, {_CX}, 1) as bigint) else -999 end conflict_rx, case when cf then cast(regexp_extract(name, {_CX}, 2) as bigint) else -999 end conflict_rz, case when cf then regexp_extract(name, {_CX}, 3) else '-' end tag,
    case when ends_with(name, '.txt') and contains(name, '_') then split_part(name, '_', 1) else '-' end mw, case when name = 'waypoints.txt' then 'waypoints' when ends_with(name, '.txt') and contains(name, '_') then replace(split_part(replace(name, '.txt', ''), '_', 2), '%us%', '_') else '-' end shown,
    regexp_matches(name, '(\.temp|\.outdated|\.tmp-xt|\.xwmc|\.db-wal|\.db-shm|\.db-journal|\.backup[0-9]+(-xp-[0-9]+)?)$') or contains(name, '.zip.tmp') or contains(name, '.sync-conflict-') or name = '.lock' transient,
    regexp_matches(name, '^(cache|caches|cache_[0-9]+)$') "cache", mwf multiworld, regexp_matches(name, '^backup-*$') backup, case when contains(name, '$') and not mwf then replace(regexp_replace(name, '\$', ':'), '%', '/') else '-' end dim,
    regexp_matches(name, '^[A-Za-z0-9 _\-$%()'',+&@~][A-Za-z0-9 _\-.$%()'',+&@~]*$') safe
    from (select *, regexp_matches(name, {_RX}) hit, regexp_matches(name, {_BK}) bk, regexp_matches(name, {_CX}) cf, starts_with(name, 'mw$') or starts_with(name, 'cm$') or regexp_matches(name, '^mw-?[0-9]+,-?[0-9]+,-?[0-9]+$') mwf from names)"""
_W = "w: select s_suppkey, case when s_suppkey % 2 = 0 then 'Multiplayer_' else '' end || 'Play' || cast(s_nationkey % 5 as varchar) || list_extract(['.net.org', '.com', '.ORG', '.org.net', ''], s_suppkey % 5 + 1) world from supplier"
_K = r"k: select *, lower(regexp_replace(regexp_replace(regexp_replace(replace(world, 'Multiplayer_', ''), '(\.org)+$', ''), '(\.net)+$', ''), '(\.com)+$', '')) base_domain, lower(regexp_replace(replace(world, 'Multiplayer_', ''), '(?i)\.(org|net|com)$', '')) world_key from w"
ORACLES = {
    "region_best_files": with_views("select * from f", "idx", _ALL),
    "region_bounds": with_views("select layer, min(rx) rx0, min(rz) rz0, max(rx) rx1, max(rz) rz1 from f group by layer", "idx", _ALL),
    "region_in_range": with_views("select layer, rx, rz, cast(floor(rx / 64.0) as int) bx, cast(floor(rz / 64.0) as int) bz from f where rx >= -10 and rx < 14 and rz >= -20 and rz < 4", "idx", _ALL),
    "region_diff": with_views("select * from (select layer, rx, rz, case when a.size is null then 'added' when b.size is null then 'removed' when (a.mtime_ms, a.size, a.is_zip) <> (b.mtime_ms, b.size, b.is_zip) then 'changed' end change from a full join b using (layer, rx, rz)) where change is not null", "idx", _A, _B),
    "region_alternates": with_views("select * from o", "idx", _A, _OTHERS),
    "region_alternates_issue": with_views("select layer, count(distinct (rx, rz)) filter (not live and source = 'backup') orphan_backups, count(*) filter (source = 'conflict') conflicts, count(*) filter (source = 'conflict' and not live) orphan_conflicts from o group by layer", "idx", _A, _OTHERS),
    "region_sample": with_views("select layer, rx, rz, size from (select *, row_number() over (partition by layer order by rx, rz) - 1 r, ceil(count(*) over (partition by layer) / 50.0) step from f where size > 0) where r % step = 0 and floor(r / step) < 50", "idx", _ALL),
    "region_layer_stats": with_views(_STATS, "idx", _ALL),
    "region_archive_totals": with_views("select coalesce(layer, 'all') layer, cast(sum(regions) as bigint) regions, cast(sum(non_empty) as bigint) non_empty, cast(sum(bytes) as bigint) bytes, min(first_ms) first_ms, max(last_ms) last_ms from st group by rollup(layer)", "idx", _ALL, "st: " + _STATS),
    "region_explored_estimate": with_views("select layer, case when sampled > 0 then cast(round(chunks / sampled * sampleable) as bigint) end explored, sampled = sampleable exact from (select layer, count(*) filter (size > 0) sampleable, count(*) filter (size % 5 = 1) sampled, sum(case when size % 5 = 1 then size % 1024 else 0 end) chunks from f group by layer)", "idx", _ALL),
    "region_issues": with_views("select kind, detail, count(*) n, string_agg(path, ',' order by ord) filter (r <= 3) examples from (select *, row_number() over (partition by kind, detail order by ord) r from bad) group by kind, detail", "idx", "bad: select case when size = 0 then 'empty file' when size % 3 = 0 then 'truncated' else 'unreadable' end kind, case when size = 0 then '0 bytes' else 'code ' || cast(size % 7 as varchar) end detail, layer || '/' || rx || '_' || rz || case when is_zip then '.zip' else '.xaero' end path, ord from idx where size % 2 = 0"),
    "region_coverage": with_views(f"select layer, rx, rz, round(least(greatest(0, {NOW_MS} - mtime_ms) / 86400000.0::double / 720, 1.0::double), 9) age_tint from f", "idx", _ALL),
    "region_compare": with_views("select layer, count(*) filter (b.size is null) only_a, count(*) filter (a.size is null) only_b, count(*) filter (a.size is not null and b.size is not null) conflicts from a full join b using (layer, rx, rz) group by layer", "idx", _A, _B),
    "region_conflict_plan": with_views("select layer, rx, rz, case when b.mtime_ms > a.mtime_ms then 'b' else 'a' end primary_side, greatest(a.mtime_ms, b.mtime_ms) mtime_ms from a join b using (layer, rx, rz)", "idx", _A, _B),
    "region_upload_plan": with_views("select layer, rx, rz, case when a.mtime_ms > b.mtime_ms then 'stored' when a.mtime_ms is null then 'new' else 'upload' end wins, greatest(a.mtime_ms, b.mtime_ms) mtime_ms from b left join a using (layer, rx, rz)", "idx", _A, _B),
    "region_cold": with_views("select layer, rx, rz from f where not exists (select 1 from a where (a.layer, a.rx, a.rz, a.mtime_ms) = (f.layer, f.rx, f.rz, f.mtime_ms))", "idx", _ALL, _A),
    "region_paths": with_views("select 'w/' || layer || '/' || rx || '_' || rz || case when is_zip then '.zip' else '.xaero' end path, case when size < 1024 then size || ' B' when size < 102400 then printf('%.1f KiB', size / 1024.0::double) when size < 1048576 then printf('%.0f KiB', size / 1024.0::double) else printf('%.1f MiB', size / 1048576.0::double) end bytes, format('{:,}', size) size from f", "idx", _ALL),
    "name_parsing": with_views(_NAMES_SQL, "names"),
    "world_keys": with_views("select s_suppkey, world, base_domain, world_key from k", _W, _K),
    "world_pairs": with_views("select base_domain, world_a, world_b from (select distinct base_domain, world world_a from k where s_suppkey % 2 = 0) join (select distinct base_domain, world world_b from k where s_suppkey % 2 = 1) using (base_domain)", _W, _K),
    "nether_regions": with_views("select cast(floor(floor(x * 16 / 8.0) / 512.0) as int) rx, count(*) n from hl where dim = 'minecraft:overworld' group by 1", "hl"),
    "packed_numbers": "select o_orderkey, o_orderkey % 4096 - case when o_orderkey % 4096 >= 2048 then 4096 else 0 end height, cast(((v >> 11 & 31) * 255 + 15) // 31 as int) r, cast(((v >> 5 & 63) * 255 + 31) // 63 as int) g, cast(((v & 31) * 255 + 15) // 31 as int) b from (select *, o_custkey * 37 % 65536 v from orders)",
    "dimension_names": with_views("select ord, dim, replace(replace(dim, ':', '$'), '/', '%') folder, regexp_extract(dim, '[^/:]*$') shown, case when regexp_matches(replace(dim, '$', 'x'), '^[a-z0-9_./-]+:[a-z0-9_./-]+$') then replace(dim, '$', 'x') else '-' end normal from (select ord, regexp_replace(replace(name, '%', '/'), '\\$', ':') dim from names where starts_with(name, 'minecraft$'))", "names"),
    "cave_labels": "select p_partkey, case when p_partkey % 25 = 7 then 'Cave (full column)' else 'Cave Y ' || cast((p_partkey % 25 - 10) * 16 as varchar) || '..' || cast((p_partkey % 25 - 10) * 16 + 15 as varchar) end as label from part",
}
