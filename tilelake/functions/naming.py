"""Names of files and folders in an archive, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION_FOLDERS = {"null": "minecraft:overworld", "DIM0": "minecraft:overworld", "DIM-1": "minecraft:the_nether", "DIM1": "minecraft:the_end"}
MINIMAP_FOLDERS = {"Overworld": "minecraft:overworld", "Nether": "minecraft:the_nether", "The End": "minecraft:the_end", "dim%0": "minecraft:overworld", "dim%-1": "minecraft:the_nether", "dim%1": "minecraft:the_end"}
DISPLAY = {"minecraft:overworld": "Overworld", "minecraft:the_nether": "Nether", "minecraft:the_end": "The End"}
FULL_CAVE = -(1 << 31)
_REGION = r"^(-?[0-9]+)_(-?[0-9]+)\.(zip|xaero)$"
_MULTIWORLD = r"^(?:mw\$|cm\$|mw-?[0-9]+,-?[0-9]+,-?[0-9]+$)"
_TRANSIENT = r"(?:\.temp|\.outdated|\.tmp-xt|\.xwmc|\.db-wal|\.db-shm|\.db-journal|\.backup[0-9]+(?:-xp-[0-9]+)?)$|^\.lock$|\.zip\.tmp|\.sync-conflict-"


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in values.items() for v in kv)), key)


def _int(name: Column, pattern: str, group: int) -> Column:
    """A matched group as a 32-bit number; null where nothing matches or it's out of range."""
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, group).try_cast("int"))


def region_coordinates(name: Column) -> tuple[Column, Column, Column]:
    """rx, rz and is_zip of a region file's name, null if it is none."""
    rx, rz = _int(name, _REGION, 1), _int(name, _REGION, 2)
    both = rx.isNotNull() & rz.isNotNull()
    return F.when(both, rx), F.when(both, rz), F.when(both, F.regexp_extract(name, _REGION, 3) == "zip")


def region_filename(rx: Column, rz: Column, is_zip: Column) -> Column:
    return F.concat(rx.cast("string"), F.lit("_"), rz.cast("string"), F.when(is_zip, ".zip").otherwise(".xaero"))


def escape_id(resource: Column) -> Column:
    return F.replace(F.replace(resource, F.lit(":"), F.lit("$")), F.lit("/"), F.lit("%"))


def unescape_id(folder: Column) -> Column:
    """Only the first $ parts the namespace; every % was a slash."""
    return F.regexp_replace(F.replace(folder, F.lit("%"), F.lit("/")), r"^([^$]*)\$", "$1:")


def is_multiworld(name: Column) -> Column:
    return name.rlike(_MULTIWORLD)


def dimension_of_folder(folder: Column) -> Column:
    """Resource key of a world map's dimension folder, null if it is none."""
    return F.coalesce(_lookup(folder, DIMENSION_FOLDERS), F.when(F.contains(folder, F.lit("$")) & ~is_multiworld(folder), unescape_id(folder)))


def dimension_of_minimap_folder(folder: Column) -> Column:
    return F.coalesce(_lookup(folder, MINIMAP_FOLDERS), F.when(folder.startswith("dim%"), unescape_id(F.substring(folder, 5, 1 << 20))))


def folder_of_dimension(resource: Column, null_overworld: bool = True) -> Column:
    named = {"minecraft:overworld": "null" if null_overworld else "DIM0", "minecraft:the_nether": "DIM-1", "minecraft:the_end": "DIM1"}
    return F.coalesce(_lookup(resource, named), escape_id(resource))


def display_name(resource: Column) -> Column:
    last = F.regexp_extract(resource, "[^/:]*$", 0)
    return F.coalesce(_lookup(resource, DISPLAY), F.when(last == "", resource).otherwise(last))


def backup_version(name: Column) -> tuple[Column, Column, Column]:
    """major, minor and slot of a folder that holds regions of another save version."""
    pattern = r"^(-?[0-9]+)_backup_([0-9]+)$"
    version = _int(name, pattern, 1)
    slot = F.when(version.isNotNull(), F.regexp_extract(name, pattern, 2).try_cast("bigint"))
    return F.shiftright(version, 16), version.bitwiseAND(0xFFFF), slot


def sync_conflict(name: Column) -> tuple[Column, Column, Column, Column]:
    """rx, rz, is_zip and tag of a conflict copy of a region file."""
    pattern = r"^(-?[0-9]+)_(-?[0-9]+)\.sync-conflict-(.*)\.(zip|xaero)$"
    hit = name.rlike(pattern)
    return _int(name, pattern, 1), _int(name, pattern, 2), F.when(hit, F.regexp_extract(name, pattern, 4) == "zip"), F.when(hit, F.regexp_extract(name, pattern, 3))


def waypoint_file(name: Column) -> tuple[Column, Column]:
    """Multiworld id (null for the old single file) and display name of a waypoint file."""
    stem = F.regexp_extract(name, r"^(.*)\.txt$", 1)
    parts = F.split(stem, "_")
    text, old = name.endswith(".txt"), stem == "waypoints"
    named = text & ~old & (F.size(parts) >= 2)
    return F.when(named, F.get(parts, F.lit(0))), F.when(text & old, stem).when(named, F.replace(F.get(parts, F.lit(1)), F.lit("%us%"), F.lit("_")))


def cave_label(layer: Column) -> Column:
    low = layer.cast("bigint") * 16
    return F.when(layer == FULL_CAVE, "Cave (full column)").otherwise(F.concat(F.lit("Cave Y "), low.cast("string"), F.lit(".."), (low + 15).cast("string")))


def is_transient(name: Column) -> Column:
    return name.rlike(_TRANSIENT)


def is_cache_folder(name: Column) -> Column:
    return name.rlike("^(?:cache|caches|cache_[0-9]+)$")


def is_minimap_backup(name: Column) -> Column:
    return name.rlike("^backup-*$")


def base_domain(world: Column) -> Column:
    """What worlds of one server share: no prefix, all trailing .org, then .net, then .com, lower case."""
    out = F.regexp_replace(world, "^Multiplayer_", "")
    for suffix in ("org", "net", "com"):
        out = F.regexp_replace(out, rf"(?:\.{suffix})+$", "")
    return F.lower(out)


def world_key(world: Column) -> Column:
    """The viewer's looser key: one suffix only, in either case."""
    return F.lower(F.regexp_replace(F.regexp_replace(world, "^Multiplayer_", ""), r"(?i)\.(?:org|net|com)$", ""))


def normalise_dimension(name: Column) -> Column:
    """A reported dimension as resource key; null if it is neither an alias nor namespace:path."""
    bare = F.trim(name)
    return (
        F.when(bare.isin("overworld", "minecraft:overworld"), "minecraft:overworld")
        .when(bare.isin("nether", "the_nether", "minecraft:the_nether"), "minecraft:the_nether")
        .when(bare.isin("end", "the_end", "minecraft:the_end"), "minecraft:the_end")
        .when(bare.rlike("^[a-z0-9_./-]{1,128}:[a-z0-9_./-]{1,128}$"), bare)
    )


def safe_segment(name: Column) -> Column:
    """Whether a client may name this path segment: no separators, no hidden files."""
    return name.rlike(r"^(?!\.)[A-Za-z0-9 _\-.$%()',+&@~]{1,128}$")


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("bigint"), 0)


def binary_bytes(n: Column) -> Column:
    """Bytes in binary units: one decimal below 100, none from there on."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        v = n / float(1024**k)
        text = F.concat(F.when(v < 100, F.format_string("%.1f", F.bround(v, 1))).otherwise(F.format_string("%.0f", F.bround(v, 0))), F.lit(f" {unit}"))
        out = out.when(v < 1024, text) if k < 5 else out.otherwise(text)
    return out


def layer_of_spec(spec: Column, prefix: str = "cave:") -> Column:
    """surface, or the number behind the prefix, as text; null for anything else. No spec means the surface."""
    number = _int(spec, f"^{prefix}([+-]?[0-9]+)$", 1)
    return F.when(spec.isNull() | (spec == "surface"), "surface").otherwise(number.cast("string"))


def tint(text: Column) -> Column:
    """RRGGBB, with or without #, as a number; null for anything else."""
    digits = F.regexp_extract(text, r"\A\s*#*([0-9a-fA-F]{6})\s*\z", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("int"))


def roof(text: Column) -> tuple[Column, Column]:
    """Opacities of obsidian and snow in a see-through roof, from two numbers up to 255 with a comma between."""
    pattern = r"\A\s*\+?([0-9]+)\s*,\s*\+?([0-9]+)\s*\z"
    obsidian, snow = _int(text, pattern, 1), _int(text, pattern, 2)
    both = (obsidian <= 255) & (snow <= 255)
    return F.when(both, obsidian), F.when(both, snow)


def cave_mode(number: Column) -> Column:
    return F.when(number == 0, "Off").when(number == 1, "Layered").when(number == 2, "Full")


def safe_dimension_key(name: Column) -> Column:
    """Whether a client may name this dimension: lower case, namespace and path, at most 128 characters."""
    return name.rlike(r"\A[a-z0-9:_./-]{1,128}\z") & F.contains(name, F.lit(":"))


def day(ms: Column) -> Column:
    """YYYY-MM-DD of milliseconds since 1970, in UTC whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")).cast("string")
