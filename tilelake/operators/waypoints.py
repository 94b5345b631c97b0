"""Waypoint files as text, their union, and a history that remembers waypoints after they are deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLON = "§§"
#: The 16 text colours of the game and four dyes, by index.
COLOURS = [0x000000, 0x0000AA, 0x00AA00, 0x00AAAA, 0xAA0000, 0xAA00AA, 0xFFAA00, 0xAAAAAA, 0x555555, 0x5555FF, 0x55FF55, 0x55FFFF, 0xFF5555, 0xFF55FF, 0xFFFF55, 0xFFFFFF, 0xC74EBD, 0x3AB3DA, 0x80C71F, 0xF38BAA]
NO_HEIGHT = -100_000
KEY = ("world", "dim", "mw_file", "name", "x", "y_key", "z")
GROUP = ("world", "dim", "mw_file")
ATTRIBUTES = ("initials", "y", "color", "disabled", "purpose", "wp_set", "rotate_on_tp", "tp_yaw", "visibility_type", "destination")


def _whole(text: Column) -> Column:
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Waypoint records of text lines; other lines, and records without ten fields or whole x and z, are left out."""
    at = lambda k: F.get("__fields", F.lit(k))
    text = lambda k: F.replace(at(k), F.lit(COLON), F.lit(":"))
    flag = lambda k: F.coalesce(at(k) == "true", F.lit(False))
    number = lambda k: F.coalesce(_whole(at(k)), F.lit(0))
    fields = {
        "name": text(1), "initials": text(2), "x": _whole(at(3)), "y": _whole(at(4)), "z": _whole(at(5)), "color": number(6), "disabled": flag(7), "purpose": number(8), "wp_set": at(9),
        "rotate_on_tp": flag(10), "tp_yaw": number(11), "visibility_type": number(12), "destination": flag(13),
    }
    # A line is split once, in a step of its own, not for each field.
    cut = lines.where(F.col(line).startswith("waypoint:")).withColumn("__fields", F.split(F.col(line), ":"))
    out = cut.where(F.size("__fields") >= 10).withColumns(fields).drop("__fields")
    return out.where("x is not null and z is not null").withColumn("y_key", F.coalesce("y", F.lit(NO_HEIGHT)))


def format_line() -> Column:
    """A record as its line."""
    text = lambda c: F.replace(F.col(c), F.lit(":"), F.lit(COLON))
    number = lambda c: F.col(c).cast("string")
    return F.concat_ws(":", F.lit("waypoint"), text("name"), text("initials"), number("x"), F.coalesce(number("y"), F.lit("~")), number("z"), *map(number, ("color", "disabled", "purpose")), "wp_set", *map(number, ("rotate_on_tp", "tp_yaw", "visibility_type", "destination")))


def colour(index: Column) -> Column:
    rgb = F.element_at(F.array(*map(F.lit, COLOURS)), (F.pmod(index, F.lit(len(COLOURS))) + 1).cast("int"))
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(rgb), 6, "0")))


def union_lines(lines: DataFrame, group: list[str]) -> DataFrame:
    """Lines (group, side, ord, line) of both sides, each once, where it first occurs: all of A's, then B's others."""
    first = lines.groupBy(*group, "line").agg(F.min(F.struct("side", "ord")).alias("at"))
    return first.select(*group, "line", "at.side", "at.ord")


def union_files(lines: DataFrame, group: list[str]) -> DataFrame:
    """One waypoint file of two sides' lines (group, side, ord, line): group, part, side, ord, pos, text in that order.

    Names of sets come first (part 0), then records as the game writes them (1), then other lines (2), each text once, at its
    first place: a's before b's. Comments and blank lines go. A file that only one side has stays as it is (part 3).
    """
    sides = lines.groupBy(*group).agg((F.min("side") != F.max("side")).alias("both"))
    known = lines.join(sides, group)
    verbatim = known.where("not both").select(*group, F.lit(3).alias("part"), "side", "ord", F.lit(0).alias("pos"), F.col("line").alias("text"))
    text = known.where("both").withColumn("line", F.regexp_replace("line", r"\r+$", "")).where("line <> '' and not startswith(line, '#')")
    names = text.where("startswith(line, 'sets:')").select(*group, "side", "ord", F.posexplode(F.split(F.substring("line", 6, F.length("line")), ":")).alias("pos", "text")).where("text <> ''")
    rest = text.where("not startswith(line, 'sets:')")
    records = parse(rest)
    written = records.select(*group, F.lit(1).alias("part"), "side", "ord", F.lit(0).alias("pos"), format_line().alias("text"))
    f = F.split("line", ":")
    record = F.col("line").startswith("waypoint:") & (F.size(f) >= 10) & _whole(F.get(f, F.lit(3))).isNotNull() & _whole(F.get(f, F.lit(5))).isNotNull()
    other = rest.where(~record).select(*group, F.lit(2).alias("part"), "side", "ord", F.lit(0).alias("pos"), F.col("line").alias("text"))
    first = F.min(F.struct("part", "side", "ord", "pos")).alias("at")
    sets = names.select(*group, F.lit(0).alias("part"), "side", "ord", "pos", "text").groupBy(*group, "text").agg(first)
    body = written.union(other).groupBy(*group, "text").agg(first)
    return sets.union(body).select(*group, "at.*", "text").union(verbatim)


def sync(vault: DataFrame, batch: DataFrame, scanned: DataFrame, now_ms: int) -> DataFrame:
    """The history after a scan.

    batch: records with GROUP, KEY, ATTRIBUTES, source and ord; of one key the last by ord counts. scanned: the groups that
    were read, also where no record was found. Keys of the batch become present with last_seen now and keep their
    first_seen; other present keys of scanned groups are archived unless seen in this very millisecond.
    """
    values = F.struct(*ATTRIBUTES, "source")
    new = batch.groupBy(*KEY).agg(F.max_by(values, "ord").alias("new"))
    old = vault.select(*KEY, values.alias("old"), "present", "first_seen", "last_seen")
    groups = scanned.select(*GROUP).distinct().withColumn("scanned", F.lit(True))
    both = old.join(new, list(KEY), "full_outer").join(groups, list(GROUP), "left")
    hit = F.col("new").isNotNull()
    gone = F.col("scanned").isNotNull() & (F.col("last_seen") < now_ms)
    both = both.select(
        *KEY, F.coalesce("new", "old").alias("v"), F.when(hit, True).when(gone, False).otherwise(F.col("present")).alias("present"),
        F.coalesce("first_seen", F.lit(now_ms)).alias("first_seen"), F.when(hit, now_ms).otherwise(F.col("last_seen")).alias("last_seen"),
        F.col("present").alias("was_present"),
    )
    return both.select(*KEY, "v.*", "present", "first_seen", "last_seen", "was_present")


def sync_report(synced: DataFrame, seen: int, now_ms: int) -> DataFrame:
    """Counts of a sync: added, revived (net, before archiving, 0 at least), newly archived, and totals."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    hit = F.col("last_seen") == now_ms
    known = F.col("was_present").isNotNull()
    return synced.agg(
        F.lit(seen).cast("bigint").alias("seen"), one(~known).alias("added"), one(hit & known & ~F.col("was_present")).alias("revived"), one(known & F.col("was_present") & ~F.col("present")).alias("newly_archived"),
        F.count("*").alias("total"), one(~F.col("present")).alias("archived_total"),
    )


def world_counts(vault: DataFrame) -> DataFrame:
    return vault.groupBy("world").agg(F.count("*").alias("total"), F.count_if(~F.col("present")).alias("archived"))


def export(vault: DataFrame, with_archived: bool = False) -> DataFrame:
    """Lines of each group's present (or all) waypoints."""
    return (vault if with_archived else vault.where("present")).select(*GROUP, "name", format_line().alias("line"))


def visible(points: DataFrame, dim: str, text: str = "", with_archived: bool = False) -> DataFrame:
    """What a viewer shows: one dimension, not disabled, archived only if asked for, name containing text in any case."""
    out = points.where((F.col("dim") == dim) & ~F.col("disabled") & F.contains(F.lower("name"), F.lit(text.lower())))
    return out if with_archived else out.where("present")


def key_values(lines: DataFrame, line: str = "line") -> DataFrame:
    """key and value of settings lines; blank lines and // comments go, a line without colon has an empty value."""
    out = lines.where((F.trim(line) != "") & ~F.col(line).startswith("//"))
    return out.withColumns({"key": F.substring_index(line, ":", 1), "value": F.regexp_extract(line, "(?s)^[^:]*:(.*)$", 1)})


def dimension_types(lines: DataFrame, line: str = "line") -> DataFrame:
    """level and type of dimensionType:level:type lines, in which $ stands for the colon."""
    pattern = r"(?s)\AdimensionType:([^:]*):(.*?)\r*\z"
    field = lambda k: F.replace(F.regexp_extract(line, pattern, k), F.lit("$"), F.lit(":"))
    return lines.where(F.col(line).rlike(pattern)).withColumns({"level": field(1), "type": field(2)})


def first_values(pairs: DataFrame, group: list[str], order: str) -> DataFrame:
    """Of a key that is set several times, the first value."""
    return pairs.groupBy(*group, "key").agg(F.min_by("value", order).alias("value"))


def newer_file(files: DataFrame, key: str) -> DataFrame:
    """Of two sides' files the newer, of equal ones side A's."""
    return files.groupBy(key).agg(F.max_by(F.struct(*[c for c in files.columns if c != key]), F.struct(F.col("mtime_ms"), F.when(F.col("side") == "A", 1).otherwise(0).alias("first"))).alias("f")).select(key, "f.*")
