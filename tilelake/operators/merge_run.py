"""A merge of two archives from end to end: guards, pairs, plan, steps with written outputs, and a report.

An archive is tables: regions, other files, and what is inside those that are merged. Nothing of either side is written
to. The run is a chain of steps; each step's rows are written below out as Parquet, and then one small ledger entry says
where they are. A run that was broken off is resumed by running it again: a step with an entry is read, not made again; a
step without one leaves at most a folder that nobody names. A resumed run must be the same run, so the ledger begins with
a digest of its settings and of the archives' regions and files.

Without apply nothing is written below out, and the report says what would be done. A dry run of large archives should be
given a scratch folder for its steps' rows: without one each step is planned and computed with all steps before it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilelake.operators import index as I
from tilelake.operators import merging as M
from tilelake.operators import waypoints as W
from tilelake.sources.tables import Folder

UNIT = ["world", "key", "mw", "cave"]


@dataclass
class Archive:
    """One side. cave is null for the surface.

    regions: world, dim (folder), mw, cave, rx, rz, mtime_ms, size, is_zip, ord; as listed, several files of a place allowed.
    tiles: world, dim, mw, cave, rx, rz, tx, tz and values. unreadable: world, dim, mw, cave, rx, rz, or a condition on the
    best file of a place (mtime_ms, size, is_zip), so that nobody has to find these files twice.
    files: world, path (below the world), mtime_ms, size; of these the newer counts, none is merged.
    settings, waypoints: world, path, mtime_ms, ord, line. highlights: world, path, mtime_ms, dim, x, z, found_time.
    """

    root: str
    regions: DataFrame
    tiles: DataFrame
    unreadable: DataFrame | Column
    files: DataFrame
    settings: DataFrame
    waypoints: DataFrame
    highlights: DataFrame

    def has_worlds(self) -> bool:
        """Whether there is any: regions, other files and waypoints say which."""
        return not all(rows.isEmpty() for rows in (self.regions, self.files, self.waypoints))


@dataclass
class Options:
    apply: bool = False
    resume: bool = False
    prefer: str = "newer"
    auto_alias: bool = False
    servers: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = field(default=())


class MergeError(ValueError):
    """Why a merge doesn't begin, or can't go on."""


def overlap(a: str, b: str) -> bool:
    """Whether one of two folders is the other, or is inside it."""
    parts = [[p for p in x.split("://")[-1].split("/") if p not in ("", ".")] for x in (a.removeprefix("file:"), b.removeprefix("file:"))]
    n = min(map(len, parts))
    return parts[0][:n] == parts[1][:n]


class MergeRun:
    """run() gives the report; rows(step) what a step wrote or, in a dry run, would write."""

    def __init__(self, spark: SparkSession, a: Archive, b: Archive, out: str, options: Options = Options(), scratch: str | None = None):
        self.spark, self.a, self.b, self.out, self.options, self.scratch = spark, a, b, out.rstrip("/"), options, scratch
        self.folder: Folder | None = None
        self.done: dict[str, str] = {}
        #: Steps that this run made, in order; those that it found in the ledger aren't among them.
        self.made: list[str] = []
        self._rows: dict[str, DataFrame] = {}
        self._asides: dict[str, tuple[str | None, DataFrame]] = {}

    # --- guards and the ledger ---

    def _digest(self) -> str:
        """Of the settings, and of every region and file of both sides: one aggregate each."""
        seen = []
        for side in (self.a, self.b):
            for df in (side.regions, side.files):
                n, x = df.agg(F.count("*"), F.bit_xor(F.xxhash64(*sorted(df.columns)))).first()
                seen.append((n, x))
        o = self.options
        return hashlib.sha256(json.dumps([self.a.root, self.b.root, seen, o.prefer, o.auto_alias, sorted(o.servers), sorted(o.aliases)]).encode()).hexdigest()

    def _guard(self) -> None:
        if self.a.root.rstrip("/") == self.b.root.rstrip("/"):
            raise MergeError("both sides are the same folder")
        for name, side in (("a", self.a), ("b", self.b)):
            if overlap(self.out, side.root):
                raise MergeError(f"the output overlaps side {name}, and sources are never written to")
        for name, side in (("a", self.a), ("b", self.b)):
            if not side.has_worlds():
                raise MergeError(f"side {name} has no worlds")
        if not self.options.apply:
            return
        self.folder = Folder(self.spark, self.out)
        entries = self.folder.names("ledger")
        if not self.options.resume and self.folder.names(""):
            raise MergeError("the output isn't empty: resume goes on with a broken-off merge")
        digest = self._digest()
        if "0-run.json" in entries:
            if json.loads(self.folder.read("ledger/0-run.json"))["digest"] != digest:
                raise MergeError("the output belongs to another merge, or an archive has changed since it began")
        else:
            self.folder.create("ledger/0-run.json", json.dumps({"digest": digest}))
        for entry in entries:
            if entry.endswith(".json") and entry != "0-run.json":
                step = json.loads(self.folder.read(f"ledger/{entry}"))
                self.done[step["step"]] = step["at"]

    def _step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A step's rows: from the ledger, or made, written and entered."""
        if self.folder is None:
            rows = make()
            if self.scratch:
                rows.write.parquet(f"{self.scratch}/{name}")
                rows = self.spark.read.parquet(f"{self.scratch}/{name}")
            self._rows[name] = rows
        else:
            if name not in self.done:
                at = f"steps/{name}-{uuid.uuid4().hex}"
                make().write.parquet(f"{self.out}/{at}")
                self.folder.create(f"ledger/{len(self.done) + 1}-{name}.json", json.dumps({"step": name, "at": at}))
                self.done[name] = at
                self.made.append(name)
            self._rows[name] = self.spark.read.parquet(f"{self.out}/{self.done[name]}")
        return self._rows[name]

    def rows(self, step: str) -> DataFrame:
        return self._rows[step]

    def _aside(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """Rows that several steps read, so that what they are made of is read once: written beside the steps, without an entry."""
        if name not in self._asides:
            rows, root, at = make(), self.out if self.folder is not None else self.scratch, None
            if root:
                at = f"{root}/aside-{name}-{uuid.uuid4().hex}"
                rows.write.parquet(at)
                rows = self.spark.read.schema(rows.schema).parquet(at)
            self._asides[name] = at, rows
        return self._asides[name][1]

    def _clear(self) -> None:
        """Once no step is left that reads them, what was written aside goes."""
        for at, _ in self._asides.values():
            if at:
                Folder(self.spark, at).delete("")
        self._asides.clear()

    # --- the steps ---

    def _listed(self) -> DataFrame:
        """side, world, dim, mw, cave and the best file of each place: one aggregate over all regions, before any join."""
        place = ("world", "dim", "mw", "cave", "rx", "rz")

        def make():
            # A hash of the place goes first, as files are sorted by place: one number is compared, not four names.
            files = (s.regions.select(F.xxhash64(*place).alias("hash"), *place, *I.META, "ord") for s in (self.a, self.b))
            a, b = (I.best_files(f, ("hash", *place)).select(F.lit(n).alias("side"), *place, *I.META) for n, f in zip("AB", files))
            return a.union(b)

        return self._aside("listed", make)

    def _worlds(self, side: str) -> DataFrame:
        def make():
            found = self._listed().select("side", "world")
            for n, s in (("A", self.a), ("B", self.b)):
                found = found.union(s.files.select(F.lit(n), "world")).union(s.waypoints.select(F.lit(n), "world"))
            return found.distinct()

        worlds = self._aside("worlds", make).where(F.col("side") == side).select("world")
        return worlds.where(F.col("world").isin(*self.options.servers)) if self.options.servers else worlds

    def _pairs(self) -> DataFrame:
        """world_a, world_b, how, taken_by, out: what belongs together, and worlds that are copied whole under their names."""
        a, b = self._worlds("A"), self._worlds("B")
        aliases = self.spark.createDataFrame([*self.options.aliases], "x string, y string") if self.options.aliases else None
        found = M.pair_worlds(a, b, aliases, self.options.auto_alias)
        paired = found.where(F.col("how").isin("exact", "alias", "domain"))
        nothing = F.lit(None).cast("string")
        only_a = a.join(paired.select(F.col("world_a").alias("world")), "world", "left_anti").select(F.col("world").alias("world_a"), nothing.alias("world_b"), F.lit("only a").alias("how"), nothing.alias("taken_by"))
        only_b = b.join(paired.select(F.col("world_b").alias("world")), "world", "left_anti").select(nothing.alias("world_a"), F.col("world").alias("world_b"), F.lit("only b").alias("how"), nothing.alias("taken_by"))
        out = F.when(~F.col("how").isin("blocked", "suggested"), F.coalesce("world_b", "world_a"))
        return found.unionByName(only_a).unionByName(only_b).withColumn("out", out)

    def _side(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows of a side with out, the world that they go to; those of other worlds go."""
        to = self._rows["pairs"].where("out is not null").select(F.col(f"world_{name}").alias("world"), "out").where("world is not null")
        return rows.join(to, "world").drop("world").withColumnRenamed("out", "world")

    def _units(self) -> DataFrame:
        layers = self._listed().select("side", "world", "dim", "mw", "cave").distinct()
        a, b = (self._side(n.lower(), layers.where(F.col("side") == n)).select("side", "world", "dim", "mw", "cave") for n in "AB")
        return M.layer_units(a.union(b))

    def _layered(self, name: str, rows: DataFrame, *more: str) -> DataFrame:
        """Rows of a side by layer: the unit's columns packed as one, a place's columns, and more."""
        units = self._rows["units"].where(F.col(name).isNotNull())
        layer = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("surface")).alias(c) for c in UNIT))
        at = units.select("world", F.col(name).alias("dim"), "mw", F.coalesce("cave", F.lit(FULL)).alias("depth"), layer.alias("layer"))
        own = self._side(name, rows).withColumn("depth", F.coalesce("cave", F.lit(FULL)))
        return own.join(at, ["world", "dim", "mw", "depth"]).select("layer", "rx", "rz", *more)

    def _plan(self) -> DataFrame:
        a, b = (self._layered(n.lower(), self._listed().where(F.col("side") == n), "mtime_ms", "size") for n in "AB")
        return M.plan(a, b, self.options.prefer)

    def _unreadable(self) -> DataFrame:
        def make():
            bad = {n: self._listed().where(F.col("side") == n).where(s.unreadable) if isinstance(s.unreadable, Column) else s.unreadable for n, s in (("A", self.a), ("B", self.b))}
            a, b = (self._layered(n.lower(), rows).withColumn("side", F.lit(n)) for n, rows in bad.items())
            return a.union(b)

        return self._aside("unreadable", make)

    def _tiles(self) -> DataFrame:
        values = [c for c in self.a.tiles.columns if c not in ("world", "dim", "mw", "cave", "rx", "rz")]
        a, b = (self._layered(n, s.tiles, *values) for n, s in (("a", self.a), ("b", self.b)))
        return M.merge_tiles(self._rows["plan"], a, b, self._unreadable())[0]

    def _regions(self) -> DataFrame:
        """Counted in the tiles that were written: these aren't merged again."""
        return M.merged_regions(self._rows["plan"], self._rows["tiles"], self._unreadable())

    def _both(self, what: str, *columns: str) -> DataFrame:
        a, b = (self._side(n.lower(), getattr(s, what)).select(F.lit(n).alias("side"), *columns) for n, s in (("A", self.a), ("B", self.b)))
        return a.union(b)

    def _files(self) -> DataFrame:
        """Other files: the newer of two, with the side that it is copied from."""
        return W.newer_file(self._both("files", "world", "path", "mtime_ms", "size").withColumn("file", F.struct("world", "path")), "file").select("world", "path", "side", "mtime_ms", "size")

    def _settings(self) -> DataFrame:
        lines = self._both("settings", "world", "path", "mtime_ms", "ord", "line")
        return M.merge_settings(lines.withColumn("file", F.struct("world", "path")), "file").select("file.*", "ord", "line")

    def _waypoints(self) -> DataFrame:
        return W.union_files(self._both("waypoints", "world", "path", "ord", "line"), ["world", "path"])

    def _highlights(self) -> DataFrame:
        """Each place's oldest sighting, whether each side has the place, and the time of that side's file: all highlights once."""
        rows = self._both("highlights", "world", "path", "mtime_ms", "dim", "x", "z", "found_time")
        of = {s: F.col("side") == s.upper() for s in "ab"}
        has, times = (F.max(own).alias(f"in_{s}") for s, own in of.items()), (F.max(F.when(own, F.col("mtime_ms"))).alias(f"{s}_ms") for s, own in of.items())
        return rows.groupBy("world", "path", "dim", "x", "z").agg(F.min("found_time").alias("found_time"), *has, *times)

    def _databases(self) -> DataFrame:
        """For each database of both sides and dimension: rows before, of the other side, of both and after; the newer is the base.

        Counted in the merged rows that were written, so the databases aren't read again.
        """
        counts = {"a": F.count_if("in_a"), "b": F.count_if("in_b"), "overlap": F.count_if(F.col("in_a") & F.col("in_b")), "dest_after": F.count("*")}
        dims = self._rows["highlights"].groupBy("world", "path", "dim").agg(*(v.alias(k) for k, v in counts.items()), F.max("a_ms").alias("a_ms"), F.max("b_ms").alias("b_ms"))
        database = Window.partitionBy("world", "path")
        known = dims.withColumns({"a_all": F.sum("a").over(database), "b_all": F.sum("b").over(database), "a_ms": F.max("a_ms").over(database), "b_ms": F.max("b_ms").over(database)}).where("a_all > 0 and b_all > 0")
        by_b = M.newer_is_b()
        source, dest = F.when(by_b, F.col("a")).otherwise(F.col("b")), F.when(by_b, F.col("b")).otherwise(F.col("a"))
        return known.select("world", "path", "dim", source.alias("source_rows"), dest.alias("dest_before"), "overlap", "dest_after")

    # --- the run ---

    def run(self) -> DataFrame:
        """section, world, item, name, n: pairs, layers, databases and files of the merge, a row for each count or message."""
        self._guard()
        try:
            return self._run()
        finally:
            self._clear()

    def _run(self) -> DataFrame:
        self._step("pairs", self._pairs)
        units = self._step("units", self._units)
        mixed = units.where("mixed is not null").select("world", "key", "mixed").first()
        if mixed is not None:
            raise MergeError(f"world {mixed[0]}: side {mixed[2]} has two folders of {mixed[1]}: make them one first")
        self._step("plan", self._plan)
        for name, make in (("tiles", self._tiles), ("regions", self._regions), ("files", self._files), ("settings", self._settings), ("waypoints", self._waypoints), ("highlights", self._highlights), ("databases", self._databases)):
            self._step(name, make)
        return self._step("report", self._report)

    def _report(self) -> DataFrame:
        def each(df: DataFrame, section: str, world: str, item, counts: list[str]) -> DataFrame:
            stacked = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in counts)))
            return df.select(F.lit(section).alias("section"), F.col(world).alias("world"), item.alias("item"), stacked.alias("x")).select("section", "world", "item", "x.*")

        rows = self._rows
        one = lambda df: df.withColumn("n", F.lit(1))
        pairs = rows["pairs"].select(F.lit("world").alias("section"), F.coalesce("world_a", "world_b").alias("world"), F.coalesce("taken_by", F.when(F.col("world_a").isNotNull(), F.col("world_b")), F.lit("-")).alias("item"), F.col("how").alias("name"), F.lit(1).cast("long").alias("n"))
        layer = F.concat_ws("/", *(F.col(f"layer.{c}") for c in UNIT[1:]))
        planned = M.plan_report(rows["plan"])
        noted = one(rows["regions"].where("note is not null").withColumn("world", F.col("layer.world")))
        noted = noted.select(F.lit("note").alias("section"), "world", F.concat_ws("/", layer, "rx", "rz").alias("item"), F.col("note").alias("name"), F.col("n").cast("long").alias("n"))
        out = pairs.union(each(planned.withColumn("world", F.col("layer.world")), "layer", "world", layer, ["only_a", "only_b", "conflicts", "regions_out", "bytes"])).union(noted)
        out = out.union(each(rows["databases"], "database", "world", F.concat_ws("/", "path", "dim"), ["source_rows", "dest_before", "overlap", "dest_after"]))
        for name in ("files", "settings", "waypoints"):
            n = rows[name].groupBy("world").agg(F.countDistinct("path").alias("n"))
            out = out.union(n.select(F.lit("files").alias("section"), "world", F.lit("-").alias("item"), F.lit(name).alias("name"), "n"))
        return out


#: Stands for the surface where a cave's depth is compared; no cave has it, as depths are far smaller.
FULL = 1 << 30
