"""Region indexes: one row for each region file, and what scans, diffs, statistics and diagnoses make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilelake.functions.coords import BUCKET_REGIONS, bucket_of_region

KEY = ("layer", "rx", "rz")
DAY_MS = 86_400_000


def best_files(files: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """One file for each coordinate: a .zip beats a bare one, then the newest, then the first listed.

    Structs are compared, so files are sorted by keys: of many files of a place, the first key had better tell places apart.
    """
    rank = F.struct(F.col("is_zip").cast("int").alias("zip"), F.col("mtime_ms"), (-F.col("ord")).alias("neg"))
    kept = F.struct("mtime_ms", "size", "is_zip", "ord")
    return files.groupBy(*keys).agg(F.max_by(kept, rank).alias("f")).select(*keys, "f.*")


def bounds(index: DataFrame) -> DataFrame:
    return index.groupBy("layer").agg(F.min("rx").alias("rx0"), F.min("rz").alias("rz0"), F.max("rx").alias("rx1"), F.max("rz").alias("rz1"))


def in_range(index: DataFrame, x0: int, z0: int, span: int) -> DataFrame:
    """Regions of a half-open square. With bucket columns bx and bz, as an index is best partitioned by, they prune too."""
    out = index.where((F.col("rx") >= x0) & (F.col("rx") < x0 + span) & (F.col("rz") >= z0) & (F.col("rz") < z0 + span))
    for c, lo in (("bx", x0), ("bz", z0)):
        if c in index.columns:
            out = out.where(F.col(c).between(lo // BUCKET_REGIONS, (lo + span - 1) // BUCKET_REGIONS))
    return out


def with_buckets(index: DataFrame) -> DataFrame:
    return index.withColumns({"bx": bucket_of_region(F.col("rx")), "bz": bucket_of_region(F.col("rz"))})


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """layer, rx, rz, change: added, removed or changed between two snapshots; what differs in neither is left out."""
    both = old.select(*KEY, F.struct("mtime_ms", "size", "is_zip").alias("o")).join(new.select(*KEY, F.struct("mtime_ms", "size", "is_zip").alias("n")), list(KEY), "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.select(*KEY, change.alias("change")).where("change is not null")


def alternates(live: DataFrame, others: DataFrame) -> DataFrame:
    """Other copies of regions with live: whether the coordinate has a live file."""
    known = live.select(*KEY).distinct().withColumn("live", F.lit(True))
    return others.join(known, list(KEY), "left").withColumn("live", F.coalesce("live", F.lit(False)))


def sample(index: DataFrame, n: int) -> DataFrame:
    """n non-empty regions of each layer, evenly spaced in the order of coordinates; 0 takes all.

    Ranks within a column of regions (layer, rx) plus sums over the columns give the rank in a layer, so that no task
    orders a whole layer.
    """
    some = index.where("size > 0")
    columns = some.groupBy("layer", "rx").agg(F.count("*").alias("n"))
    along = Window.partitionBy("layer").orderBy("rx")
    columns = columns.select("layer", "rx", (F.sum("n").over(along) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("layer")).alias("all"))
    own = F.row_number().over(Window.partitionBy("layer", "rx").orderBy("rz")) - 1
    ranked = some.withColumn("own", own).join(columns, ["layer", "rx"]).withColumn("rank", F.col("before") + F.col("own"))
    if n:
        step = F.ceil(F.col("all") / n)
        ranked = ranked.where((F.col("rank") % step == 0) & (F.floor(F.col("rank") / step) < n))
    return ranked.drop("own", "before", "all", "rank")


def layer_stats(index: DataFrame) -> DataFrame:
    """Regions, bytes, bounds and times of each layer; time 0 is unknown."""
    known = F.when(F.col("mtime_ms") != 0, F.col("mtime_ms"))
    return index.groupBy("layer").agg(
        F.count("*").alias("regions"), F.count_if(F.col("size") > 0).alias("non_empty"), F.sum("size").alias("bytes"), F.count_if("is_zip").alias("zips"),
        F.min("rx").alias("rx0"), F.max("rx").alias("rx1"), F.min("rz").alias("rz0"), F.max("rz").alias("rz1"), F.min(known).alias("first_ms"), F.max(known).alias("last_ms"),
    )


def totals(stats: DataFrame) -> DataFrame:
    """Layer statistics and their sum over all layers, as layer 'all'."""
    out = stats.rollup("layer").agg(F.sum("regions").alias("regions"), F.sum("non_empty").alias("non_empty"), F.sum("bytes").alias("bytes"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    return out.withColumn("layer", F.coalesce("layer", F.lit("all")))


def probe_versions(probes: DataFrame) -> DataFrame:
    """How many probed files (layer, version) of each layer are of each save version; ? where it couldn't be read."""
    return probes.groupBy("layer", F.coalesce("version", F.lit("?")).alias("version")).agg(F.count("*").alias("n"))


def version_histogram(probes: DataFrame) -> DataFrame:
    """How many probed files of each layer, and of the whole archive as layer 'all', are of each save version."""
    own = probe_versions(probes)
    return own.unionByName(own.groupBy("version").agg(F.sum("n").alias("n")).withColumn("layer", F.lit("all")))


def probe_stats(probes: DataFrame) -> DataFrame:
    """Files probed in each layer, those cut short or unreadable, and chunks found (layer, truncated, error, chunks)."""
    return probes.groupBy("layer").agg(F.count("*").alias("sampled"), F.count_if("truncated").alias("truncated"), F.count("error").alias("unreadable"), F.sum("chunks").alias("chunks"))


def explored_estimate(sampled: Column, chunks: Column, sampleable: Column) -> Column:
    """Explored chunks of a layer from those in its sampled regions; null without a sample."""
    return F.when(sampled > 0, F.round(chunks / sampled * sampleable).cast("bigint"))


#: Parts that a cause's files are dealt into.
ISSUE_PARTS = 64


def issues(files: DataFrame) -> DataFrame:
    """Issues (kind, detail, path, ord) grouped by cause, with how many and the first three paths.

    A cause's files are ranked in ISSUE_PARTS parts first; three of each part are left for the cause itself.
    """
    part = Window.partitionBy("kind", "detail", F.pmod(F.xxhash64("ord", "path"), F.lit(ISSUE_PARTS)))
    first = files.withColumns({"n": F.row_number().over(part.orderBy("ord")), "all": F.count("*").over(part)}).where("n <= 3")
    examples = F.slice(F.array_sort(F.collect_list(F.struct("ord", "path"))), 1, 3)["path"]
    return first.groupBy("kind", "detail").agg(F.sum(F.when(F.col("n") == 1, F.col("all"))).alias("n"), F.array_join(examples, ",").alias("examples"))


def alternates_issue(others: DataFrame) -> DataFrame:
    """For each layer: coordinates with only a backup, copies beside a live file, and conflict copies without one."""
    place = F.struct("rx", "rz")
    return others.groupBy("layer").agg(
        F.countDistinct(F.when(~F.col("live") & (F.col("source") == "backup"), place)).alias("orphan_backups"),
        F.count_if(F.col("source") == "conflict").alias("conflicts"),
        F.count_if((F.col("source") == "conflict") & ~F.col("live")).alias("orphan_conflicts"),
    )


def coverage(index: DataFrame, now_ms: int) -> DataFrame:
    """A region's tint by age: from 0 (new) to 1 (720 days or older)."""
    age = F.greatest(F.lit(0), F.lit(now_ms) - F.col("mtime_ms")) / DAY_MS
    return index.select(*KEY, F.least(age / 720, F.lit(1.0)).alias("age_tint"))


#: Pixels of a tile's side, and the fixed colours of coverage: for a new region, less so much for one of 720 days or more.
TILE_PIXELS, NEW_COLOUR, FADED, FADE_DAYS, COVERAGE_ALPHA = 512, (110, 150, 190), (40, 60, 80), 720, 230


def coverage_rectangles(index: DataFrame, zoom: int, now_ms: int) -> DataFrame:
    """layer, x, y, px, py, side, r, g, b, a: where regions lie in tiles 2^-zoom regions wide (zoom below 0), tinted by age.

    Regions smaller than a pixel share it; the last in the order of coordinates shows. One aggregate by pixel.
    """
    span = 1 << -zoom
    days = F.least(F.floor(F.greatest(F.lit(0), F.lit(now_ms) - F.col("mtime_ms")) / DAY_MS), F.lit(FADE_DAYS))
    colour = [F.floor((FADE_DAYS * new - less * days) / FADE_DAYS).alias(c) for c, new, less in zip("rgb", NEW_COLOUR, FADED)]
    pixel = lambda c: F.floor(F.pmod(F.col(c), F.lit(span)) * TILE_PIXELS / span).cast("int")
    tile = lambda c: F.floor(F.col(c) / span).cast("bigint")
    placed = index.select("layer", tile("rx").alias("x"), tile("rz").alias("y"), pixel("rx").alias("px"), pixel("rz").alias("py"), F.struct("rx", "rz").alias("at"), F.struct(*colour).alias("c"))
    shown = placed.groupBy("layer", "x", "y", "px", "py").agg(F.max_by("c", "at").alias("c"))
    return shown.select("layer", "x", "y", "px", "py", F.lit(max(1, TILE_PIXELS // span)).alias("side"), "c.*", F.lit(COVERAGE_ALPHA).alias("a"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each layer: regions that only a has, only b has, and that both have."""
    both = a.select(*KEY, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*KEY, F.lit(0).alias("a"), F.lit(1).alias("b")))
    at = both.groupBy(*KEY).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return at.groupBy("layer").agg(*(F.count_if(F.expr(e)).alias(n) for n, e in (("only_a", "a > b"), ("only_b", "b > a"), ("conflicts", "a = b"))))


def conflict_plan(a: DataFrame, b: DataFrame) -> DataFrame:
    """Regions of both sides: the primary is the newer (of equal ones a), and the merged time the greater."""
    x, y = (s.select(*KEY, F.col("mtime_ms").alias(f"{n}_ms")) for s, n in ((a, "a"), (b, "b")))
    return x.join(y, list(KEY)).select(*KEY, F.when(F.col("b_ms") > F.col("a_ms"), "b").otherwise("a").alias("primary_side"), F.greatest("a_ms", "b_ms").alias("mtime_ms"))


def upload_plan(stored: DataFrame, uploads: DataFrame) -> DataFrame:
    """Uploads against stored regions: the stored one wins only if strictly newer."""
    x = stored.select(*KEY, F.col("mtime_ms").alias("old_ms"))
    y = uploads.select(*KEY, F.col("mtime_ms").alias("new_ms"))
    return y.join(x, list(KEY), "left").select(*KEY, F.when(F.col("old_ms") > F.col("new_ms"), "stored").when(F.col("old_ms").isNull(), "new").otherwise("upload").alias("wins"), F.greatest("old_ms", "new_ms").alias("mtime_ms"))


def cold(index: DataFrame, thumbs: DataFrame) -> DataFrame:
    """Regions whose thumbnail isn't there or is of another time."""
    return index.join(thumbs.select(*KEY, "mtime_ms"), [*KEY, "mtime_ms"], "left_anti")


#: What a region file's row says of the file.
META = ("mtime_ms", "size", "is_zip")


def deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """layer, rx, rz, change and the new META: what turns index old into index new. Rows that agree are left out."""
    both = old.select(*KEY, F.struct(*META).alias("o")).join(new.select(*KEY, F.struct(*META).alias("n")), list(KEY), "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.select(*KEY, change.alias("change"), *(F.col(f"n.{c}") for c in META)).where("change is not null")


def apply_deltas(index: DataFrame, changes: DataFrame) -> DataFrame:
    """index after deltas."""
    fresh = changes.where("change <> 'removed'").select(*KEY, *META)
    return index.select(*KEY, *META).join(changes.select(*KEY), list(KEY), "left_anti").unionByName(fresh)
