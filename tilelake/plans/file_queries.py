"""Queries that take tables through the archive's file forms and streams, and back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.operators import highlights as H
from tilelake.plans.highlight_queries import KEYS
from tilelake.plans.views import highlights, pixels, table, with_views
from tilelake.sources import files, regions, sinks
from tilelake.streaming import live as stream


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or in local mode a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tilelake-{uuid.uuid4().hex}"


def _batches(s, d):
    """Counts and sums of each dimension, through batches and back.

    Times of some 10^7 rows add up to more than 64 bits hold. They are summed as decimals, and time is a bigint, as the SQL
    says, while all sums fit one; beyond that (where the SQL's own cast fails) it is decimal(38, 0), never wrapped or null.
    """
    rows = files.decoded_batches(sinks.batches(highlights(s, d)), ["dim"]).where("error is null")
    return summed_times(rows, shared_folder(s))


def summed_times(rows, folder: str) -> DataFrame:
    """dim, n, time, place of rows (dim, x, z, found_time); folder: where the few sums are kept, as their size gives the type."""
    place = F.sum(F.col("x").cast("bigint") * 1000 + F.col("z")).alias("place")
    rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("found_time").cast("decimal(20,0)")).cast("decimal(38,0)").alias("time"), place).write.parquet(folder)
    sums = rows.sparkSession.read.schema("dim string, n long, time decimal(38,0), place long").parquet(folder)
    least, most = sums.agg(F.min("time"), F.max("time")).first()
    fits = most is None or (least >= -(1 << 63) and most < 1 << 63)
    return sums.withColumn("time", F.col("time").cast("bigint")) if fits else sums


def _containers(s, d):
    streams = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("stream"))
    back = files.containers(sinks.containers(streams))
    return back.select(F.col("path").cast("bigint").alias("doc_id"), F.octet_length("stream").cast("bigint").alias("bytes"), F.crc32("stream").alias("crc"))


def _databases(s, d):
    own = H.normalise(highlights(s, d), KEYS, "src", "ord").withColumn("path", F.concat(F.lit("x"), F.floor(F.col("x") / 64).cast("string"), F.lit("/highlights.db")))
    return files.highlight_databases(sinks.databases(own)).select("dim", "x", "z", "found_time")


def _pearls(s, d):
    p = F.struct(F.col("event_type").alias("uuid"), F.lit("minecraft:the_end").alias("dimensionKey"), F.floor("value").cast("int").alias("x"), F.lit(64).alias("y"), (F.col("event_id") % 7).cast("int").alias("z"))
    own = F.map_from_entries(F.array(F.struct(F.concat(F.lit("p"), F.col("event_id").cast("string")), p)))
    texts = table(s, d, "events").select(F.to_json(F.map_from_entries(F.array(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")), own)))).alias("json"))
    return files.pearls(texts).select("owner", "pearl", "uuid", "x", "y", "z")


def _settings(s, d):
    lines = table(s, d, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.element_at(F.array(*map(F.lit, ("MWName:mw$", "caveModeType:", "caveModeType:x", "dimensionTypeId:", "note "))), (F.col("c_custkey") % 5 + 1).cast("int")), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit(":a^col^b:"), F.col("c_mktsegment"))).otherwise("")).alias("line"))
    return files.dimension_settings(lines).select("ord", "kind", F.coalesce("id", F.lit("-")).alias("id"), "value")


def _codec(s, d):
    """Pixels as tiles of binary regions, written, read back and exploded again."""
    p = pixels(s, d)
    at = ((F.col("px") % 16) * 16 + F.col("pz") % 16).cast("int")
    place = {"tx": F.floor(F.col("px") / 16).cast("int"), "tz": F.floor(F.col("pz") / 16).cast("int")}
    known = p.groupBy(F.concat(F.lit("r"), F.col("region").cast("string")).alias("path"), *(v.alias(k) for k, v in place.items())).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.struct(F.col("r").cast("int").alias("h"), (F.col("g") % 3).cast("int").alias("s")).alias("v")))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(255))
    field = lambda f, none: F.transform(every, lambda k: F.coalesce(F.try_element_at(F.col("m"), k)[f], F.lit(none).cast("int")))
    fixed = {"chunk_ord": 0, "cx": 0, "cz": 0, "interp_version": 1, "cave_start": 0, "cave_depth": 0}
    nothing = F.array_repeat(F.lit(None).cast("int"), 256)
    tiles = known.select("path", "tx", "tz", *(F.lit(v).alias(k) for k, v in fixed.items()), F.array_repeat(F.lit(0).cast("long"), 256).alias("params"), field("s", None).alias("state"), field("h", -1).alias("height"), nothing.alias("top"), nothing.alias("biome"), F.array_repeat(F.expr("cast(array() as array<struct<params: bigint, state: int, opacity: int>>)"), 256).alias("overlays"))
    names = s.createDataFrame([(k, f"minecraft:b{k}", bytearray(regions.name_entry(f"minecraft:b{k}"))) for k in range(3)], "idx int, name string, raw binary")
    palette = tiles.select("path").distinct().select("path", F.explode(F.array(*map(F.lit, range(3)))).alias("idx")).join(F.broadcast(names), "idx").select("path", F.lit("state").alias("kind"), "idx", "raw", "name")
    written = sinks.containers(regions.regions(tiles, palette))
    back = regions.named(regions.tiles(written), regions.palettes(written))
    each = back.select("path", "tx", "tz", F.posexplode(F.arrays_zip("height", "state_name")).alias("k", "v")).where("v.height >= 0")
    return each.select("path", (F.col("tx") * 16 + F.shiftright("k", 4)).alias("px"), (F.col("tz") * 16 + F.col("k") % 16).alias("pz"), F.col("v.height").alias("height"), F.col("v.state_name").alias("state"))


def _stream_source(s: SparkSession, path: str) -> DataFrame:
    """A stream of one table; as a pattern, since a stream's path must not be a plain file."""
    return s.readStream.schema(s.read.parquet(path).schema).parquet(path.replace(".parquet", ".parque[t]"))


def _run(query) -> None:
    query.awaitTermination()


def stream_merge(s, d):
    """Sightings through a stream in small batches, folded into a table."""
    out = shared_folder(s)
    rows = highlights(_Streamed(s), d).select(*KEYS, "found_time")
    _run(rows.writeStream.foreachBatch(stream.merge_highlights(f"{out}/table")).option("checkpointLocation", f"{out}/offsets").trigger(availableNow=True).start())
    return stream.merged_highlights(s, f"{out}/table").select(*KEYS, "found_time")


class _Streamed:
    """A session whose Parquet reader streams, for views that are written for tables."""

    def __init__(self, spark: SparkSession):
        self.spark, self.read = spark, self

    def parquet(self, path: str) -> DataFrame:
        return _stream_source(self.spark, path)


QUERIES = {
    "file_highlight_batches": _batches,
    "file_region_containers": _containers,
    "file_highlight_databases": _databases,
    "file_pearls": _pearls,
    "file_dimension_settings": _settings,
    "file_json_report": lambda s, d: files.report(H.merge_report(highlights(s, d).where("side = 'A'"), highlights(s, d).where("side = 'B'"))),
    "region_codec_round_trip": _codec,
    "stream_highlight_merge": stream_merge,
}
_DUP = "one: select dim, x, z, found_time from (select *, row_number() over (partition by dim, x, z order by src, ord, side, found_time, height) n from hl) where n = 1"
ORACLES = {
    "file_highlight_batches": with_views("select dim, count(*) n, cast(sum(found_time) as bigint) as time, cast(sum(x * 1000 + z) as bigint) place from hl group by dim", "hl"),
    "file_highlight_databases": with_views("select * from one", "hl", _DUP),
    "file_pearls": "select 'u' || user_id as owner, 'p' || event_id as pearl, event_type uuid, cast(floor(value) as int) x, 64 y, cast(event_id % 7 as int) z from events",
    "file_dimension_settings": "select ord, kind, case kind when 'name' then split_part(rest, ':', 1) else '-' end id, case kind when 'name' then replace(substr(rest, instr(rest, ':') + 1), '^col^', ':') when 'other' then line else rest end as value from (select *, substr(line, instr(line, ':') + 1) rest, case ord % 5 when 0 then 'name' when 1 then 'cave_mode' when 3 then 'type' else 'other' end kind from (select c_custkey ord, list_extract(['MWName:mw$', 'caveModeType:', 'caveModeType:x', 'dimensionTypeId:', 'note '], c_custkey % 5 + 1) || c_nationkey || case when c_custkey % 5 = 0 then ':a^col^b:' || c_mktsegment else '' end line from customer))",
    "region_codec_round_trip": with_views("select 'r' || region path, cast(px as int) px, cast(pz as int) pz, cast(r as int) height, 'minecraft:b' || g % 3 state from pix", "pix"),
    "stream_highlight_merge": with_views("select dim, x, z, min(found_time) found_time from hl group by 1, 2, 3", "hl"),
}
