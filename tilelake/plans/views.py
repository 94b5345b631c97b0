"""Map-shaped views of the tables: highlights, region index, pixels, level-of-detail cells, waypoints, positions, names.

Each view is a DataFrame; VIEWS holds the same as SQL for DuckDB, which with_views puts before an oracle's SELECT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table whose rows are few bytes but much work: dealt by keys, as all of a small file's rows would be one task's."""
    return table(spark, sf_dir, name).repartition(*keys)


def epoch_ms(column: str) -> F.Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, src, dim, x, z, found_time, height, ord: chunk highlights with repeated keys, of two sides and seven sources."""
    dim = F.when(F.col("l_returnflag") == "A", "minecraft:overworld").when(F.col("l_returnflag") == "N", "minecraft:the_nether").otherwise("minecraft:the_end")
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", "A").otherwise("B").alias("side"),
        F.col("l_linenumber").alias("src"),
        dim.alias("dim"),
        (F.col("l_partkey") % 256 - 128).cast("int").alias("x"),
        (F.col("l_suppkey") % 100 - 50).cast("int").alias("z"),
        epoch_ms("l_shipdate").alias("found_time"),
        F.col("l_quantity").cast("bigint").alias("height"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def region_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, layer, rx, rz, mtime_ms, size, is_zip, ord: region files as listed, several to a coordinate."""
    return table(spark, sf_dir, "orders").select(
        F.when(F.floor(F.col("o_orderkey") / 97) % 2 == 0, "A").otherwise("B").alias("side"),
        F.concat(F.lit("layer"), F.substring("o_orderpriority", 1, 1)).alias("layer"),
        (F.col("o_custkey") % 96 - 48).cast("int").alias("rx"),
        (F.col("o_orderkey") % 96 - 48).cast("int").alias("rz"),
        epoch_ms("o_orderdate").alias("mtime_ms"),
        F.when(F.col("o_orderstatus") == "P", 0).otherwise(F.floor("o_totalprice")).cast("bigint").alias("size"),
        (F.col("o_orderstatus") != "O").alias("is_zip"),
        F.col("o_orderkey").alias("ord"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, px, pz, r, g, b, a: one pixel for each place of 64 x 64 in a region."""
    v = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 16).alias("region"),
        (F.col("l_partkey") % 64).alias("px"),
        (F.col("l_orderkey") % 64).alias("pz"),
        (F.col("l_quantity") * 5).cast("bigint").alias("r"),
        F.round(F.col("l_discount") * 2000).cast("bigint").alias("g"),
        F.round(F.col("l_tax") * 3000).cast("bigint").alias("b"),
        (F.col("l_linenumber").cast("bigint") * 36).alias("a"),
    )
    return v.groupBy("region", "px", "pz").agg(*(F.max(c).alias(c) for c in "rgba"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cx, cz, v: each embedding as an 8 x 8 grid of whole numbers from 0."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return e.select("vec_id", (F.col("i") % 8).cast("bigint").alias("cx"), F.floor(F.col("i") / 8).cast("bigint").alias("cz"), F.floor((F.col("e").cast("double") + 10) * 1000).cast("bigint").alias("v"))


def waypoint_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, side, world, line: waypoint records as text, some too short or without a height."""
    c = dealt(spark, sf_dir, "customer", "c_custkey")
    y = F.when(F.col("c_custkey") % 7 == 0, "~").otherwise((F.col("c_custkey") % 256).cast("string"))
    fields = [
        F.lit("waypoint"), F.concat(F.replace("c_name", F.lit("#"), F.lit("§§")), F.when(F.col("c_custkey") % 5 == 0, " b").otherwise("")), F.substring("c_mktsegment", 1, 2),
        (F.col("c_custkey") * 16 - 9000).cast("string"), y, (F.col("c_nationkey") * 100 - 1000).cast("string"), (F.col("c_custkey") % 23).cast("string"),
        F.when(F.col("c_custkey") % 3 == 0, "true").otherwise("false"), F.lit("0"), F.lit("gui.default"), F.lit("false"), F.lit("0"), F.lit("0"),
    ]
    short = F.concat_ws(":", *fields[:6])
    return c.select(
        F.col("c_custkey").alias("ord"),
        F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("B").alias("side"),
        F.concat(F.lit("world"), (F.col("c_nationkey") % 4).cast("string")).alias("world"),
        F.when(F.col("c_custkey") % 11 == 0, short).otherwise(F.concat_ws(":", *fields)).alias("line"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, player, t_ms, dim, x, z: where players report to be."""
    e = table(spark, sf_dir, "events")
    dim = F.when(F.col("event_type").isin("click", "view"), "minecraft:overworld").when(F.col("event_type") == "error", "minecraft:the_nether").otherwise("minecraft:the_end")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("event_id", F.col("user_id").alias("player"), epoch_ms("ts").alias("t_ms"), dim.alias("dim"), (F.floor(F.col("value") * 10) - 500).cast("bigint").alias("x"), (k * 10 - 500).alias("z"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, name: file and folder names of all the forms that scans meet."""
    k, rx, rz = F.col("o_orderkey"), (F.col("o_custkey") % 96 - 48).cast("string"), (F.col("o_orderkey") % 96 - 48).cast("string")
    own = F.concat(rx, F.lit("_"), rz)
    forms = [
        F.concat(own, F.lit(".zip")), F.concat(own, F.lit(".xaero")), F.concat(F.lit("+"), own, F.lit(".zip")), F.concat(own, F.lit(".zip.tmp")), F.concat(own, F.lit(".sync-conflict-20240101-AB"), (k % 7).cast("string"), F.lit(".zip")),
        F.concat((k % 9 * 65536 + k % 25).cast("string"), F.lit("_backup_"), (k % 3).cast("string")), F.concat(F.lit("cache_"), (k % 30).cast("string")), F.concat(F.lit("mw$"), rx), F.concat(F.lit("mw"), rx, F.lit(","), rz, F.lit(",64")),
        F.concat(F.lit("backup"), F.substring(F.lit("-----"), F.lit(1), (k % 5).cast("int"))), F.concat(own, F.lit(".zip.backup"), (k % 4).cast("string"), F.lit("-xp-"), (k % 6).cast("string")), F.concat(F.lit("mw"), rx, F.lit("_my%us%map"), rz, F.lit(".txt")), F.lit("waypoints.txt"),
        F.concat(F.lit("data.db-"), F.element_at(F.array(F.lit("wal"), F.lit("shm"), F.lit("journal"), F.lit("bak")), (k % 4 + 1).cast("int"))), F.concat(F.lit("minecraft$worlds%w"), rx, F.lit("$x")), F.concat(F.lit("cm$converted"), rz),
    ]
    return table(spark, sf_dir, "orders").select(k.alias("ord"), F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int")).alias("name"))


VIEWS = {
    "hl": """select case when l_linestatus = 'F' then 'A' else 'B' end side, l_linenumber src,
        case l_returnflag when 'A' then 'minecraft:overworld' when 'N' then 'minecraft:the_nether' else 'minecraft:the_end' end dim,
        cast(l_partkey % 256 - 128 as int) x, cast(l_suppkey % 100 - 50 as int) z, epoch_ms(l_shipdate) found_time,
        cast(l_quantity as bigint) height, l_orderkey * 10 + l_linenumber ord from lineitem""",
    "idx": """select case when o_orderkey // 97 % 2 = 0 then 'A' else 'B' end side, 'layer' || substr(o_orderpriority, 1, 1) layer,
        cast(o_custkey % 96 - 48 as int) rx, cast(o_orderkey % 96 - 48 as int) rz, epoch_ms(o_orderdate) mtime_ms,
        case when o_orderstatus = 'P' then 0 else cast(floor(o_totalprice) as bigint) end size, o_orderstatus <> 'O' is_zip, o_orderkey ord from orders""",
    "pix": """select region, px, pz, max(r) r, max(g) g, max(b) b, max(a) a from (
        select l_suppkey % 16 region, l_partkey % 64 px, l_orderkey % 64 pz, cast(l_quantity * 5 as bigint) r,
        cast(round(l_discount * 2000) as bigint) g, cast(round(l_tax * 3000) as bigint) b, cast(l_linenumber as bigint) * 36 a from lineitem) group by 1, 2, 3""",
    "cells": """select vec_id, (i - 1) % 8 cx, (i - 1) // 8 cz, cast(floor((cast(e as double) + 10) * 1000) as bigint) v
        from (select vec_id, unnest(embedding) e, cast(generate_subscripts(embedding, 1) as bigint) i from embeddings)""",
    "wp": """select c_custkey ord, case when c_custkey % 2 = 0 then 'A' else 'B' end side, 'world' || cast(c_nationkey % 4 as varchar) world,
        'waypoint:' || replace(c_name, '#', '§§') || case when c_custkey % 5 = 0 then ' b' else '' end || ':' || substr(c_mktsegment, 1, 2) || ':' || cast(c_custkey * 16 - 9000 as varchar)
        || ':' || case when c_custkey % 7 = 0 then '~' else cast(c_custkey % 256 as varchar) end || ':' || cast(c_nationkey * 100 - 1000 as varchar)
        || case when c_custkey % 11 = 0 then '' else ':' || cast(c_custkey % 23 as varchar) || ':' || case when c_custkey % 3 = 0 then 'true' else 'false' end || ':0:gui.default:false:0:0' end line from customer""",
    "pos": """select event_id, user_id player, epoch_us(ts) // 1000 t_ms, case when event_type in ('click', 'view') then 'minecraft:overworld' when event_type = 'error' then 'minecraft:the_nether' else 'minecraft:the_end' end dim,
        cast(floor(value * 10) as bigint) - 500 x, cast(json_extract_string(props, '$.k') as bigint) * 10 - 500 z from events""",
    "names": """select ord, case ord % 16 when 0 then own || '.zip' when 1 then own || '.xaero' when 2 then '+' || own || '.zip' when 3 then own || '.zip.tmp'
        when 4 then own || '.sync-conflict-20240101-AB' || cast(ord % 7 as varchar) || '.zip' when 5 then cast(ord % 9 * 65536 + ord % 25 as varchar) || '_backup_' || cast(ord % 3 as varchar)
        when 6 then 'cache_' || cast(ord % 30 as varchar) when 7 then 'mw$' || rx when 8 then 'mw' || rx || ',' || rz || ',64' when 9 then 'backup' || substr('-----', 1, cast(ord % 5 as bigint))
        when 10 then own || '.zip.backup' || cast(ord % 4 as varchar) || '-xp-' || cast(ord % 6 as varchar) when 11 then 'mw' || rx || '_my%us%map' || rz || '.txt' when 12 then 'waypoints.txt'
        when 13 then 'data.db-' || list_extract(['wal', 'shm', 'journal', 'bak'], ord % 4 + 1) when 14 then 'minecraft$worlds%w' || rx || '$x' else 'cm$converted' || rz end as name
        from (select o_orderkey ord, cast(o_custkey % 96 - 48 as varchar) rx, cast(o_orderkey % 96 - 48 as varchar) rz, cast(o_custkey % 96 - 48 as varchar) || '_' || cast(o_orderkey % 96 - 48 as varchar) own from orders)""",
}


def with_views(sql: str, *views: str) -> str:
    """sql with the views that it reads, and further named parts given as 'name: select', before it."""
    parts = [f"{v} as ({VIEWS[v]})" if v in VIEWS else "{0} as ({1})".format(*v.split(": ", 1)) for v in views]
    return f"with {', '.join(parts)} {sql}"
