"""Sharding along a Hilbert curve over several metadata dimensions, for pruning of files by any of them.

Size, language and source are quantised to 2^BITS steps each: size by quantiles of all documents, the strings by a hash.
A cell of that grid has an index on the Hilbert curve; documents are ordered by the index, then by a hash of their text
(so equal texts lie together), and the order is cut into runs of equal counts: shards. Each shard then covers a compact
part of the grid, and its files' minima and maxima, or value lists, exclude most others.

No window runs over all rows. The order is: curve index, TEXT_BITS of the text's hash, the hash. Documents are counted by
index and bits, and a group of equal texts that holds more than 1 / LARGE of all rows is counted apart, by ID_BITS of its
ids' hashes. These counts are summed up along the curve over 2^12 cells, and within a cell over at most 2^10 buckets and
LARGE groups' 2^10 parts; only the rows of one bucket or part are numbered by a window. What a group shares is found from
one row for each (text, bits of the id) and joined to rows by these two. All of it is DataFrame functions on a narrow
table, and texts are read once and never shuffled.

The law is rows: shard counts differ by one at most. Groups are equal texts: they are adjacent in the order, so at most
one group at each of the cuts lies in more than one shard.

Defined results: a null text has size 1 and the CRC of the empty text, null dimensions count as empty strings; repeated
rows have slots of their own; null ids take part; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilelake.llm.common import crc32_text, stage, table

SHARDS, BITS, DIMENSIONS = 8, 4, 3
TEXT_BITS, ID_BITS, LARGE = 10, 10, 4096


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """A point's place on the Hilbert curve of its dimension.

    From the highest bit down, each dimension's bit either flips the lower bits of the first coordinate or swaps them
    with the dimension's own; Gray decoding then turns the bits, taken across dimensions, into a number.
    """
    x, n = list(point), len(point)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k in range(n):
            if x[k] >> bit & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[k]) & low
                x[0] ^= swap
                x[k] ^= swap
    crossed = 0
    for bit in range(bits - 1, -1, -1):
        for v in x:
            crossed = crossed << 1 | (v >> bit & 1)
    out = crossed
    while crossed := crossed >> 1:
        out ^= crossed
    return out


def curve(bits: int = BITS, dimensions: int = DIMENSIONS) -> list[int]:
    """Hilbert indices of all cells, the first dimension's steps varying slowest."""
    step = (1 << bits) - 1
    return [hilbert_index(tuple(cell >> bits * (dimensions - 1 - k) & step for k in range(dimensions)), bits) for cell in range(1 << bits * dimensions)]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, curve_index, shard and slot for each row of docs."""
    steps = 1 << BITS
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    quantiles, total = docs.agg(F.percentile_approx(size, [k / steps for k in range(1, steps)], 10_000), F.count("*")).first()
    quantiles = quantiles or [0] * (steps - 1)
    by_size = sum(((F.col("size") > F.lit(q)).cast("int") for q in quantiles), F.lit(0))
    named = {c: F.pmod(F.crc32(F.encode(F.coalesce(F.col(c).cast("string"), F.lit("")), "UTF-8")), F.lit(steps)).cast("int") if c in docs.columns else F.lit(0) for c in ("lang", "source")}
    cell = ((by_size * steps + F.col("by_lang")) * steps + F.col("by_source")).cast("int")
    hashed, u = F.xxhash64(text), F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc32_text(text).alias("text_crc32"), hashed.alias("hash"), named["lang"].alias("by_lang"), named["source"].alias("by_source"), u.alias("u"))
    index = F.element_at(F.array(*map(F.lit, curve())), cell + 1)
    # copies of one text may come from several sources: the whole group takes its least language and source
    least = F.min("by_lang").alias("by_lang"), F.min("by_source").alias("by_source")
    parts = rows.groupBy("hash", "u").agg(*least, F.count("*").alias("n"))
    large = (F.sum("n") * LARGE > total).alias("large")
    parts = parts.select("hash", "u").join(parts.groupBy("hash").agg(*least, large), "hash")
    rows = rows.drop("by_lang", "by_source").join(parts, ["hash", "u"])
    apart = {c: F.when(F.col("large"), F.col(of)).otherwise(0).alias(c) for c, of in (("g", "hash"), ("u", "u"))}
    bits = F.shiftrightunsigned("hash", 64 - TEXT_BITS).cast("int")
    rows = stage(rows.select("doc_id", "size", "text_crc32", "hash", index.alias("h"), bits.alias("t"), apart["g"], apart["u"]))

    buckets = ["h", "t", "g", "u"]
    counts = rows.groupBy(buckets).agg(F.count("*").alias("n"))
    along = Window.partitionBy("h").orderBy("t", "g", "u").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inside", F.coalesce(F.sum("n").over(along), F.lit(0)))
    cells = rows.groupBy("h").agg(F.count("*").alias("n"))  # 4096 rows at most
    over = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("h", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    place = Window.partitionBy(buckets).orderBy("hash", "doc_id", "text_crc32")
    ranked = rows.withColumn("own", F.row_number().over(place) - 1).join(counts, buckets).join(F.broadcast(cells), "h")
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside") + F.col("own"))
    ranked = ranked.withColumn("shard", F.expr(f"rank * {shards} div {max(total, 1)}").cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", F.col("h").alias("curve_index"), "shard", (F.col("rank") - first).alias("slot"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")
