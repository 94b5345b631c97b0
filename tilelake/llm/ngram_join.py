"""N-gram Jaccard join by grouped prefixes, and the classes of near copies that its links make.

A document's set holds its distinct 5-word shingles (hashes of 64 bits). All shingles stand in one global order, rare
ones first: an estimate of how many documents hold a shingle (a count sketch sized by the bytes of text up to a bound, and
filled from all documents), then the hash. Two sets with Jaccard similarity t or more share a shingle among the first |s| - ceil(t |s|) + 1 of each.

1. Documents with equal sets are one class; classes with equal prefix and size are one group, indexed once.
2. In the list of each prefix shingle, groups are paired with the list's first group and with the one before them by
   the shingle's place in their prefix. Pairs pass a size and a position filter, are expanded to the groups' first classes
   and verified on whole sets. A list that the sketch expects to be long is dealt into parts of about LIST_PART groups,
   whose first groups are paired with the list's.
3. Links so far make components. What is left are pairs in a list, or members of a group, whose components differ: these
   are all taken, filtered, expanded and verified. So no link between components stays unseen, and a list of thousands
   of near copies of one text costs as many checks as it has members, not their square. Sides of such pairs meet by
   shingle and band of sizes, and on the smaller side only if the position filter lets it have a partner of its size or
   more: families of texts that share too little don't meet at all.

Sets and shingles are compared by 64-bit hashes: n different sets have about n^2 / 2^65 false equals, 3 * 10^-6 at 10^7.

Defined results: null, empty and blank texts have an empty set, n_shingles 0, and are linked with nothing; repeated rows
(also of one doc_id) are members like others; rows with a null doc_id are linked like others and take the smallest id of
their component, or null if none has one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilelake.llm.common import components, drop_staged, long_lists, mix, named, shingle_sets, slices, stage, staging, table

SHINGLE_WORDS, PERCENT = 5, 80
#: log2 of the sketch's counters, at least and at most (64 MB as 32-bit numbers), and of its blocks; bytes of text a counter.
SKETCH_BITS, BLOCK_BITS, COUNTER_BYTES = (18, 24), 18, 128
#: Groups in a part of a long list.
LIST_PART = 50_000
#: Blocks of partial sketches are first summed in so many parts.
SUM_PARTS = 64


def _partial_sketch(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column("text"), size))
                at, n = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
                counts[at.astype(np.int64)] += n.astype(np.uint32)
        blocks = [(k, c) for k, c in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)) if c.any()]
        salt = int(counts.sum(dtype=np.uint64)) % SUM_PARTS
        yield _blocks([k for k, _ in blocks], [c for _, c in blocks], salt)

    return run


def _blocks(keys: list[int], counts: list[np.ndarray], salt: int = 0) -> pa.RecordBatch:
    packed = [pa.compress(c.astype(np.uint32).tobytes(), "zstd", asbytes=True) for c in counts]
    return pa.record_batch({"block": pa.array(keys, pa.int32()), "salt": pa.array([salt] * len(keys), pa.int32()), "counts": pa.array(packed, pa.binary())})


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 4 << BLOCK_BITS, "zstd", asbytes=True), np.uint32)


def _sum_blocks(group: pa.Table) -> pa.Table:
    total = np.zeros(1 << BLOCK_BITS, np.uint32)
    for packed in group.column("counts"):
        total += _unpack(packed.as_py())
    return pa.Table.from_batches([_blocks([group.column("block")[0].as_py()], [total])])


def shingle_sketch(docs: DataFrame, size: int = SHINGLE_WORDS) -> np.ndarray:
    """For each value of a shingle hash's first bits, how many sets hold a shingle with it."""
    nbytes, (least, most) = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, SKETCH_BITS
    bits = min(max((nbytes // COUNTER_BYTES).bit_length(), least), most)
    schema = "block int, salt int, counts binary"
    partial = docs.select("text").mapInArrow(_partial_sketch(size, bits), schema)
    summed = partial.groupBy("block", "salt").applyInArrow(_sum_blocks, schema).groupBy("block").applyInArrow(_sum_blocks, schema)
    out = np.zeros((1 << (bits - BLOCK_BITS), 1 << BLOCK_BITS), np.uint32)
    for row in summed.toLocalIterator():  # at most 64 blocks of 1 MB
        out[row["block"]] = _unpack(bytes(row["counts"]))
    return out.reshape(-1)


def _digest(h: np.ndarray, seed: int) -> int:
    """A hash of a sequence of hashes."""
    with np.errstate(over="ignore"):
        at = mix(np.arange(1, len(h) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))
        return int(mix(np.array([(mix(h ^ at)).sum(dtype=np.uint64) + np.uint64(len(h))]))[0].view(np.int64))


def _describe(sketch, length: int, size: int, percent: int):
    """Sizes, digests and prefixes. parts: for each shingle of a prefix its part of a long list, -1 in a short one."""
    shift = np.uint64(64 - length.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.frombuffer(pa.decompress(sketch.value, 4 * length, "zstd", asbytes=True), np.uint32), set()
        for batch in batches:
            for part in slices(batch):
                n, names, group, prefixes, parts = [], [], [], [], []
                for s in shingle_sets(part.column("text"), size):
                    first = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    often = counts[(s >> shift).astype(np.int64)]
                    order = np.lexsort((s, often))[:first]
                    n.append(len(s))
                    names.append(_digest(s, 1))
                    group.append(key := _digest(np.append(s[order], np.uint64(len(s))), 3))
                    if key in seen:  # a group's prefix once for each task
                        order = order[:0]
                    seen.add(key)
                    if len(seen) > 200_000:
                        seen.clear()
                    prefixes.append(s[order])
                    long = often[order] // LIST_PART
                    parts.append([key % (m + 1) if m else -1 for m in long.tolist()] if long.any() else None)
                columns = {"n": n, "k": names, "g": group}
                columns = {c: pa.array(v, pa.int64()) for c, v in columns.items()} | {"prefix": long_lists(prefixes), "parts": pa.array(parts, pa.list_(pa.int32()))}
                yield pa.record_batch({"doc_id": part.column("doc_id"), "r": part.column("r"), **columns})

    return run


#: log2 of the bits of the filter on documents, at least and at most (32 MB), and of its blocks; bits a document wanted.
#: A full filter only lets more documents through.
FILTER_BITS, FILTER_BLOCK, WANTED_BITS = (21, 28), 21, 16


def _filter_places(keys: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's byte in the filter and its bit there."""
    at = (mix(keys.to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    return at >> 3, np.uint8(1) << (at & 7).astype(np.uint8)


def _partial_filter(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << bits - 3, np.uint8)
        for batch in batches:
            np.bitwise_or.at(marks, *_filter_places(batch.column("r"), bits))
        blocks = marks.reshape(-1, 1 << FILTER_BLOCK - 3)
        yield _filter_blocks(np.flatnonzero(blocks.any(axis=1)), blocks[blocks.any(axis=1)])

    return run


def _filter_blocks(keys, blocks) -> pa.RecordBatch:
    packed = [pa.compress(b.tobytes(), "zstd", asbytes=True) for b in blocks]
    return pa.record_batch({"block": pa.array(keys, pa.int32()), "bits": pa.array(packed, pa.binary())})


def _unpack_bits(packed: bytes, bits: int = FILTER_BLOCK) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 1 << bits - 3, "zstd", asbytes=True), np.uint8)


def _join_filters(group: pa.Table) -> pa.Table:
    bits = np.zeros(1 << FILTER_BLOCK - 3, np.uint8)
    for packed in group.column("bits"):
        bits |= _unpack_bits(packed.as_py())
    return pa.Table.from_batches([_filter_blocks([group.column("block")[0].as_py()], [bits])])


def row_filter(wanted: DataFrame) -> tuple[bytes, int]:
    """A bitmap in which each r of wanted has its bit set, and log2 of its bits: what it turns away isn't among them."""
    least, most = FILTER_BITS
    bits = min(max((WANTED_BITS * wanted.count()).bit_length(), least), most)
    schema = "block int, bits binary"
    rows = wanted.mapInArrow(_partial_filter(bits), schema).groupBy("block").applyInArrow(_join_filters, schema)
    marks = np.zeros((1 << bits - FILTER_BLOCK, 1 << FILTER_BLOCK - 3), np.uint8)
    for row in rows.toLocalIterator():  # at most 128 blocks of 256 kB
        marks[row["block"]] = _unpack_bits(bytes(row["bits"]))
    return pa.compress(marks.tobytes(), "zstd", asbytes=True), bits


def _sets(size: int, wanted, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, seen = _unpack_bits(wanted.value, bits), set()
        for batch in batches:
            byte, bit = _filter_places(batch.column("r"), bits)
            known = marks[byte] & bit > 0
            for k in np.flatnonzero(known):  # repeated rows once for each task
                if (r := batch.column("r")[int(k)].as_py()) in seen:
                    known[k] = False
                seen.add(r)
                if len(seen) > 200_000:
                    seen.clear()
            for part in slices(batch.filter(pa.array(known))):
                sets = list(shingle_sets(part.column("text"), size))
                yield pa.record_batch({"k": pa.array([_digest(s, 1) for s in sets], pa.int64()), "items": long_lists(sets)})

    return run


def _close(percent: int, n1: str = "n1", n2: str = "n2", p1: str = "p1", p2: str = "p2") -> str:
    """Sizes may differ so much, and what follows the first shared shingle must hold enough of both sets.

    Shingles before the first shared one aren't shared, and a later shared one only bounds the overlap lower: if the
    first one fails, all do. So a pair that no shared shingle lets pass isn't similar enough.
    """
    return (
        f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and "
        f"(100 + {percent}) * least({n1} - {p1}, {n2} - {p2}) >= {percent} * ({n1} + {n2})"
    )


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs of classes (a, b), those whose whole sets are similar enough."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    marks, bits = row_filter(classes.join(needed, "k").select("r"))
    wanted = docs.sparkSession.sparkContext.broadcast(marks)
    sets = docs.select("r", "text").mapInArrow(_sets(size, wanted, bits), "k long, items array<long>")
    sets = stage(sets.join(needed, "k", "left_semi").dropDuplicates(["k"]))
    wanted.destroy()
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("items").alias("y")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("o"), (F.size("x") + F.size("y")).alias("t"))
    return shared.where(f"100 * o >= {percent} * (t - o)").select("a", "b")


def _ordered(a: str = "a", b: str = "b") -> list[Column]:
    return [F.least(a, b).alias(a), F.greatest(a, b).alias(b)]


def _near_pairs(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (a, b): neighbours in lists, firsts of parts and lists, and members of groups with the first one."""
    groups = classes.groupBy("g").agg(F.min("k").alias("k"))
    near = lists.select(F.struct("p", "n", "g").alias("e"), F.explode(F.array("before", "first")).alias("o")).where("o is not null")
    heads = lists.where("part >= 0 and before is null").select("token", F.struct("p", "n", "g").alias("e"))
    heads = heads.join(heads.groupBy("token").agg(F.min("e").alias("o")), "token").select("e", "o")
    near = near.union(heads).where("e.g <> o.g").where(_close(percent, "e.n", "o.n", "e.p", "o.p"))
    near = near.select(F.col("e.g").alias("g1"), F.col("o.g").alias("g2")).select(*_ordered("g1", "g2")).distinct()
    one, two = (groups.select(F.col("g").alias(f"g{i}"), F.col("k").alias(k)) for i, k in ((1, "a"), (2, "b")))
    near = near.join(one, "g1").join(two, "g2").select("a", "b")
    inside = classes.select("g", F.col("k").alias("b")).join(groups.select("g", F.col("k").alias("a")), "g").where("a <> b").select("a", "b")
    return near.union(inside).select(*_ordered()).distinct()


def _left_pairs(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes (a, b) of unlike components (c) that share a prefix shingle and pass the filters, or a group."""
    entries = lists.select("token", "g", "n", "p").distinct().join(classes.select("g", "c").distinct(), "g")
    mixed = entries.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    # the largest size that a partner may have, and bands of sizes: a partner is in the same band or the next
    most = F.expr(f"((100 + {percent}) * (n - p) - {percent} * n) div {percent}")
    band = F.floor(F.log("n") / (np.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("n")
    entries = stage(entries.join(mixed, "token").withColumns({"most": most, "band": band.cast("long")}))
    small = entries.where("most >= n").withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    sides = [x.select("token", "band", *(F.col(c).alias(f"{c}{i}") for c in ("c", "g", "n", "most"))) for i, x in ((1, small), (2, entries))]
    one, two = (x.groupBy("token", "band", f"c{i}").agg(F.min(f"n{i}").alias(f"n{i}"), F.max(f"n{i}").alias(f"top{i}"), F.max(f"most{i}").alias(f"most{i}")) for i, x in ((1, sides[0]), (2, sides[1])))
    meet = one.join(two, ["token", "band"]).where("c1 <> c2 and n1 <= top2 and n2 <= most1 and n1 <= most2").select("token", "band", "c1", "c2")
    rest = meet.join(sides[0], ["token", "band", "c1"]).join(sides[1], ["token", "band", "c2"]).where("n1 <= n2 and n2 <= most1 and n1 <= most2")
    rest = rest.select("c1", "c2", "g1", "g2").distinct()
    one, two = (classes.select(F.col("g").alias(f"g{i}"), F.col("c").alias(f"c{i}"), F.col("k").alias(k)) for i, k in ((1, "a"), (2, "b")))
    rest = rest.join(one, ["g1", "c1"]).join(two, ["g2", "c2"]).select("a", "b")
    split = classes.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("g")
    own = classes.join(split, "g").select("g", "c", "k")
    one, two = (own.select("g", F.col("c").alias(f"c{i}"), F.col("k").alias(k)) for i, k in ((1, "a"), (2, "b")))
    return rest.union(one.join(two, "g").where("c1 < c2").select("a", "b")).select(*_ordered()).distinct()


def linked(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, r, n, k) and classes of equal sets (k, doc_id, r, c).

    r is a hash of id and text, n the size of the set, k names its class; a class's doc_id and r are those of its row with
    the smallest id, and c names its component. Empty sets have no class.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("r", F.xxhash64("doc_id", "text"))
    counts = shingle_sketch(docs, size)
    sketch = spark.sparkContext.broadcast(pa.compress(counts.tobytes(), "zstd", asbytes=True))
    described = stage(docs.mapInArrow(_describe(sketch, len(counts), size, percent), "doc_id long, r long, n long, k long, g long, prefix array<long>, parts array<int>"))
    sketch.destroy()
    members = described.select("doc_id", "r", "n", "k", "g")
    with staging() as keep:
        least = F.min(F.struct(F.isnull("doc_id"), "doc_id", "r")).alias("row")
        classes = stage(members.where("n > 0").groupBy("k").agg(least, F.min("g").alias("g")).select("k", "row.doc_id", "row.r", "g"))
        # the list of each prefix shingle that more than one group has
        lists = described.select("g", "n", "parts", F.posexplode("prefix").alias("p", "token"))
        lists = lists.select("g", "n", "p", "token", F.coalesce(F.get("parts", "p"), F.lit(-1)).alias("part"))
        # the set with the fewest rarer shingles of its own comes first: the likeliest centre of a cluster
        by_place, entry = Window.partitionBy("token", "part").orderBy("p", "n", "g"), F.struct("p", "n", "g")
        lists = lists.withColumns({"before": F.lag(entry).over(by_place), "after": F.lead("g").over(by_place), "first": F.first(entry).over(by_place)})
        lists = stage(lists.where("before is not null or after is not null or part >= 0").drop("after"))
        pairs = stage(_near_pairs(lists, classes, percent))
        with staging() as hold:
            found = components(_verified(docs, pairs, classes, size, percent))
            parts = hold(stage(classes.join(found.withColumnRenamed("node", "k"), "k", "left").select("k", "doc_id", "r", "g", F.coalesce("component", "k").alias("c"))))
        rest = stage(_left_pairs(lists, parts, percent).join(pairs, ["a", "b"], "left_anti"))
        drop_staged(lists, pairs)
        more = _verified(docs, rest, parts, size, percent)
        one, two = (parts.select(F.col("k").alias(k), F.col("c").alias(f"c{i}")) for i, k in ((1, "a"), (2, "b")))
        final = components(more.join(one, "a").join(two, "b").select("c1", "c2"), "c1", "c2")
        out = keep(stage(parts.join(final.withColumnRenamed("node", "c"), "c", "left").select("k", "doc_id", "r", F.coalesce("component", "c").alias("c"))))
    return members.drop("g"), out


def near_copies(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    members, classes = linked(docs, size, percent)
    named = classes.join(classes.groupBy("c").agg(F.min("doc_id").alias("component")), "c").select("k", "component")
    out = members.join(named, "k", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays; without ids any row counts as larger.

    Rows with one id and unlike texts are documents of their own; of rows with equal id and text, the one whose other
    columns, written as JSON, come first stays. Rows without words are near copies of nothing: all stay.
    """
    _, classes = linked(docs)
    best = classes.groupBy("c").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "r")).alias("row")).select(F.col("row.r").alias("__key"), F.col("row.doc_id").alias("__id"))
    worded, number = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), F.col("doc_id").cast("long")
    others = F.to_json(F.struct(F.lit(0).alias("0"), *(named(c) for c in docs.columns if c != "text")))
    row = F.min_by(F.struct(*map(named, docs.columns)), others).alias("__row")
    rows = docs.where(worded).groupBy(F.xxhash64(number, "text").alias("__key"), number.alias("__id")).agg(row).alias("rows")
    kept = rows.join(best.alias("best"), (F.col("rows.__key") == F.col("best.__key")) & F.col("rows.__id").eqNullSafe(F.col("best.__id")), "left_semi")
    return kept.select(*(F.col("__row")[c].alias(c) for c in docs.columns)).unionByName(docs.where(~worded))
