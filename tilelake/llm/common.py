"""What several text operators share: staged tables, Arrow text buffers, word and window hashes, components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step handles; bounds a worker's memory whatever the batch.
SLICE_BYTES = 2 << 20
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    return base


_staged: dict[str, SparkSession] = {}


def _delete(path: str, spark: SparkSession) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_staged() -> None:
    for path, spark in _staged.items():
        try:
            _delete(path, spark)
        except Exception:  # the session has ended: its owner clears the shared folder
            return


def stage(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, executors may be lost after it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tilelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that nothing will read again; the rest go when the driver ends."""
    for df in frames:
        if (spark := _staged.pop(df._staged_at, None)) is not None:
            _delete(df._staged_at, spark)


@contextmanager
def staging() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged in this block are deleted after it, but for those that it hands to what it gets."""
    known, kept = set(_staged), set()
    yield lambda df: kept.add(df._staged_at) or df
    for path in [p for p in _staged if p not in known and p not in kept]:
        _delete(path, _staged.pop(path))


def named(column: str) -> F.Column:
    """The column of exactly this name, whatever dots and back-ticks it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def crc32_text(col) -> F.Column:
    """CRC-32 of a string's UTF-8 bytes, as an unsigned long."""
    return F.crc32(F.encode(col, "UTF-8"))


# --- places within groups of any size -------------------------------------------------------------------------------


def _counted(group: str):
    """Rows of a sorted partition with their place in their group's run there, and whether that run opens the partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done, opening = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            n, keys = len(batch), batch.column(group)
            if not n:
                continue
            fresh = np.ones(n, bool)
            fresh[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = last is not None and keys[0].as_py() != last
            at = np.where(fresh, np.arange(n), -1)
            start = np.maximum.accumulate(at)
            local = np.where(start < 0, np.arange(n) + done, np.arange(n) - start)
            first = (start < 0) & opening
            last, done, opening = keys[n - 1].as_py(), int(local[-1]) + 1, bool(first[-1])
            yield pa.record_batch([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(local, pa.int64()), pa.array(first)], names=[*batch.schema.names, "_part", "_local", "_first"])

    return run


def numbered(df: DataFrame, group: str, order: list, place: str = "pos") -> DataFrame:
    """df with each row's place, from 0, in its group by order: one range sort, in which a large group lies in many parts.

    Each task numbers its own rows; the place at which a partition's first group goes on is found from one row for each
    partition. Copies of one row are dealt to several parts as well. group may not be null; order takes nulls first. df is
    written to the shared folder before the sort, which reads its input twice, and after it with the local places, so that
    a second attempt can't deal rows anew: give it narrow rows.
    """
    rows = stage(df.withColumn("_deal", F.monotonically_increasing_id() % 256))
    keys = [group, *order, "_deal"]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in (("_part", T.IntegerType()), ("_local", T.LongType()), ("_first", T.BooleanType())))])
    dealt = stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_deal").mapInArrow(_counted(group), schema))
    drop_staged(rows)
    ends = dealt.groupBy("_part").agg(F.min(group).alias("head"), F.max(F.struct(group, "_local")).alias("tail")).orderBy("_part").collect()
    before, open_group, so_far = [], None, 0
    for part, head, tail in ends:  # one row a partition
        carried = so_far if head == open_group else 0
        before.append((part, carried))
        open_group, so_far = tail[0], tail[1] + 1 + (carried if head == tail[0] else 0)
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    at = F.col("_local") + F.when(F.col("_first"), F.col("_before")).otherwise(0)
    return dealt.join(F.broadcast(offsets), "_part").select(*(F.col(f"`{c}`") for c in df.columns), at.alias(place))


# --- Arrow text buffers ---------------------------------------------------------------------------------------------


_libc = ctypes.CDLL(None)


def trim() -> None:
    """Give a worker's freed memory back: workers live on between tasks, and two of them share an executor's with the JVM."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most limit bytes together, or one row with a longer text."""
    lengths = pc.binary_length(batch.column(column).cast(pa.string())).fill_null(0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(lengths, dtype=np.int64), 0
    while lo < len(lengths):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi
    trim()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, null as empty, and the n + 1 offsets of the texts in them."""
    column = column.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


# --- hashes of words and of windows of words ------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes about half of the output bits."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


_BASE_BYTE, _BASE_WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd; 5 modulo 8, so that powers differ in low bits


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BLOCK = 1 << 18
_byte_powers = _powers(_BASE_BYTE, 2 * _BLOCK)
_byte_inverse = _powers(pow(_BASE_BYTE, -1, 1 << 64), 2 * _BLOCK)
_byte_values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE_WORD)) | np.uint64(1)
_is_space = np.zeros(256, bool)
_is_space[list(SPACE)] = True
_lower_values = _byte_values.copy()
_lower_values[65:91] = _byte_values[97:123]


class Words:
    """The words of several texts that lie one after another in a buffer: runs of bytes that solid has as true.

    By default those are all bytes other than white space.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, solid_bytes: np.ndarray = ~_is_space):
        solid = solid_bytes[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        self.data, self.solid_bytes = data, solid_bytes
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        #: Words of text k: from bounds[k] to bounds[k + 1].
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes, mixed with its length."""
        values, out = np.where(self.solid_bytes, _lower_values if lower else _byte_values, np.uint64(0)), np.empty(len(self.starts), np.uint64)
        lo = 0
        while lo < len(self.starts):
            base = self.starts[lo]
            hi = max(lo + 1, int(np.searchsorted(self.ends, base + _BLOCK, side="right")))
            block = self.data[base : self.ends[hi - 1]]
            if len(block) <= len(_byte_powers):
                at = self.starts[lo:hi] - base
                out[lo:hi] = np.add.reduceat(values[block] * _byte_powers[: len(block)], at) * _byte_inverse[at]
            else:  # one word longer than a block
                total, step = np.uint64(0), pow(_BASE_BYTE, _BLOCK, 1 << 64)
                for k in range((len(block) - 1) // _BLOCK, -1, -1):
                    piece = values[block[k * _BLOCK : (k + 1) * _BLOCK]]
                    total = np.uint64((int(total) * step + int((piece * _byte_powers[: len(piece)]).sum(dtype=np.uint64))) % (1 << 64))
                out[lo] = total
            lo = hi
        return mix(out ^ (self.ends - self.starts).astype(np.uint64) * _M2)

    def prefix_hashes(self, sizes: tuple[int, ...]) -> list[np.ndarray]:
        """For each size, a hash of each word's first bytes, lower case; shorter words are hashed as a whole."""
        out, h = [], np.zeros(len(self.starts), np.uint64)
        for k in range(max(sizes)):
            at = self.starts + k
            inside = at < self.ends
            h = h + np.where(inside, _lower_values[self.data[np.where(inside, at, self.starts)]] * _byte_powers[k], np.uint64(0))
            if k + 1 in sizes:
                out.append(mix(h + np.uint64((k + 1) * int(_M1) % (1 << 64))))
        return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of size consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_BASE_WORD, len(words)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _powers(pow(_BASE_WORD, -1, 1 << 64), n) + np.uint64(size))


def shingle_sets(batch_texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text, its sorted distinct hashes of size-word shingles; all words as one where there are fewer."""
    words = Words(*text_buffer(batch_texts))
    hashes = words.hashes(lower=True)
    for lo, hi in zip(words.bounds[:-1], words.bounds[1:]):
        yield np.unique(window_hashes(hashes[lo:hi], min(size, hi - lo))) if hi > lo else np.zeros(0, np.uint64)


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow list<int64> of unsigned 64-bit arrays, by their bits."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays).view(np.int64) if arrays and offsets[-1] else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


# --- connected components -------------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Nodes of edges (a, b) with the smallest node that links reach: (node, component).

    Alternates large-star and small-star steps (each node hands its larger, then its smaller neighbours to its smallest
    one) until the edges are stars; every step is joins and aggregates, and each round is written to the shared folder.
    """
    def seal(df: DataFrame):
        df = stage(df)
        return df, df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges, seen = seal(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
        before, (edges, now) = edges, seal(small.where("u <> v").distinct())
        drop_staged(before)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components need more than {rounds} rounds")
    return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
