"""Substring dedup: words covered by a window of words that also starts elsewhere are removed.

Documents are dealt into chunks by a hash of id and text, and every chunk's distinct Rabin-Karp window hashes into buckets
by a function of the hash, so that a bucket holds all chunks' copies of a window. A bucket counts its hashes and answers
each chunk with the windows that occur twice or more, as bits in the order of the chunk's sorted hashes. A window that half
of all documents hold comes once from each chunk, so no bucket grows with the copies of a window. Equal rows that would
fill one chunk are given numbers first, in a table in the shared folder, and dealt by these too.

This is done twice. The first time FIRST_BITS of each window's hash are counted: a filter that only windows without any
equal pass unseen. The second time only windows that it marked come, with 64 bits of a second hash. Each chunk then meets
the answers, marks repeated windows on its documents and merges them into maximal intervals. A window is removed wrongly if
both hashes meet others of its bucket by chance: of 10^13 windows in buckets of 3 * 10^6, some 10^13 * (3 * 10^6 / 2^40) *
(3 * 10^6 / 2^64), or 5 * 10^-6 in all. (Words enter as hashes of 64 bits: two words that share one would count as equal.)

Chunks and buckets widen with the root of the input, so that a row between the two holds 32 windows or more at any size.

Defined results: a null text has no words, n_removed 0 and the hash of the empty string; texts shorter than a window keep
all; repeated rows are copies of each other, so their windows go in each of them; rows with null ids are treated alike;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilelake.llm.common import Words, mix, named, slices, stage, table, text_buffer, trim, window_hashes

WINDOW_WORDS = 35
#: Bytes of text in a chunk on average, at least and at most; a bucket's windows come from twice as many.
CHUNK_BYTES = 8 << 20, 256 << 20
#: Bytes of text for a window, about, and fewest windows that one chunk sends one bucket on average.
WINDOW_BYTES, ROW_WINDOWS = 6, 32
#: Bits of the first pass's values; rows are dealt by numbers too where one of CLASSES holds SPLIT_BYTES more than four shares.
FIRST_BITS, CLASSES, SPLIT_BYTES = 40, 1024, 64 << 20
_FOUND = [
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
    T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
]
#: values: a chunk's distinct hashes in one bucket, ascending; twice: bits of those that occur twice; first: the first answer.
_BUCKET = "chunk int, bucket int, values binary, twice binary, first binary"


def _texts(group: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in group.combine_chunks().to_batches():
        yield from slices(batch)


def _windows(group: pa.Table, size: int, seconds: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Both hashes of all windows of a chunk's texts, one text after another."""
    one, two = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for part in _texts(group):
        words = Words(*text_buffer(part.column("text")))
        hashes = words.hashes()
        other = mix(hashes ^ _SECOND) if seconds else None
        for lo, hi in zip(words.bounds[:-1], words.bounds[1:]):
            if hi - lo >= size:
                one.append(window_hashes(hashes[lo:hi], size))
                if seconds:
                    two.append(window_hashes(other[lo:hi], size))
    return np.concatenate(one), np.concatenate(two) if seconds else None


_SECOND = np.uint64(0x5851F42D4C957F2D)


def _keys(hashes: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """A window's bucket, from its hash's high bits, above its value, the low ones."""
    bucket = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
    return bucket << np.uint64(bits) | hashes & np.uint64((1 << bits) - 1)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket and where its entries lie, of ascending buckets."""
    edges = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1, append=-1)) if len(bucket) else []
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(bucket[lo]), slice(lo, hi)


def _packed(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(packed: pa.Scalar, width: int) -> np.ndarray:
    own = np.frombuffer(packed.as_buffer(), np.uint8).reshape(-1, width)
    out = np.zeros((len(own), 8), np.uint8)
    out[:, :width] = own
    return out.view(np.uint64).reshape(-1)


def _bits(packed: pa.Scalar, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed.as_buffer(), np.uint8), count=n).astype(bool)


def _rows(chunk: int, rows: list[tuple[int, bytes, np.ndarray, bytes | None]]) -> pa.Table:
    bucket, values, twice, first = zip(*rows) if rows else ((), (), (), ())
    twice = [np.packbits(t).tobytes() for t in twice]
    return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int32()), "bucket": pa.array(bucket, pa.int32()), "values": pa.array(values, pa.binary()), "twice": pa.array(twice, pa.binary()), "first": pa.array(first, pa.binary())})


def _ask(size: int, buckets: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """A chunk's first values for each bucket."""

    def run(group: pa.Table) -> pa.Table:
        keys, counts = np.unique(_keys(_windows(group, size, False)[0], buckets, bits), return_counts=True)
        values = keys & np.uint64((1 << bits) - 1)
        return _rows(group.column("chunk")[0].as_py(), [(b, _packed(values[at], -(-bits // 8)), counts[at] > 1, None) for b, at in _runs(keys >> np.uint64(bits))])

    return run


def _count(width: int) -> Callable[[pa.Table], pa.Table]:
    """For each chunk's values in one bucket, which occur twice or more in all chunks."""

    def run(group: pa.Table) -> pa.Table:
        parts = [_unpacked(v, width) for v in group.column("values")]
        ordered = np.sort(np.concatenate(parts))
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        out = []
        for values, own in zip(parts, group.column("twice")):
            marks = _bits(own, len(values))
            if len(twice):
                marks |= twice[np.minimum(np.searchsorted(twice, values), len(twice) - 1)] == values
            out.append(np.packbits(marks).tobytes() if marks.any() else b"")
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "values": pa.nulls(len(out), pa.binary()), "twice": pa.array(out, pa.binary()), "first": group.column("first")})

    return run


class _Marked:
    """The windows of a chunk that the first answer marked: their places, and their distinct (bucket, second hash)."""

    def __init__(self, group: pa.Table, told: dict[int, pa.Scalar], size: int, buckets: int, bits: int):
        one, two = _windows(group, size, True)
        own = _keys(one, buckets, bits)
        keys, marked = np.unique(own), [np.zeros(0, np.uint64)]
        for b, at in _runs(keys >> np.uint64(bits)):
            if b in told:
                marked.append(keys[at][_bits(told[b], at.stop - at.start)])
        marked = np.concatenate(marked)  # buckets ascend, and values in each
        self.windows = len(own)
        self.at = np.flatnonzero(marked[np.minimum(np.searchsorted(marked, own), len(marked) - 1)] == own) if len(marked) else np.zeros(0, np.int64)
        bucket, second = own[self.at] >> np.uint64(bits), two[self.at]
        self.order = np.lexsort((second, bucket))
        bucket, second = bucket[self.order], second[self.order]
        fresh = np.ones(len(bucket), bool)
        fresh[1:] = (bucket[1:] != bucket[:-1]) | (second[1:] != second[:-1])
        first = np.flatnonzero(fresh)
        self.place = np.cumsum(fresh) - 1
        self.bucket, self.second, self.counts = bucket[first], second[first], np.diff(np.append(first, len(bucket)))

    def hits(self, confirmed: np.ndarray) -> np.ndarray:
        """For each window of the chunk, whether its (bucket, second hash) is confirmed."""
        out = np.zeros(self.windows, bool)
        out[self.at[self.order]] = confirmed[self.place]
        return out


def _ask_again(size: int, buckets: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The second hashes of a chunk's marked windows for each bucket."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        told = {b.as_py(): t for b, t in zip(answers.column("bucket"), answers.column("twice"))}
        if not told:
            return _rows(0, [])
        own = _Marked(docs, told, size, buckets, bits)
        return _rows(docs.column("chunk")[0].as_py(), [(b, _packed(own.second[at], 8), own.counts[at] > 1, told[b].as_py()) for b, at in _runs(own.bucket)])

    return run


def _removed(repeated: np.ndarray, words: int, size: int) -> np.ndarray:
    """Which words lie in a repeated window: intervals are merged by counting those open at each word."""
    open_ = np.zeros(words + 1, np.int64)
    np.add.at(open_, np.flatnonzero(repeated), 1)
    np.add.at(open_, np.flatnonzero(repeated) + size, -1)
    return np.cumsum(open_[:words]) > 0


def _intervals(removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(removed.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _keep(size: int, buckets: int, bits: int, exact: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        told = {b.as_py(): (f, t) for b, f, t in zip(*map(answers.column, ("bucket", "first", "twice")))}
        hits, at = None, 0
        if told:
            own = _Marked(docs, {b: f for b, (f, _) in told.items()}, size, buckets, bits)
            confirmed = np.zeros(len(own.bucket), bool)
            for b, where in _runs(own.bucket):
                confirmed[where] = _bits(told[b][1], where.stop - where.start)
            hits = own.hits(confirmed)
        n_words, n_removed, kept, starts, ends = [], [], [], [], []
        for part in _texts(docs):
            words = Words(*text_buffer(part.column("text")))
            text = words.data.tobytes()
            for original, lo, hi in zip(part.column("text"), words.bounds[:-1], words.bounds[1:]):
                n = max(hi - lo - size + 1, 0)
                gone = _removed(hits[at : at + n] if told else np.zeros(n, bool), hi - lo, size)
                at += n
                first, last = _intervals(gone)
                if exact and not len(first):
                    kept.append(original.as_py())
                else:
                    kept.append(b" ".join([text[a:b] for a, b in zip(words.starts[lo:hi][~gone].tolist(), words.ends[lo:hi][~gone].tolist())]).decode())
                n_words.append(hi - lo)
                n_removed.append(int(gone.sum()))
                starts.append(first)
                ends.append(last)
        out = {"row": docs.column("row"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())}
        return pa.table(out | {"starts": pa.array(starts, pa.list_(pa.int64())), "ends": pa.array(ends, pa.list_(pa.int64()))})

    return run


def _sizes(nbytes: int) -> tuple[int, int]:
    """How many chunks and buckets."""
    least, most = CHUNK_BYTES
    chunk = min(max(math.isqrt(nbytes * WINDOW_BYTES * ROW_WINDOWS), least), most)
    return nbytes // chunk + 1, nbytes // (2 * chunk) + 1


def _lean(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """run for one chunk or bucket, after which the worker gives its memory back."""
    if run.__code__.co_argcount == 1:
        return lambda group: (run(group), trim())[0]
    return lambda docs, answers: (run(docs, answers), trim())[0]


def remove_repeats(docs: DataFrame, size: int = WINDOW_WORDS, passed: tuple[str, ...] = ("doc_id",), exact: bool = False, first_bits: int = FIRST_BITS) -> DataFrame:
    """row (a struct of the passed columns), n_words, n_removed, kept (the text left), starts, ends (intervals, in words).

    exact: a text that loses nothing keeps its white space and null; otherwise its words are joined by one space too.
    """
    place = F.xxhash64("doc_id", "text")
    shares = docs.groupBy(F.pmod(place, F.lit(CLASSES)).alias("class")).agg(F.sum(F.octet_length("text")).alias("size"))
    nbytes, largest = (x or 0 for x in shares.agg(F.sum("size"), F.max("size")).first())
    chunks, buckets = _sizes(nbytes)
    rows = docs.select(F.struct(*map(named, passed)).alias("row"), "text", place.alias("place"))
    if largest > SPLIT_BYTES + 4 * nbytes // CLASSES:
        rows = stage(rows.withColumn("number", F.monotonically_increasing_id())).withColumn("place", F.xxhash64("place", "number"))
    dealt = rows.select(F.pmod("place", F.lit(chunks)).cast("int").alias("chunk"), "row", "text").repartition("chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_lean(_ask(size, buckets, first_bits)), _BUCKET)
    answers = asked.groupBy("bucket").applyInArrow(_lean(_count(-(-first_bits // 8))), _BUCKET).where(F.octet_length("twice") > 0)
    again = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_lean(_ask_again(size, buckets, first_bits)), _BUCKET)
    answers = again.groupBy("bucket").applyInArrow(_lean(_count(8)), _BUCKET).where(F.octet_length("twice") > 0)
    schema = T.StructType([dealt.schema["row"], *_FOUND])
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_lean(_keep(size, buckets, first_bits, exact)), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def stage_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document keeps the words outside repeated windows; documents in which nothing repeats keep their exact text."""
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    out = remove_repeats(docs, passed=others, exact=True)
    own = {c: F.col("row")[c] for c in others} | {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*(own[c].alias(c) for c in docs.columns))
