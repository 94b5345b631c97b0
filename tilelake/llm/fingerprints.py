"""Document fingerprints by locally consistent parsing.

A text's code points are grouped into phrases, phrases into longer phrases, and so on. Where a phrase ends depends on a
few neighbours only: runs of one symbol are taken together; then deterministic coin tossing replaces each symbol by the
place and value of the lowest bit in which it differs from the one before, a few times over, until labels are below 8;
local maxima of the labels begin phrases. A phrase is named by a hash of its symbols, so equal substrings get equal
phrases in their interior whatever their offset. Per level the fingerprint keeps the smallest KEPT names, and likeness is
the Jaccard similarity that these estimate, at the longest phrases of which both texts have FEW or more.

The document after each one is found without a global window: ids are cut into ranges, the first document of a range is
sent to the range before it too, and each range is one task, read in order with one row of look-ahead. Texts are shuffled once.

Defined results: a null text is empty; the empty text's fingerprint has no names, and two empty fingerprints have likeness
1, an empty and another 0; rows with a null id come before all others; repeated ids are ordered by text; a single
document is its own successor; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilelake.llm.common import mix, table

LEVELS, ROUNDS = 3, 4
KEPT, FEW = 48, 8
#: Code points that one step of parsing handles, unless a text is longer; rows that it handles.
STEP_CHARS, STEP_ROWS = 1 << 19, 256

_power = np.multiply.accumulate(np.full(64, 0xD1342543DE82EF95, np.uint64))


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit position in which a symbol differs from the one before, plus its bit there."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = x[first] ^ np.uint64(1)
    differ = x ^ before
    place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    return (place << np.uint64(1)) | ((x >> place) & np.uint64(1))


def _parse(symbols: np.ndarray, bounds: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of several sequences that lie one after another, and where each sequence's phrases begin."""
    if not len(symbols):
        return symbols, bounds
    starts = np.zeros(len(symbols) + 1, bool)
    starts[bounds] = True
    fresh = starts[:-1].copy()
    fresh[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(fresh)
    runs = np.diff(np.append(at, len(symbols))).astype(np.uint64)
    x = mix(symbols[at] + runs * np.uint64(0x9E3779B97F4A7C15))
    edge = starts[:-1][at]
    # neighbours in x differ unless two runs' hashes meet
    labels, first = x, np.flatnonzero(edge)
    for _ in range(ROUNDS):
        labels = _toss(labels, first)
    labels = labels.astype(np.int8)
    low = np.empty(len(labels), np.int8)
    low[1:], low[first] = labels[:-1], 127
    high = np.empty(len(labels), np.int8)
    high[:-1], high[np.append(first[1:] - 1, len(labels) - 1)] = labels[1:], 127
    begin = edge | ((labels > low) & (labels > high))
    heads = np.flatnonzero(begin)
    inside = np.arange(len(x)) - np.repeat(heads, np.diff(np.append(heads, len(x))))
    names = mix(np.add.reduceat(x * _power[inside & 63], heads) + np.uint64(level))
    return names, np.searchsorted(at[heads], bounds)


def fingerprints(texts: list[str]) -> list[list[np.ndarray]]:
    """For each text and level, its smallest phrase names, as ascending 32-bit numbers."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    symbols = mix(np.frombuffer(raw, np.uint32).astype(np.uint64) + np.uint64(1))
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for level in range(1, LEVELS + 1):
        symbols, bounds = _parse(symbols, bounds, level)
        short = (symbols >> np.uint64(32)).astype(np.uint32)
        for own, lo, hi in zip(out, bounds[:-1], bounds[1:]):
            own.append(np.unique(short[lo:hi])[:KEPT])
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    for x, y in zip(reversed(a), reversed(b)):
        if min(len(x), len(y)) >= FEW:
            break
    if not len(x) and not len(y):
        return 1.0
    union = np.union1d(x, y)
    if max(len(x), len(y)) == KEPT:
        union = union[:KEPT]
    return len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), union, assume_unique=True)) / len(union)


def as_text(levels: list[np.ndarray]) -> str:
    return "|".join("".join(f"{v:08x}" for v in x.tolist()) for x in levels)


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the start of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    changed = [edited(t, n) for _, t, n in rows]
    distinct = list(dict.fromkeys([*(t for _, t, _ in rows), *changed, *(n for _, _, n in rows)]))  # most successors are rows too
    found = dict(zip(distinct, fingerprints(distinct)))
    own, after, following = ([found[t] for t in texts] for texts in ([t for _, t, _ in rows], changed, [n for _, _, n in rows]))
    columns = [
        pa.array([d for d, _, _ in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array([as_text(x) for x in own]), pa.array([as_text(x) for x in after]),
        pa.array([likeness(x, y) for x, y in zip(own, after)]), pa.array([likeness(x, y) for x, y in zip(own, following)]),
    ]
    return pa.record_batch(columns, names=[c.split()[0] for c in _RESULT.split(", ")])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and place in it; each is compared with the one after it, which may be a look-ahead row."""
    waiting: tuple | None = None  # (range, id, text)
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for lo in range(0, len(batch), STEP_ROWS):
            part = batch.slice(lo, STEP_ROWS)
            for bucket, ahead, doc, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text"))):
                text = text or ""
                if waiting is not None and waiting[0] == bucket:
                    rows.append((waiting[1], waiting[2], text))
                    size += len(waiting[2])
                waiting = None if ahead else (bucket, doc, text)
                if size >= STEP_CHARS or len(rows) >= STEP_ROWS:
                    yield _compare(rows)
                    rows, size = [], 0
    if rows:
        yield _compare(rows)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row for each of docs (doc_id, text): see _RESULT."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(place, [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0]
    cuts = np.unique(np.array(cuts if cuts is not None else [], np.int64))

    @F.arrow_udf("int")
    def bucket_of(p: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, p.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    placed = docs.select(place.alias("place"), bucket_of(place).alias("bucket"), "doc_id", "text")
    least = sorted(tuple(r) for r in docs.select(bucket_of(place).alias("b"), place.alias("p")).groupBy("b").agg(F.min("p")).collect())  # one row a range
    ahead = [(p, least[k - 1][0]) for k, (_, p) in enumerate(least)]
    extra = spark.createDataFrame(ahead, T.StructType([T.StructField("place", T.LongType()), T.StructField("before", T.IntegerType())]))
    copies = F.array(F.struct(F.col("bucket"), F.lit(False).alias("ahead")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ahead")))
    copies = placed.join(F.broadcast(extra), "place", "left").select("place", "doc_id", "text", F.explode(F.slice(copies, 1, F.when(F.col("before").isNull(), 1).otherwise(2))).alias("to"))
    dealt = copies.select("to.bucket", "to.ahead", "place", "doc_id", "text").repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "ahead", "place", "text")
    return dealt.drop("place").mapInArrow(_in_order, _RESULT)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
