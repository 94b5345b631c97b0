"""Language ID by prediction by partial matching: the language whose byte model gives a text the shortest code.

Each language has a variable-order tree of byte contexts, up to ORDER bytes long. A context that was seen n times with d
different next bytes gives a byte that followed it c times the probability c / (n + d); the rest, d / (n + d), is its
escape to the context one byte shorter, spread over the bytes that it hasn't seen in proportion to that context's
probabilities, so that each context's probabilities sum to 1 (a context that has seen all 256 bytes has no escape). Below
the empty context all bytes are alike. The statistics are frozen: a text's code length under each language is the exact
sum of -log2 over its bytes, kept in units of 2^-16 bit, so the order in which bytes are summed can't matter. ORDER zero
bytes precede each text as its first context.

The trees are learned from a bounded sample (the parameters below): Spark counts the languages, draws documents by a hash
of their ids, and counts the sample's byte runs by language before they reach the driver, which turns counts into code
lengths. These go to the tasks as one table for each order, a row for each run of bytes and a column for each language:
where a run is known, one look-up gives its last byte's code length in all languages. Texts are scored whole, in one pass
without a shuffle, a long one in blocks.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything if there is nothing
to learn from; a null language teaches nothing; null ids are scored, aren't held out and don't teach; repeated rows score
alike; ties go to the least language; an empty table gives no rows; extra columns are ignored. A score is the language's
share in the likelihoods of all languages. No input of a prediction but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilelake.llm.common import crc32_text, drop_staged, slices, stage, table, text_buffer

#: Bytes of the longest contexts.
ORDER = 4
#: Bounds of the training sample: languages (the most frequent ones), bytes of one language's texts, and characters of one
#: document (a longer one gives a piece from a place dealt by its id). Many languages share: with n of them, one has at
#: most TABLE_BYTES / (4 n^2) bytes, so that no broadcast table has more than about TABLE_BYTES.
LANGUAGES, LANGUAGE_BYTES, PIECE, TABLE_BYTES = 256, 512 << 10, 8 << 10, 64 << 20
FOLDS, HELD_OUT = 4, 2
#: Code lengths are kept in 2^-16 bit.
UNIT = 1 << 16
#: Bytes of text times languages that are scored at once.
BLOCK = 4 << 20


def runs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte of several texts, the run of ORDER + 1 bytes that ends there, as one number; zeros precede a text."""
    at = np.arange(len(data)) + ORDER * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    padded = np.zeros(len(data) + ORDER * len(offsets), np.uint64)
    padded[at] = data
    out = padded.copy()
    for back in range(1, ORDER + 1):
        out[back:] |= padded[:-back] << np.uint64(8 * back)
    return out[at]


def ending(keys: np.ndarray, size: int) -> np.ndarray:
    """The last size bytes of runs."""
    return keys & np.uint64((1 << 8 * size) - 1)


class Runs:
    """Which row of a table a run of bytes has: open addressing, at most a quarter of the slots full."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(4 * len(keys)).bit_length())
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.rows[slot[todo]] < 0
            self.rows[slot[todo[free]]] = todo[free]
            self.keys[slot[todo[free]]] = keys[todo[free]]
            todo = todo[self.rows[slot[todo]] != todo]
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of keys, -1 where there is none."""
        slot = self._slot(keys)
        out = self.rows[slot]
        todo = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1
            out[todo] = self.rows[slot[todo]]
            todo = todo[(self.keys[slot[todo]] != keys[todo]) & (out[todo] >= 0)]
        return out


class Model:
    """Frozen code lengths: by order, of the last byte of known runs and of escapes from known contexts, by language."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each order the sorted distinct runs of one byte more, and how often each language has them."""
        self.languages = languages
        self.runs: list[Runs] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[Runs] = []
        self.escapes: list[np.ndarray] = []
        below_keys, below = np.arange(256, dtype=np.uint64), np.full((256, len(languages)), 1 / 256)
        for order, (keys, count) in enumerate(counts):
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            shorter = keys & np.uint64((1 << 8 * max(order, 1)) - 1)
            low = below[np.searchsorted(below_keys, shorter)]
            n, d = np.add.reduceat(count, first), np.add.reduceat((count > 0).astype(np.int64), first)
            full = d == 256
            known = np.add.reduceat(np.where(count > 0, low, 0.0), first)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n == 0, 1.0, np.where(full, 0.0, d / (n + d) / np.maximum(1 - known, 1e-300)))
                p = np.where(count > 0, count / np.maximum(n + np.where(full, 0, d), 1)[of], escape[of] * low)
            self.runs.append(Runs(keys))
            self.costs.append(self._units(p))
            self.contexts.append(Runs(context[first]))
            self.escapes.append(self._units(escape))
            below_keys, below = keys, p

    @staticmethod
    def _units(p: np.ndarray) -> np.ndarray:
        """-log2 in units; what can't occur costs 64 bits (only beside a context that has seen all bytes, so never)."""
        return np.rint(np.minimum(-np.log2(np.maximum(p, 2.0**-64)), 64) * UNIT).astype(np.int32)

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths of texts by language, in units."""
        most = max(BLOCK // len(self.languages), 1 << 13)
        if len(data) > most and len(offsets) == 2:  # a long text, by blocks that begin with ORDER bytes of the one before
            out = self._lengths(data[:most], np.array([0, most]), 0)
            for lo in range(most, len(data), most):
                block = data[lo - ORDER : lo + most]
                out += self._lengths(block, np.array([0, len(block)]), ORDER)
            return out
        return self._lengths(data, offsets, 0)

    def _lengths(self, data: np.ndarray, offsets: np.ndarray, skip: int) -> np.ndarray:
        keys = runs(data, offsets)[skip:]
        out = np.zeros((len(keys), len(self.languages)), np.int32)
        todo = np.arange(len(keys))
        for order in range(ORDER, -1, -1):
            own = ending(keys, order + 1)
            row = self.runs[order].find(own)
            hit = row >= 0
            out[todo[hit]] += self.costs[order][row[hit]]
            todo, keys, own = todo[~hit], keys[~hit], own[~hit]
            row = self.contexts[order].find(own >> np.uint64(8))
            hit = row >= 0
            out[todo[hit]] += self.escapes[order][row[hit]]
        out[todo] += 8 * UNIT
        ends = np.maximum(offsets - skip, 0)
        sums, some = np.zeros((len(offsets) - 1, out.shape[1]), np.int64), np.flatnonzero(np.diff(ends))
        if len(some):
            sums[some] = np.add.reduceat(out, ends[some], axis=0, dtype=np.int64)
        return sums


def _tally(languages: list[str]):
    """How often each run of 1 to ORDER + 1 bytes occurs in a language, for each run of rows (lang, text)."""
    number = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_buffer(part.column("text"))
                lang = np.repeat(np.array([number[x] for x in part.column("lang").to_pylist()], np.int32), np.diff(offsets))
                keys = runs(data, offsets)
                for k in np.unique(lang):
                    for size in range(1, ORDER + 2):
                        run, n = np.unique(ending(keys[lang == k], size), return_counts=True)
                        same = np.ones(len(run), np.int32)
                        yield pa.record_batch({"size": pa.array(same * size), "lang": pa.array(same * k), "run": pa.array(run.view(np.int64)), "n": pa.array(n, pa.int64())})

    return run


def fold(doc_id: str = "doc_id") -> Column:
    """The remainder of the CRC-32 of an id's text; -1 for a null id."""
    return F.coalesce(crc32_text(F.col(doc_id).cast("string")) % FOLDS, F.lit(-1))


def _sample(docs: DataFrame) -> tuple[list[str], DataFrame | None]:
    """The languages, in order, and their sample, staged as (lang, text)."""
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text <> ''").where(~fold().isin(HELD_OUT, -1))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.least(F.octet_length("text"), F.lit(PIECE)).cast("double")).alias("size"))
    found = sizes.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not found:
        return [], None
    share = min(LANGUAGE_BYTES, max(1, TABLE_BYTES // 4 // len(found) ** 2))
    # Drawn are those whose hash lies in the part of all hashes that a language needs; twice that, as sizes differ.
    parts = docs.sparkSession.createDataFrame([(x["lang"], 2 * share / x["size"] + 20 / x["n"]) for x in found], "lang string, part double")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1) + 1
    drawn = known.withColumn("chance", chance).join(F.broadcast(parts), "lang").where("chance < part")
    pieces = drawn.groupBy("lang", "chance", "doc_id").agg(F.min(F.substr("text", place.cast("int"), F.lit(PIECE))).alias("text"))
    size = F.octet_length("text")
    # A language's drawn pieces, in one task: about twice its share and 20 pieces, whatever the input.
    before = F.sum(size).over(Window.partitionBy("lang").orderBy("chance", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - size
    return sorted(x["lang"] for x in found), stage(pieces.withColumn("before", before).where(F.col("before") < share).select("lang", "text"))


def learn(docs: DataFrame) -> Model | None:
    """The model from the bounded sample of docs outside the held-out fold; None if there is nothing to learn from."""
    languages, sample = _sample(docs)
    if sample is None:
        return None
    counts = sample.mapInArrow(_tally(languages), "size int, lang int, run long, n long").groupBy("size", "lang", "run").agg(F.sum("n").alias("n")).toArrow()
    drop_staged(sample)
    size, lang, run, n = (counts.column(c).to_numpy() for c in ("size", "lang", "run", "n"))
    tables = []
    for k in range(1, ORDER + 2):
        own = size == k
        keys, row = np.unique(run[own].view(np.uint64), return_inverse=True)
        count = np.zeros((len(keys), len(languages)), np.int32)
        count[row, lang[own]] = n[own]
        tables.append((keys, count))
    return Model(languages, tables)


def _identify(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model | None = model.value
        for batch in batches:
            for part in slices(batch, limit=max(BLOCK // (len(own.languages) if own else 1), 1 << 13)):
                if own is None:
                    lang, score, bits = ["und"] * len(part), np.zeros(len(part)), np.zeros(len(part))
                else:
                    units = own.lengths(*text_buffer(part.column("text")))
                    best = units.argmin(axis=1)
                    least = units.min(axis=1)
                    letters = part.column("letters").to_numpy(zero_copy_only=False)
                    score = np.where(letters, 1 / np.exp2(-(units - least[:, None]) / UNIT).sum(axis=1), 0.0)
                    lang, bits = np.where(letters, np.array(own.languages, object)[best], "und"), least / UNIT
                yield pa.record_batch({"row": part.column("row"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "bits": pa.array(bits)})

    return run


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns of docs, or of those in keep), lang_pred, score, bits (the least code length)."""
    row = F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row")
    rows = docs.select(row, F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    fields = [rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    return rows.mapInArrow(_identify(docs.sparkSession.sparkContext.broadcast(model)), T.StructType(fields))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs), ["doc_id"])
    return out.select("row.doc_id", (fold("row.doc_id") == HELD_OUT).alias("held_out"), "lang_pred", "score", "bits")
