"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A sentence's probability is a logistic function of its words' weights; a document is toxic unless all of its sentences
are clean. The background, the probability p0 of a sentence without weighted words, counts once in a document, and a
sentence counts by what its words add to it: p = 1 - (1 - p0) * product((1 - p_sentence) / (1 - p0)) over the sentences
whose words' weights sum to more than 0. So a score doesn't grow with the number of sentences that say nothing. Only
documents carry labels, so the gradient of a document's loss is shared among its sentences by how likely each is the
offender. The trained model then scores every sentence of every document and locates the offending ones.

The model is fitted from at most TRAIN_DOCUMENTS labelled documents, those with the smallest hashes of their ids, outside
the held-out fold (CRC-32 of the id as text, modulo 5, is 0), and of these from as many, in that order, as have
TRAIN_BYTES of text together; texts of more than LONGEST bytes are scored but don't train. Spark counts in how many toxic and clean documents each feature occurs; only features that
differ by label are kept, and only where they occur (a sentence without any adds nothing to a gradient) comes to the
driver, where the weights are fitted. The model is a vector of 2^FEATURE_BITS weights (1 MB), broadcast to the scan, which
needs no shuffle. Labels, language, source and id are no inputs of a score.

Defined results: null, empty and letterless texts score as one empty sentence; repeated rows score alike; null ids are
scored, not held out, and never train; of rows that share a labelled id the least text trains; an id that is labelled
both ways counts as toxic; with no labels to learn from all scores are the prior, below 0.5; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilelake.llm.common import Words, crc32_text, drop_staged, named, slices, stage, table, text_buffer

#: Bounds of the training sample: documents, bytes of their texts, and bytes of one text (longer ones teach nothing).
TRAIN_DOCUMENTS, TRAIN_BYTES, LONGEST, FOLDS = 6000, 256 << 20, 16 << 20, 5
FEATURE_BITS = 18
#: A word counts with its whole form and with its first bytes, so that rare inflections share a weight.
PREFIX_BYTES = (4, 5, 6)
WIDTH = 1 + len(PREFIX_BYTES)
#: Features enter training where documents with and without them differ so much by label (root of the likelihood ratio).
LEAST_EVIDENCE = 4.0
#: Training: steps, step size, decay of weights, first and highest bias.
STEPS, RATE, DECAY, BIAS, MOST_BIAS = 200, 0.1, 0.5, -6.0, -4.0

_letters = np.zeros(256, bool)
_letters[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ends = np.zeros(256, bool)
_ends[list(b".!?\n")] = True


class Sentences:
    """Word features of each sentence of several texts; a text without words has one sentence without features."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffer(column)
        words = Words(data, offsets, _letters)
        #: A row for each word: its features.
        hashes = [words.hashes(lower=True), *words.prefix_hashes(PREFIX_BYTES)]
        self.features = np.stack([(h >> np.uint64(64 - FEATURE_BITS)).astype(np.int32) for h in hashes], axis=1)
        marks = np.flatnonzero(_ends[data])
        # a sentence begins at a text's first word or at the first word after an end mark
        ordinal = np.searchsorted(marks, words.starts)
        fresh = np.ones(len(words.starts), bool)
        fresh[1:] = ordinal[1:] != ordinal[:-1]
        fresh[words.bounds[:-1][words.bounds[:-1] < len(fresh)]] = True
        self.first = np.flatnonzero(fresh)
        #: Sentences of text k: bounds[k] to bounds[k + 1].
        self.bounds = np.searchsorted(self.first, words.bounds)
        after = np.append(self.first[1:], len(words.starts))[: len(self.first)]
        code_points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = np.repeat(code_points[offsets[:-1]], np.diff(self.bounds))
        self.starts = code_points[words.starts[self.first]] - base
        self.ends = code_points[words.ends[after - 1]] - base

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Sentences' logits; a feature counts once in a sentence, however often its words are repeated."""
        word, column = np.nonzero(weights[self.features])
        sentence = np.searchsorted(self.first, word, side="right") - 1
        hits = np.unique(sentence << FEATURE_BITS | self.features[word, column])
        return np.bincount(hits >> FEATURE_BITS, weights[hits & (1 << FEATURE_BITS) - 1], len(self.first)) + bias


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _added(z: np.ndarray, bias: float) -> np.ndarray:
    """What sentences add to their documents' -log(1 - p): nothing, if their words don't raise the logit above the bias."""
    return np.maximum(_softplus(z) - _softplus(bias), 0)


def _noisy_or(z: np.ndarray, bounds: np.ndarray, bias: float) -> np.ndarray:
    """Documents' probabilities from their sentences' logits and one background."""
    sums = np.concatenate([[0.0], np.cumsum(_added(z, bias))])
    return -np.expm1(-(_softplus(bias) + sums[bounds[1:]] - sums[bounds[:-1]]))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature, in how many toxic and clean documents of a run of rows it occurs."""
    for batch in batches:
        for part in slices(batch):
            own, toxic = Sentences(part.column("text")), part.column("toxic").to_numpy()
            words = np.append(own.first, len(own.features))[own.bounds]
            document = np.repeat(np.arange(len(part)), np.diff(words) * WIDTH)
            seen = np.unique(document << FEATURE_BITS | own.features.reshape(-1))
            feature, label = seen & (1 << FEATURE_BITS) - 1, toxic[seen >> FEATURE_BITS]
            of = np.stack([np.bincount(feature[label == y], minlength=1 << FEATURE_BITS) for y in (0, 1)])
            at = np.flatnonzero(of.any(axis=0))
            yield pa.record_batch({"feature": pa.array(at, pa.int32()), "clean": pa.array(of[0, at], pa.int64()), "bad": pa.array(of[1, at], pa.int64())})


def _hits(kept: np.ndarray):
    """For each document, the kept features of its sentences, by place in kept, as sentence * len(kept) + place."""
    name = np.full(1 << FEATURE_BITS, -1, np.int64)
    name[kept] = np.arange(len(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = Sentences(part.column("text"))
                word, column = np.nonzero(name[own.features] >= 0)
                sentence = np.searchsorted(own.first, word, side="right") - 1
                hits = np.unique(sentence * len(kept) + name[own.features[word, column]])
                cuts = np.searchsorted(hits, own.bounds * len(kept))
                each = [hits[a:b] - first * len(kept) for a, b, first in zip(cuts[:-1], cuts[1:], own.bounds)]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "toxic": part.column("toxic"), "hits": pa.array(each, pa.list_(pa.int64()))})

    return run


def fit(hits: list[np.ndarray], toxic: np.ndarray, features: int) -> tuple[np.ndarray, float]:
    """Weights of the kept features and bias of the sentence model: full-batch Adam on the noisy-or's log loss.

    hits: for each document sentence * features + feature, distinct. Sentences without any hit pull at nothing.
    """
    if not len(toxic) or toxic.min() == toxic.max():
        return np.zeros(features), BIAS
    document = np.repeat(np.arange(len(toxic)), [len(h) for h in hits])
    local, word = np.divmod(np.concatenate(hits), max(features, 1))
    fresh = np.ones(len(local), bool)
    fresh[1:] = (np.diff(document) != 0) | (np.diff(local) != 0)
    sentence, document = np.cumsum(fresh) - 1, document[fresh]
    sentences = len(document)
    w, m, v, bias = np.zeros(features), np.zeros(features + 1), np.zeros(features + 1), BIAS
    for step in range(1, STEPS + 1):
        raised = np.bincount(sentence, w[word], sentences)
        z = np.minimum(raised + bias, 30)
        total = np.clip(_softplus(bias) + np.bincount(document, _added(z, bias), len(toxic)), 1e-9, 30)
        pull = np.where(toxic == 1, -1 / np.expm1(total), 1.0) / len(toxic)
        background = 1 / (1 + np.exp(-bias))
        own = pull[document] * (raised >= 0)  # weights begin at 0 and must be able to leave it
        gz = own / (1 + np.exp(-z))
        g = np.append(np.bincount(word, gz[sentence], features) + DECAY * w / len(toxic), pull.sum() * background + (gz - own * background).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias = min(bias - move[-1], MOST_BIAS)
    return w, float(bias)


def _evidence(seen: Column, n: Column, others: Column, m: Column) -> Column:
    """Root of the likelihood ratio that seen of n documents and others of m hold a feature with unlike shares; 0 or less
    where the first share is no larger."""
    both = (seen + others) / (n + m)

    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    ratio = sum((part(k, of * both) + part(of - k, of * (1 - both)) for k, of in ((seen, n), (others, m))), F.lit(0.0))
    return F.sqrt(F.greatest(2 * ratio, F.lit(0.0))) * F.signum(seen / n - others / m)


def fold(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(crc32_text(F.col(doc_id).cast("string")), F.lit(FOLDS)), F.lit(-1))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model, from a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold() > 0)
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.orderBy(*order).limit(TRAIN_DOCUMENTS)  # 96 kB at most
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.coalesce(F.min("text"), F.lit("")).alias("text"))
    sized = stage(texts.withColumn("size", F.octet_length("text")))
    upto = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # one row a document of the sample
    within = sized.select("doc_id", "size").where(F.col("size") <= LONGEST).withColumn("upto", upto).where(F.col("upto") <= TRAIN_BYTES).select("doc_id")
    sample = sized.join(F.broadcast(within), "doc_id").select("doc_id", F.col("toxic"), "text")
    bad, n = sample.agg(F.sum("toxic"), F.count("*")).first()
    weights = np.zeros(1 << FEATURE_BITS, np.float32)
    if not bad or bad == n:
        drop_staged(sized)
        return weights, BIAS
    counts = sample.mapInArrow(_occurrences, "feature int, clean long, bad long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    telling = counts.where(_evidence(F.col("bad"), F.lit(bad), F.col("clean"), F.lit(n - bad)) >= LEAST_EVIDENCE).select("feature")
    kept = np.sort(telling.toArrow().column("feature").to_numpy())  # 2^FEATURE_BITS at most
    rows = sample.mapInArrow(_hits(kept), "doc_id long, toxic int, hits array<long>").toArrow().sort_by("doc_id")
    drop_staged(sized)
    hits = [x.values.to_numpy(zero_copy_only=False) for x in rows.column("hits")]
    weights[kept], bias = fit(hits, rows.column("toxic").to_numpy(), len(kept))
    return weights, bias


_SCORED = [T.StructField("score", T.DoubleType()), T.StructField("offending", T.StringType())]


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            for part in slices(batch):
                own = Sentences(part.column("text"))
                z = own.scores(weights, bias)
                bad = z >= 0
                spans = [",".join(f"{s}:{e}" for s, e in zip(own.starts[a:b][bad[a:b]].tolist(), own.ends[a:b][bad[a:b]].tolist())) for a, b in zip(own.bounds[:-1], own.bounds[1:])]
                yield pa.record_batch({"row": part.column("row"), "score": pa.array(_noisy_or(z, own.bounds, bias)), "offending": pa.array(spans, pa.string())})

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row (a struct of the columns of docs), score, and the offending sentences as start:end in code points."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.col("text"))
    return rows.mapInArrow(_score(model), T.StructType([rows.schema["row"], *_SCORED]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = spark.sparkContext.broadcast(train(docs, table(spark, sf_dir, "labels")))
    rows = docs.select(F.struct("doc_id").alias("row"), "text")
    out = rows.mapInArrow(_score(model), T.StructType([rows.schema["row"], *_SCORED]))
    return out.select("row.doc_id", (fold("row.doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "offending")


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay, with all their columns."""
    kept = score(docs, table(spark, sf_dir, "labels")).where("score < 0.5")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
