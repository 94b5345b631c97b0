"""Secret scans: fixed rules, and two character Markov models compared by log-likelihood ratio.

Rules find assignments of keys, access ids and long hexadecimal runs. Beyond them, each token of 20 characters or more,
without an upper bound, is scored by the sum over its neighbouring characters of log P(next | this, random) -
log P(next | this, ordinary). The model of random strings is trained on the values that rules found in the corpus and on
as many digests in base 64; the model of ordinary identifiers on the words of a sample of documents. Both samples are
labelled by where they come from, and bounded: TRAIN_DOCUMENTS documents with the smallest hashes of their ids, DIGESTS
digests. Tokens above LEAST_EVIDENCE nats that touch no rule's span are added, as kind random.

All of it is DataFrame functions: matches, their positions, counts of character pairs, and scores by array lookups. Counts
of at most 2 x 66^2 pairs come to the driver. Rows don't need each other, so texts are never shuffled.

Defined results: a null or empty text has no spans; repeated rows have equal spans; null ids pass through; an empty table
gives no rows and trains nothing; extra columns are kept by the stage and ignored by the query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilelake.llm.common import named, table
from tilelake.llm.spans import find, free, joined, replaced

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: Tokens that the models judge.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_=-])"
#: Parts of a token, each with the first character of the next: no array grows with a token's length.
PART = r"(?s)(?=(.{1,1001})).{1,1000}"
#: A word in one case, or such words joined as in names of variables; nothing else counts as an ordinary identifier.
WORD = r"(?<![A-Za-z0-9+/_=-])(?:[A-Z]?[a-z]{5,}+(?:[_-][a-z]{2,}+|[A-Z][a-z]{2,}+){0,9}|[A-Z]{6,}+)(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TRAIN_DOCUMENTS, DIGESTS = 2000, 2000
#: Nats by which random must beat ordinary, in all and for each character.
LEAST_EVIDENCE, LEAST_RATE = 12.0, 0.5
#: Occurrences that each character has beforehand, and pairs' worth of trust in single characters.
PRIOR, BACK_OFF = 0.5, 20.0


def rules(docs: DataFrame) -> DataFrame:
    """docs with assign, access and hex: the spans that each rule finds."""
    docs = find(docs, "assign", "text", ASSIGN, F.col("text").rlike("[:=]"))
    docs = docs.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= 8))
    docs = find(docs, "access", "text", ACCESS, F.contains(F.col("text"), F.lit("AKIA")))
    return find(docs, "hex", "text", HEX, F.col("text").rlike("[0-9a-f]{32}"))


def _pairs(strings: DataFrame) -> dict[tuple[str, str], int]:
    """How often each two characters of the alphabet are neighbours in the column s."""
    at = F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i")
    pairs = strings.where(F.length("s") >= 2).select("s", at).select(F.expr("substring(s, i, 2)").alias("pair")).groupBy("pair").count()
    return {tuple(r["pair"]): r["count"] for r in pairs.collect() if set(r["pair"]) <= set(ALPHABET)}  # 66^2 at most


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios of all pairs of characters, row by row of the alphabet."""
    ids = docs.select("doc_id").where("doc_id is not null")
    n = ids.agg(F.approx_count_distinct("doc_id")).first()[0]
    # Ids with small hashes, some four times those wanted, made distinct; of these the ones with the smallest hashes.
    low = F.xxhash64("doc_id") < min(int(-(2.0**63) + 4 * TRAIN_DOCUMENTS / max(n, 1) * 2.0**64), 2**63 - 1)
    chosen = ids.where(low).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2000 ids: texts stay where they are
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text")).select("text", F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ").alias("rest"))
    known = rules(sample.select("text"))
    value = F.transform("assign", lambda s: F.regexp_extract(s["text"], ASSIGN, 1))
    found = known.select(F.explode(F.concat(value, F.col("access.text"), F.col("hex.text"))).alias("s"))
    digests = docs.sparkSession.range(DIGESTS).select(F.regexp_replace(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "=+$", "").alias("s"))
    words = sample.select(F.explode(F.regexp_extract_all("rest", F.lit(WORD), F.lit(0))).alias("s"))
    random, ordinary = (_model(_pairs(x)) for x in (found.union(digests), words))
    return [math.log(random(a, b) / ordinary(a, b)) for a in ALPHABET for b in ALPHABET]


def _model(pairs: dict[tuple[str, str], int]):
    """P(next | this) from counts of pairs; where this is rare, it leans on how common next is."""
    seconds = {b: sum(pairs.get((a, b), 0) for a in ALPHABET) + PRIOR for b in ALPHABET}
    firsts = {a: sum(pairs.get((a, b), 0) for b in ALPHABET) for a in ALPHABET}
    total = sum(seconds.values())
    return lambda a, b: (pairs.get((a, b), 0) + BACK_OFF * seconds[b] / total) / (firsts[a] + BACK_OFF)


def evidence(token: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a token, whatever its length: the sum over its parts."""
    letters, table_ = F.lit(ALPHABET), F.array(*map(F.lit, ratios))

    def of(part: Column) -> Column:
        codes = F.transform(F.split(part, "(?!^)(?!$)"), lambda c: F.instr(letters, c) - 1)
        steps = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.element_at(table_, (a * len(ALPHABET) + b + 1).cast("int")))
        return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)

    return F.aggregate(F.regexp_extract_all(token, F.lit(PART), F.lit(1)), F.lit(0.0), lambda s, part: s + of(part))


def scan(docs: DataFrame) -> DataFrame:
    """docs with assign, access, hex and random spans."""
    ratios = train(docs)
    out = find(rules(docs), "random", "text", TOKEN, F.col("text").rlike("[A-Za-z0-9+/_=-]{20}"))
    out = out.withColumn("__rule", F.concat("assign", "access", "hex"))
    judged = F.filter("__free", lambda t: evidence(t["text"], ratios) >= F.greatest(F.lit(LEAST_EVIDENCE), LEAST_RATE * F.length(t["text"])))
    return out.withColumn("__free", free("random", "__rule")).withColumn("random", judged).drop("__rule", "__free")


def _kinds(names: tuple[str, ...]) -> Column:
    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*map(of, names))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(joined(_kinds(KINDS[:3]), KINDS), 256).alias("base_sha256"), joined(_kinds(KINDS), KINDS).alias("spans"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents keep their rows; the characters of secrets are replaced by [SECRET]."""
    plain = docs.select(F.struct(*map(named, docs.columns)).alias("row"), F.col("text"), F.col("doc_id"))
    found = scan(plain).withColumn("__all", F.concat("assign", "access", "hex", "random"))
    found = replaced(found, "__new", "text", "__all", "[SECRET]")
    own = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("__new")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.size("__all") > 0, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*(own[c].alias(c) for c in docs.columns))
