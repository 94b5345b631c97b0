"""Merkle manifest, prefix trie and language ID against plain versions, with every odd case."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilelake.llm import common, langid, merkle, trie

CLASHES = ("tree", "pos", "digest", "path", "nodes", "block", "row", "a.b", "conv", "depth", "letters", "k1", "_part")


def odd_columns(frame):
    """Extra columns: names that operators use inside, a dotted one, one of type map."""
    return frame.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)}).withColumn("mapped", F.create_map(F.lit("k"), F.lit(1)))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- places in groups ---------------------------------------------------------------------------------------------------


def test_numbered(spark):
    """A large group over many partitions, groups of one row, copies of one row; any batch size."""
    rng = random.Random(1)
    rows = [("big", rng.randint(0, 50)) for _ in range(3000)] + [("all alike", 1)] * 2000 + [(f"s{k}", k) for k in range(300)] + [("big", None)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, v long").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = [tuple(r) for r in common.numbered(frame, "g", ["v"]).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = defaultdict(list)
    for g, v, pos in got:
        groups[g].append((pos, v))
    wanted = defaultdict(list)
    for g, v in rows:
        wanted[g].append(v)
    assert set(groups) == set(wanted)
    for g, own in groups.items():
        own.sort()
        assert [p for p, _ in own] == list(range(len(own)))
        assert [v for _, v in own] == sorted(wanted[g], key=lambda v: (v is not None, v))
    assert common.numbered(frame.limit(0), "g", ["v"]).count() == 0


# --- 11 -----------------------------------------------------------------------------------------------------------------


def grown(level):
    out = [level]
    while len(level) > 1:
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
        out.append(level)
    return out


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else ""))
        i >>= 1
    return out


def folded(now, path):
    for left, other in path:
        now = sha(other, now) if left else sha(now, other)
    return now


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars), as documents has them."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, s, n: sha(*map(field, (d, s, lang, n, t)))
    trees = defaultdict(list)
    for d, t, lang, s, n in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        trees[lang].append((d, leaf(d, t, lang, s, n), leaf(d, t, lang, s, n + 1) if hit and n is not None else None))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    levels = {k: grown([x[1] for x in own]) for k, own in trees.items()}
    top = grown([levels[k][-1][0] for k in names])
    out = []
    for k, own in trees.items():
        for i, (d, one, changed) in enumerate(own):
            path = path_of(levels[k], i) + path_of(top, names.index(k))
            root = folded(changed or one, path)
            out.append((d, one, levels[k][-1][0], top[-1][0], sha(*(s for _, s in path)), root, root == top[-1][0]))
    return Counter(out)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("step", [1, 2, 8])
def test_merkle(spark, monkeypatch, step):
    """Trees of many sizes beside powers of the step, a language each; null and repeated ids; SQL gives the same."""
    monkeypatch.setattr(merkle, "STEP", step)
    rows, n = [], 0
    for k, size in enumerate([1, 2, 3, 4, 5, 16, 17, 31, 70] if step < 8 else [1, 3, 255, 256, 257, 600]):
        rows += [(n + i, f"text é {i}", f"l{k % 3}{k}", f"s{i % 2}", i) for i in range(size)]
        n += size
    rows += [(5000, "", "ä", None, None), (5000, None, "ä", "", 9), (5001, "same", None, "s", 1), (5001, "same", None, "s", 1), (None, "no id", None, "s", 4), (7, "x" * 300_000, "z", "s", 2**63 - 1)]
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    monkeypatch.setattr(merkle, "table", lambda *_: odd_columns(frame))
    got = merkle.op11_merkle_manifest(spark, "").collect()
    assert Counter(map(tuple, got)) == plain_manifest(rows)
    documents = frame.toArrow()  # noqa: F841
    assert Counter(map(tuple, got)) == Counter(duckdb.sql(merkle.SQL).fetchall())


def test_merkle_small(spark, monkeypatch, tmp_path):
    for rows in ([], [(3, "one", "en", "s", 3)], [(3, "one", None, "s", 3), (4, "two", "en", "s", 3)]):
        monkeypatch.setattr(merkle, "table", lambda *_: spark.createDataFrame(rows, DOCS))  # noqa: B023
        assert Counter(map(tuple, merkle.op11_merkle_manifest(spark, "").collect())) == plain_manifest(rows)
    leaves = spark.createDataFrame([("=en", k, hashlib.sha256(bytes([k])).digest()) for k in range(200)], "tree string, pos long, digest binary")
    monkeypatch.setattr(merkle, "STEP", 3)
    built = merkle.manifest(leaves)
    assert built.root() == grown([hashlib.sha256(bytes([k])).hexdigest() for k in range(200)])[-1][0]
    assert [x.count() for x in built.trees] == [200, 25, 4, 1]  # every third level is persisted, no other
    built.save(f"file://{tmp_path}")
    assert spark.read.parquet(f"file://{tmp_path}/trees/level=6").count() == 4


# --- 12 -----------------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    again = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        again[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in again.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(again[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(ends)))
    return Counter(out)


CONVS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("block", "bits"), [(4096, 12), (3, 1)])
def test_trie(spark, monkeypatch, block, bits):
    """Copies, shared openings of all depths, long chains, conversations without turns, nulls; SQL gives the same."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "ID_BITS", bits)
    rng = random.Random(block)
    rows = []
    for c in range(60):
        rows += [(c, t, "user" if t % 2 else None, rng.choice(["a", "b é"]) if c % 3 else f"{c}-{t}") for t in range(rng.randint(1, 7))]
    for c in range(100, 130):  # copies of one conversation, and 40 turns that two others go on from
        rows += [(c, t, "user", f"copy {t}") for t in range(12)]
    for c in (200, 205, 210, 215):
        rows += [(c, t, "user", f"long {t}" if t < 40 + c % 3 else f"{c} {t}") for t in range(50)]
    rows += [(301, 0, "user", "short"), (301, None, "system", "first"), (302, 1, "user", None), (None, 1, "user", "x"), (-7, 1, "user", "y"), (2**62, 1, "user", "x" * 200_000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, CONVS).repartition(5)
    monkeypatch.setattr(trie, "table", lambda *_: odd_columns(frame))
    got = Counter(map(tuple, trie.op12_prefix_trie(spark, "").collect()))
    assert got == plain_trie(rows)
    conversations = frame.toArrow()  # noqa: F841
    assert Counter(duckdb.sql(trie.SQL).fetchall()) == got


def test_trie_of_repeated_turns(spark, monkeypatch):
    """Equal rows are turns of their own; equal turn numbers have one order in every copy of a conversation."""
    rows = [(c, 0, "user", t) for c in (5, 10) for t in ("z", "y", "y")]
    monkeypatch.setattr(trie, "table", lambda *_: spark.createDataFrame(rows, CONVS).repartition(3))
    got = {(r["conv_id"], r["depth"]): r["n_convs"] for r in trie.op12_prefix_trie(spark, "").collect()}
    assert got == {(5, d): 2 for d in range(4)}
    monkeypatch.setattr(trie, "table", lambda *_: spark.createDataFrame([], CONVS))
    assert trie.op12_prefix_trie(spark, "").count() == 0
    monkeypatch.setattr(trie, "table", lambda *_: spark.createDataFrame([(5, 0, None, None)], CONVS))
    assert Counter(map(tuple, trie.op12_prefix_trie(spark, "").collect())) == plain_trie([(5, 0, None, None)])


def test_rounds_are_few(spark, monkeypatch):
    """A chain of 300 shared turns takes some 10 rounds, not 300."""
    seen = []
    known = trie.stage
    monkeypatch.setattr(trie, "stage", lambda df: seen.append(1) or known(df))
    rows = [(c, t, "user", f"{t}") for c in (5, 10) for t in range(300)]
    frame = spark.createDataFrame(rows, CONVS)
    monkeypatch.setattr(trie, "table", lambda *_: frame)
    assert Counter(map(tuple, trie.op12_prefix_trie(spark, "").collect())) == plain_trie(rows)
    assert len(seen) < 35


# --- 13 -----------------------------------------------------------------------------------------------------------------


def plain_model(texts):
    """For each language: contexts, and what followed them how often."""
    seen = {lang: defaultdict(Counter) for lang, _ in texts}
    for lang, text in texts:
        data = bytes(langid.ORDER) + text.encode()
        for i in range(langid.ORDER, len(data)):
            for k in range(langid.ORDER + 1):
                seen[lang][data[i - k : i]][data[i]] += 1
    return seen


def plain_p(seen, context, byte):
    low = (lambda b: plain_p(seen, context[1:], b)) if context else lambda b: 1 / 256
    counts = seen.get(context)
    if not counts:
        return low(byte)
    n, d = sum(counts.values()), len(counts)
    if byte in counts:
        return counts[byte] / (n if d == 256 else n + d)
    return 0.0 if d == 256 else d / (n + d) * low(byte) / (1 - sum(map(low, counts)))


def plain_bits(seen, text):
    data = bytes(langid.ORDER) + text.encode()
    return sum(-np.log2(plain_p(seen, data[i - langid.ORDER : i], data[i])) for i in range(langid.ORDER, len(data)))


LEARNED = [("a", "abracadabra abracadabra"), ("a", "cabbage and radar"), ("b", "xyzzy xyz zyx abra"), ("b", "yyy zzz é"), ("c", "".join(map(chr, range(1, 200))))]


def test_code_lengths(spark):
    """Each context's probabilities sum to 1, and code lengths are those of a plain recursion."""
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2]
    model = langid.learn(spark.createDataFrame([(ids[k], lang, t) for k, (lang, t) in enumerate(LEARNED)], "doc_id long, lang string, text string"))
    assert model.languages == ["a", "b", "c"]
    seen = plain_model(LEARNED)
    for lang in "abc":
        for context in (b"", b"a", b"bra", b"abra", b"zz", b"\0\0\0\0", b"none"):
            assert abs(sum(plain_p(seen[lang], context, b) for b in range(256)) - 1) < 1e-9
    asked = ["abracadabra", "zyx abba", "", "ééé quite other", "a" * 50, "\0\0x", "radar cabbage xyzzy"]
    data = np.frombuffer("".join(asked).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in asked])
    got = model.lengths(data, offsets) / langid.UNIT
    wanted = np.array([[plain_bits(seen[lang], t) for lang in "abc"] for t in asked])
    assert np.abs(got - wanted).max() < 0.001


def test_blocks_of_long_texts(spark, monkeypatch):
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2]
    model = langid.learn(spark.createDataFrame([(ids[k], lang, t) for k, (lang, t) in enumerate(LEARNED)], "doc_id long, lang string, text string"))
    data = np.frombuffer(("abracadabra xyz radar " * 3000).encode(), np.uint8)
    whole = model.lengths(data, np.array([0, len(data)]))
    monkeypatch.setattr(langid, "BLOCK", 1)  # blocks of 8192 bytes
    assert (model.lengths(data, np.array([0, len(data)])) == whole).all()


def test_language_id(spark, small, monkeypatch):
    """Held-out accuracy on the given documents; the query's rows; labels don't leak into predictions."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = {r["doc_id"]: r for r in langid.op13_language_id(spark, small).collect()}
    assert set(got) == set(langs)
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) >= 0.95 * len(held)
    hidden = docs.withColumn("lang", F.when(langid.fold() == langid.HELD_OUT, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    monkeypatch.setattr(langid, "table", lambda *_: hidden)
    again = {r["doc_id"]: r for r in langid.op13_language_id(spark, small).collect()}
    assert all(again[i]["lang_pred"] == got[i]["lang_pred"] and again[i]["bits"] == got[i]["bits"] for i in got)


def test_language_id_odd(spark, monkeypatch):
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2][:6]
    rows = [(ids[0], "the other word", "en"), (ids[0], "the other word", "en"), (ids[1], "le mot été", "fr"), (ids[2], None, "fr"), (ids[3], "", None), (None, "le mot", "de"), (ids[4], "12 345 !", "en"), (ids[5], "the word " * 100_000, None)]
    frame = odd_columns(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    monkeypatch.setattr(langid, "table", lambda *_: frame)
    got = sorted(((r["doc_id"], r["lang_pred"], r["held_out"]) for r in langid.op13_language_id(spark, "").collect()), key=str)
    assert got == sorted([(ids[0], "en", False), (ids[0], "en", False), (ids[1], "fr", False), (ids[2], "und", False), (ids[3], "und", False), (None, "fr", False), (ids[4], "und", False), (ids[5], "en", False)], key=str)
    kept = langid.identify(frame, langid.learn(frame))
    assert kept.schema["row"].dataType == frame.schema and kept.count() == len(rows)
    for none in (frame.limit(0), frame.withColumn("lang", F.lit(None).cast("string"))):
        assert langid.learn(none) is None
        assert {r["lang_pred"] for r in langid.identify(none, None).collect()} <= {"und"}


def test_training_sample_is_bounded(spark, monkeypatch):
    """Whatever a language has, it gives its share and a piece; ids that repeat give one piece; rare languages give theirs."""
    monkeypatch.setattr(langid, "LANGUAGE_BYTES", 3000)
    monkeypatch.setattr(langid, "PIECE", 100)
    one = next(k for k in range(9) if zlib.crc32(str(k).encode()) % 4 != 2)
    rows = [(k, "en", f"word{k} " * 40) for k in range(3000)] + [(one, "fr", f"mot {k} " * 40) for k in range(20)] + [(k, "de", "kurz") for k in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    languages, sample = langid._sample(frame)
    assert languages == ["de", "en", "fr"]
    sizes = {r["lang"]: (r["n"], r["size"]) for r in sample.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    assert 2000 < sizes["en"][1] <= 3100 and sizes["fr"] == (1, 100)
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    assert langid._sample(frame)[0] == ["en", "fr"]
