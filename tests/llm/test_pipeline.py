"""The pipeline, stage by stage, against plain versions of what each stage must do to what it is given."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_operators import WORD, check_packing, classes, prose, reference, secret, shingles  # noqa: F401

import corpus_pipeline
from tilelake.llm import common, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("tables"))
    passage, base, rows, marks = prose(rng, 70), prose(rng, 100), [], []
    for k in range(300):
        own = [prose(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 5))]
        if k % 6 == 0:
            own.append(f"you {rng.choice(['grumblo', 'snark'])} {prose(rng, 3)}")
        if k % 17 == 1:
            own = [base if k % 2 else base + " tail"]
        if k % 29 == 3:
            own.insert(1, passage)
        if k % 31 == 5:
            own.append('token = "' + f"{k:032x}" + '"')
        rows.append((k, None if k == 200 else ". ".join(own), "en", f"s{k % 3}", None if k == 200 else len(". ".join(own))))
        marks.append((k, 1, int(k % 6 == 0)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder):
    """What goes in and out of each stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, function in corpus_pipeline.STAGES:
        found = corpus_pipeline.stage(function(spark, docs, folder))
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in found.collect()], found.columns)
        docs = found
    return out


def test_order_and_columns(steps):
    assert list(steps) == ["toxicity", "ngram_join", "substring_dedup", "secret_scan", "packing"]
    assert all(columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, columns in list(steps.values())[:-1])


def test_toxic_documents_go(spark, folder, steps):
    before, after, _ = steps["toxicity"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    truly = {r["doc_id"] for r in before if re.search("grumblo|snark", r["text"] or "")}
    assert len(gone & truly) >= 0.9 * len(truly) and not gone - truly
    assert all(r in before for r in after)


def test_one_of_each_group_stays(steps):
    before, after, _ = steps["ngram_join"]
    expected = classes({r["doc_id"]: shingles(r["text"]) for r in before})
    assert sorted(r["doc_id"] for r in after) == sorted({i for i, c in expected.items() if i == c})
    assert all(r in before for r in after)


def test_repeated_passages_go(steps):
    before, after, _ = steps["substring_dedup"]
    words, seen = {r["doc_id"]: WORD.findall(r["text"] or "") for r in before}, {}
    for w in words.values():
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    got, cut = {r["doc_id"]: r for r in after}, 0
    for r in before:
        w = words[r["doc_id"]]
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r["text"]
        cut += bool(gone)
        assert got[r["doc_id"]] == r | {"text": text, "n_chars": None if text is None else len(text)}
    assert cut > 3


def test_secrets_are_replaced(steps):
    before, after, _ = steps["secret_scan"]
    got, hidden = {r["doc_id"]: r["text"] for r in after}, 0
    for r in before:
        out, at = "", 0
        for a, _, b, _ in secret(r["text"] or ""):
            if a >= at:
                out, hidden = out + (r["text"] or "")[at:a] + "[SECRET]", hidden + 1
            at = max(at, b)
        assert got[r["doc_id"]] == (None if r["text"] is None else out + r["text"][at:])
    assert hidden > 3


def test_everything_left_is_packed(steps, reference):  # noqa: F811
    before, after, _ = steps["packing"]
    check_packing(after, {r["doc_id"]: r["text"] for r in before}, reference)
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}


def test_run_is_the_stages(spark, folder, steps):
    """run() gives the last stage's rows, but for the numbers of sequences, and leaves no staged table but its own."""
    own = lambda r: (r["doc_id"], r["doc_tokens"])
    before = set(common._staged)
    got = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    assert {own(r) for r in got} == {own(r) for r in steps["packing"][1]}
    for rows in (got, steps["packing"][1]):
        assert sum(r["length"] for r in rows) == sum(n for _, n in {own(r) for r in rows})
    assert len(set(common._staged) - before) == 1


def test_held_out_labels_are_not_learnt(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held, turned = toxicity.fold() == 0, F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    assert labels.where(held).count() > 30
    scores = [{r["row"]["doc_id"]: r["score"] for r in toxicity.score(docs, x).collect()} for x in (labels, labels.where(~held), labels.withColumn("toxic", turned))]
    assert scores[0] == scores[1] == scores[2]


def test_stages_keep_odd_columns(spark, folder):
    """A map, and names with dots, with back-ticks and of the stages' own columns go through every stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    extra = {"a.b": F.concat("source", F.lit("!")), "x`y": F.lit(2), "__key": F.lit(3), "row": F.lit("r"), "__new": F.lit(4), "__all": F.lit(5), "class": F.col("doc_id"), "m": F.create_map(F.lit("k"), F.col("doc_id")), "kept": F.lit(6)}
    odd = docs.withColumns(extra)
    odd = odd.union(odd.where("doc_id < 9"))
    plain = docs.union(docs.where("doc_id < 9"))
    for name, function in corpus_pipeline.STAGES:
        if name == "packing":
            assert function(spark, odd, folder).count() == function(spark, plain, folder).count()
            continue
        odd, plain = (common.stage(function(spark, x, folder)) for x in (odd, plain))
        assert odd.columns == [*docs.columns, *extra]
        text = lambda r: (r["doc_id"], r["text"])
        rows = odd.collect()
        assert sorted(map(text, rows), key=str) == sorted(map(text, plain.collect()), key=str)
        assert all(r["m"] == {"k": r["doc_id"]} and r["a.b"] == r["source"] + "!" and r["class"] == r["doc_id"] for r in rows)
