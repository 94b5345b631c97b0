"""The file sink's commits and aborts, keyed tables, and what is built on them."""

import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilelake.sources import file_sink as S
from tilelake.sources.tables import Folder, KeyedTable


def tree(root):
    """Files below a folder but for the notes of aborted jobs, when their last tasks have ended."""
    time.sleep(1)
    S.sweep(f"file://{root}/out")
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names if not d.endswith("/aborted"))


FILES = "path string, content binary, mtime_ms long"


def test_later_jobs_replace_files(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    S.save(spark.createDataFrame([("a/0_0.xaero", b"one", 5), ("a/1_0.zip", b"", None), ("b", b"x" * 100, 7)], FILES).repartition(3), root)
    S.save(spark.createDataFrame([("a/0_0.zip", b"newer", 9), ("b", b"y", 8)], FILES), root, (".zip", ".xaero"))
    S.save(spark.createDataFrame([("a/0_0.txt", b"t", 10)], FILES), root)
    got = S.contents(S.listing(spark, root), root).collect()
    assert sorted((r["path"], r["content"], r["mtime_ms"], r["bytes"]) for r in got) == [("a/0_0.txt", b"t", 10, 1), ("a/0_0.zip", b"newer", 9, 5), ("a/1_0.zip", b"", None, 0), ("b", b"y", 8, 1)]
    # an older extension that comes back is the newest again
    S.save(spark.createDataFrame([("a/0_0.xaero", b"back", 11)], FILES), root, (".zip", ".xaero"))
    assert "a/0_0.zip" not in {r["path"] for r in S.listing(spark, root).collect()}
    did = S.place(S.listing(spark, root), root, f"{tmp_path}/live").collect()
    assert {r["did"] for r in did} == {"copied"} and (tmp_path / "live/a/0_0.xaero").read_bytes() == b"back"
    assert round(os.stat(tmp_path / "live/b").st_mtime * 1000) == 8
    assert {r["did"] for r in S.place(S.listing(spark, root), root, f"{tmp_path}/live").collect()} == {"present"}


def test_aborted_job_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    S.save(spark.createDataFrame([("a", b"old", 1)], FILES), root)
    before = tree(tmp_path)

    def break_off(batches):
        for rows in batches:
            yield rows
            if "z19" in rows.column("path").to_pylist():
                raise RuntimeError("lost")

    many = spark.createDataFrame([("a", b"new", 2)] + [(f"z{k}", b"n", 2) for k in range(20)], FILES).repartition(4).mapInArrow(break_off, FILES)
    with pytest.raises(Exception, match="lost"):
        S.save(many, root)
    assert tree(tmp_path) == before
    assert [r["content"] for r in S.contents(S.listing(spark, root), root).collect()] == [b"old"]
    for bad in ("../up", "/abs", "a//b", "", "a\\b"):
        with pytest.raises(Exception, match="below the root"):
            S.save(spark.createDataFrame([(bad, b"", 0)], FILES), root)
    assert tree(tmp_path) == before


def test_only_committed_attempts_count(tmp_path):
    """A task that ran twice: the attempt whose message came counts, the other's files go."""
    writer = S.Writer({"root": f"file://{tmp_path}"})
    rows = lambda v: iter([pa.record_batch({"path": ["p"], "content": pa.array([v], pa.binary())})])
    lost, kept = writer.write(rows(b"lost")), writer.write(rows(b"kept"))
    writer.commit([kept, None])
    assert not (tmp_path / lost.folder).exists() and (tmp_path / kept.folder / "p").read_bytes() == b"kept"
    assert S.manifests(f"file://{tmp_path}")[0]["folders"] == [kept.folder]
    other = S.Writer({"root": f"file://{tmp_path}"})
    other.write(rows(b"never"))
    other.abort([None])
    assert len(list((tmp_path / "staged").iterdir())) == 1
    assert other.write(rows(b"late")) and len(list((tmp_path / "staged").iterdir())) == 2
    S.sweep(f"file://{tmp_path}")
    assert len(list((tmp_path / "staged").iterdir())) == 1


def test_keyed_table(spark, tmp_path):
    """An update rewrites the buckets of its keys only; a failed one changes nothing; versions don't overwrite each other."""
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k long, v string", ("k",), buckets=8)
    assert t.read().count() == 0 and t.manifest()["version"] == 0
    t.replace(spark.createDataFrame([(k, "a") for k in range(100)], "k long, v string"))
    before = t.manifest()["parts"]
    new = spark.createDataFrame([(3, "b"), (200, "b")], "k long, v string")
    t.update(new, lambda old: old.join(new, "k", "left_anti").unionByName(new), {"seen": 2})
    after = t.manifest()
    touched = t.touched(new)
    assert {int(b) for b in after["parts"] if before.get(b) != after["parts"][b]} == touched and after["note"] == {"seen": 2}
    assert sorted(map(tuple, t.read().collect())) == sorted([(k, "b" if k == 3 else "a") for k in range(100)] + [(200, "b")])
    with pytest.raises(ValueError, match="other buckets"):
        t.update(new, lambda old: old.withColumn("k", F.col("k") + 1))
    with pytest.raises(FileExistsError):
        t.folder.create(f"manifest/{after['version']:012d}.json", "{}")
    assert t.manifest() == after
    gone = spark.createDataFrame([(3, "")], "k long, v string")
    t.update(gone, lambda old: old.join(gone, "k", "left_anti"))
    assert t.read().where("k = 3").count() == 0
    t.clean()
    assert len(os.listdir(tmp_path / "t/manifest")) <= 2 and t.read().count() == 100
    used = {p.split("/")[1] for p in t.manifest()["parts"].values()}
    assert set(Folder(spark, f"file://{tmp_path}/t").names("data")) == used


def test_vault_rewrites_scanned_files_only(spark, tmp_path):
    """Two scans: buckets of files that weren't read keep their files, and the rows are those of the operator."""
    from tilelake.operators import waypoints as W
    from tilelake.plans.history_queries import _records
    from tilelake.sources import vault

    records = _records(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    t = vault.vault(spark, f"file://{tmp_path}/v", records.schema, buckets=16)
    vault.sync(t, records, records, 10)
    first = t.manifest()["parts"]
    one = records.where("world = 'world1' and side = 'A'")
    vault.sync(t, one.where("ord % 2 = 0"), one, 20)
    moved = {b for b, p in t.manifest()["parts"].items() if first[b] != p}
    assert len(moved) == 1 and len(first) > 3
    plain = W.sync(W.sync(t.read().limit(0), records, records, 10).drop("was_present"), one.where("ord % 2 = 0"), one, 20).drop("was_present")
    columns = [*W.KEY, "color", "present", "first_seen", "last_seen"]
    assert sorted(map(str, t.read().select(*columns).collect())) == sorted(map(str, plain.select(*columns).collect()))
    assert vault.export(t.read(), f"file://{tmp_path}/none", world="nowhere").count() == 0


def test_feed_by_a_plain_loop(spark, tmp_path):
    """Batches of notices with floods and lost ones, full looks at most each 30 s, and batches that come twice."""
    from tilelake.streaming import changes

    disk, rows, batches = {}, [], []
    import random

    rng = random.Random(4)
    for k in range(9):
        now = 1_000 + k * 8_000
        own = {(f"l{rng.randint(0, 1)}", rng.randint(0, 5), rng.randint(0, 5)) for _ in range(12 if k in (2, 3, 6) else 4)}
        for place in own:
            if rng.random() < 0.25:
                disk.pop(place, None)
            else:
                disk[place] = (now, rng.randint(1, 3), True)
        seen = [p for p in own if rng.random() < 0.7] if k in (2, 6) else sorted(own)
        batches.append(([(*p, now, False) for p in seen] + ([("", None, None, now, True)] if k == 5 else []), dict(disk), now))
    state = {}

    def look(places, now):
        frame = spark.createDataFrame([(*p, *m) for p, m in state.items()], changes.INDEX)
        return frame if places is None else frame.join(places, ["layer", "rx", "rz"], "left_semi")

    table = changes.index_table(spark, f"file://{tmp_path}/i", buckets=4)
    feed = changes.IndexFeed(table, look, f"file://{tmp_path}/log", cap=8)
    index, log, waiting, last = {}, [], False, None
    for number, (notices, there, now) in enumerate(batches):
        state.clear()
        state.update(there)
        frame = spark.createDataFrame(notices, "layer string, rx int, rz int, t_ms long, lost boolean")
        feed(frame, number)
        if number % 3 == 0:
            feed(frame, number)  # comes again after it was taken
        places = {n[:3] for n in notices if not n[4]}
        flooded = any(n[4] for n in notices) or len(places) > 8
        waiting = waiting or flooded
        full = waiting and (last is None or now - last >= 30_000)
        if full:
            waiting, last, places = False, now, set(index) | set(there)
        elif flooded:
            continue
        for p in places:
            if index.get(p) != there.get(p):
                log.append((number, *p, "added" if p not in index else "changed" if p in there else "removed", full))
                index.pop(p, None)
                if p in there:
                    index[p] = there[p]
    got = {(r["layer"], r["rx"], r["rz"]): (r["mtime_ms"], r["size"], r["is_zip"]) for r in table.read().collect()}
    assert got == index and waiting == table.manifest()["note"]["waiting"]
    assert sorted((r["batch"], r["layer"], r["rx"], r["rz"], r["change"], r["full"]) for r in changes.changes(spark, f"file://{tmp_path}/log").collect()) == sorted(log)
    assert {r[5] for r in log} == {True, False}


def test_uploads_by_a_plain_fold(spark, tmp_path):
    """Uploads one after another in any times, in batches of any size, some twice; refused ones are set aside."""
    import random

    from tilelake.streaming import uploads as U

    rng, stored, backup, refused, rows = random.Random(6), {}, {}, [], []
    for number in range(120):
        region, player, mtime = ("l", rng.randint(0, 2), 0), f"p{rng.randint(0, 1)}", rng.randint(1, 9)
        tiles = {(rng.randint(0, 2), rng.randint(0, 1)): f"v{number}" for _ in range(rng.randint(0, 3))}
        error, truncated = rng.choice([None] * 9 + ["odd"]), rng.random() < 0.1
        rows.append((number, player, *region, mtime, number * 10, error, truncated, [(*t, v) for t, v in tiles.items()]))
        if error or truncated:
            refused.append(number)
            continue
        backup[player, region] = number
        known, own = stored.get(region, (0, {}))
        stored[region] = (max(known, mtime), {**tiles, **own} if known > mtime else {**own, **tiles})
    feed = U.UploadFeed(spark, f"file://{tmp_path}/u", buckets=4)
    for k, (lo, hi) in enumerate(((0, 1), (1, 40), (40, 100), (100, 120))):
        batch = spark.createDataFrame(rows[lo:hi], U.UPLOAD)
        feed(batch, k)
        feed(batch, k)
    got = {}
    for r in feed.merged.read().collect():
        got.setdefault((r["layer"], r["rx"], r["rz"]), (r["mtime_ms"], {}))[1].update({} if r["tx"] is None else {(r["tx"], r["tz"]): r["value"]})
    assert got == stored
    assert {(r["player"], (r["layer"], r["rx"], r["rz"])): r["number"] for r in feed.players.read().collect()} == backup
    assert sorted(r["number"] for r in spark.read.parquet(f"file://{tmp_path}/u/refused").collect()) == refused
    # a batch that broke off after the players' table was written is taken by the other one when it comes again
    more = spark.createDataFrame([(500, "p9", "l", 9, 9, 5, 0, None, False, [(0, 0, "late")])], U.UPLOAD)
    feed.players.remark({"batch": 4})
    feed(more, 4)
    assert feed.merged.read().where("rx = 9").count() == 1 and feed.players.read().where("player = 'p9'").count() == 0


def test_evictions_wait(spark, tmp_path):
    """A preview goes when the watermark has passed its upload by the delay, not before, and once for each time."""
    from tilelake.streaming import uploads as U

    folder, schema = f"{tmp_path}/in", "layer string, rx int, rz int, ts timestamp"
    seen = []

    def note(batch, number):
        seen.append(sorted((r["rx"], r["due_ms"]) for r in batch.collect()))

    def put(k, *rows):
        spark.createDataFrame([(1, x, t) for x, t in rows], "k int, rx int, t long").select(F.lit("l").alias("layer"), "rx", F.lit(0).alias("rz"), F.timestamp_millis("t").alias("ts")).coalesce(1).write.parquet(f"{folder}/{k}")
        query = U.evictions(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)).writeStream.foreachBatch(note).outputMode("append")
        query.option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start().awaitTermination()
        return sorted(x for s in seen for x in s)

    assert put(0, (1, 10_000), (2, 11_000), (1, 10_000)) == []
    assert put(1, (3, 12_400), (1, 11_400)) == []
    assert put(2, (4, 12_600)) == [(1, 12_500)]
    assert put(3, (4, 14_000)) == [(1, 12_500), (1, 13_900), (2, 13_500)]
    assert put(4, (4, 60_000)) == [(1, 12_500), (1, 13_900), (2, 13_500), (3, 14_900), (4, 15_100), (4, 16_500)]


def test_folds_delete_what_they_cover(spark, tmp_path):
    from tilelake.streaming import live

    out, rows = f"file://{tmp_path}/t", []
    fold = live.merge_highlights(out, every=3)
    for number in range(11):
        own = [("d", k % 7, number % 3, 100 * ((number * 7 + k) % 11)) for k in range(number, number + 5)]
        rows += own
        frame = spark.createDataFrame(own, "dim string, x int, z int, found_time long")
        fold(frame, number)
        if number in (2, 7, 8):
            fold(frame, number)  # a batch that comes twice
        least = {}
        for d, x, z, t in rows:
            least[d, x, z] = min(t, least.get((d, x, z), t))
        assert {(r["dim"], r["x"], r["z"]): r["found_time"] for r in live.merged_highlights(spark, out, every=3).collect()} == least
    assert sorted(os.listdir(tmp_path / "t/base")) == ["upto=6", "upto=9"]
    assert len([n for n in os.listdir(tmp_path / "t/delta") if "=" in n]) == 5


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path):
    """A bucket with many rows isn't one task's; its rows stay whole."""
    from tilelake.sources.tables import KeyedTable

    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "64k")
    try:
        table = KeyedTable(spark, f"file://{tmp_path}/t", "k int, v string", ("k",), 1)
        table.replace(spark.range(0, 100_000, 1, 4).selectExpr("cast(id as int) k", "sha2(cast(id as string), 256) v"))
    finally:
        spark.conf.unset(size)
    assert len(list((tmp_path / "t" / "data").rglob("*.parquet"))) > 1
    assert table.read().distinct().count() == 100_000


def test_vault_reads_what_it_parsed_once(spark, small, monkeypatch):
    """The scans' lines are parsed once a query, whatever its steps."""
    from tilelake.plans import store_queries

    read = []
    monkeypatch.setattr(store_queries.vault, "sync", lambda table, batch, scanned, now: read.extend((batch, scanned)))
    store_queries._vault(spark, small)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in read]
    assert len(plans) == 4 and not any("c_custkey" in p for p in plans)


def test_uploads_come_in_bounded_batches_and_buckets(spark, small, monkeypatch):
    """Batches and buckets grow in number with the orders, not in size; what is merged is the same as at once."""
    from tilelake.plans import store_queries
    from tilelake.streaming import uploads as U

    monkeypatch.setattr(store_queries, "BATCH_ROWS", 400)
    monkeypatch.setattr(store_queries, "BUCKET_ROWS", 100)
    feed, rows = store_queries._uploaded(spark, small), U.taken(store_queries._uploads(spark, small))
    assert feed.merged.manifest()["note"]["batch"] >= 3 and feed.merged.buckets == spark.read.parquet(f"{small}/orders.parquet").count() // 100
    whole = U.merged(spark.createDataFrame([], U.STORED), rows)
    assert sorted(map(str, feed.merged.read().collect())) == sorted(map(str, whole.collect()))


def test_evictions_wait_without_python(spark, tmp_path):
    """What waits is the stream's own state; no worker is asked for each region."""
    from tilelake.streaming import uploads as U

    plan = U.evictions(spark.readStream.schema("layer string, rx int, rz int, ts timestamp").parquet(str(tmp_path)))._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "Pandas" not in plan and "EventTimeWatermark" in plan
