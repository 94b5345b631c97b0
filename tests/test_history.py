"""Waypoint history, live positions and streams."""

import pytest
from pyspark.sql import functions as F

from tilelake.functions import naming as N
from tilelake.operators import index as I
from tilelake.operators import live as L
from tilelake.operators import waypoints as W
from tilelake.streaming import live as S


def record(spark, rows):
    base = spark.createDataFrame(rows, "name string, x int, y int, z int, ord int, mw_file string")
    extra = {"world": F.lit("w"), "dim": F.lit("d"), "y_key": F.coalesce("y", F.lit(W.NO_HEIGHT)), "initials": F.lit("A"), "color": F.col("ord"), "disabled": F.lit(False), "purpose": F.lit(0), "wp_set": F.lit("s"), "rotate_on_tp": F.lit(False), "tp_yaw": F.lit(0), "visibility_type": F.lit(0), "destination": F.lit(False), "source": F.lit("t")}
    return base.withColumns(extra)


def test_sync_archives_what_is_gone(spark):
    empty = record(spark, []).withColumns({"present": F.lit(True), "first_seen": F.lit(0).cast("long"), "last_seen": F.lit(0).cast("long")})
    one = record(spark, [("a", 1, None, 2, 1, "f"), ("a", 1, None, 2, 2, "f"), ("b", 1, 5, 2, 1, "g")])
    first = W.sync(empty, one, one, 10)
    assert {(r["name"], r["y"], r["color"], r["present"], r["first_seen"]) for r in first.collect()} == {("a", None, 2, True, 10), ("b", 5, 1, True, 10)}
    # the file of a is read and empty now; that of b isn't read at all
    second = W.sync(first.drop("was_present"), record(spark, []), spark.createDataFrame([("w", "d", "f")], "world string, dim string, mw_file string"), 20)
    assert {(r["name"], r["present"], r["last_seen"]) for r in second.collect()} == {("a", False, 10), ("b", True, 10)}
    report = W.sync_report(second, 0, 20).first()
    assert (report["added"], report["revived"], report["newly_archived"], report["total"], report["archived_total"]) == (0, 0, 1, 2, 1)
    third = W.sync(second.drop("was_present"), record(spark, [("a", 1, None, 2, 3, "f")]), one, 30)
    assert W.sync_report(third, 1, 30).first()["revived"] == 1
    # two scans in one millisecond archive nothing
    again = W.sync(first.drop("was_present"), record(spark, []), one, 10)
    assert again.where("not present").count() == 0


def test_index_diff(spark):
    schema = "layer string, rx int, rz int, mtime_ms long, size long, is_zip boolean"
    old = spark.createDataFrame([("l", 0, 0, 1, 1, True), ("l", 1, 0, 1, 1, True), ("l", 2, 0, 1, None, True)], schema)
    new = spark.createDataFrame([("l", 0, 0, 2, 1, True), ("l", 3, 0, 1, 1, True), ("l", 2, 0, 1, None, True)], schema)
    assert {(r["rx"], r["change"]) for r in I.diff(old, new).collect()} == {(0, "changed"), (1, "removed"), (3, "added")}


@pytest.mark.parametrize("n", [0, 1, 3, 7, 100])
def test_sample_is_every_so_many(spark, n):
    places = [(x, z) for x in range(4) for z in range(3)]
    index = spark.createDataFrame([("l", x, z, 0, 5) for x, z in places] + [("l", 9, 9, 0, 0)], "layer string, rx int, rz int, mtime_ms long, size long")
    step = -(-len(places) // n) if n else 1
    assert sorted((r["rx"], r["rz"]) for r in I.sample(index, n).collect()) == (places[::step][:n] if n else places)


def test_names(spark):
    names = ["0_0.zip", "-3_12.xaero", "+1_2.zip", "1_2.zip.tmp", "99999999999_0.zip", "1_2.ZIP"]
    rx, rz, zipped = N.region_coordinates(F.col("n"))
    got = [tuple(r) for r in spark.createDataFrame([(n,) for n in names], "n string").select(rx, rz, zipped).collect()]
    assert got == [(0, 0, True), (-3, 12, False)] + [(None, None, None)] * 4
    worlds = spark.createDataFrame([("Multiplayer_x.net.org",), ("Y.ORG",), ("a.com.net",)], "w string")
    assert [tuple(r) for r in worlds.select(N.base_domain(F.col("w")), N.world_key(F.col("w"))).collect()] == [("x", "x.net"), ("y.org", "y"), ("a", "a.com")]
    dims = spark.createDataFrame([(" nether ",), ("MINECRAFT:X",), ("a:b/c",), (":x",), (None,)], "d string")
    assert [r[0] for r in dims.select(N.normalise_dimension(F.col("d"))).collect()] == ["minecraft:the_nether", None, "a:b/c", None, None]


def test_rate_limit(spark):
    events = spark.createDataFrame([(k, 1, t) for k, t in enumerate([0, 0, 0, 1000, 1000, 1500])], "event_id long, player long, t_ms long")
    got = [r["passed"] for r in L.rate_limit(events, 1, 2).orderBy("event_id").collect()]
    assert got == [True, True, False, True, False, False]


def test_trail_is_reset(spark):
    rows = [(1, 1, 0, "d", 0, 0), (2, 1, 1000, "d", 10, 0), (3, 1, 2000, "e", 10, 0), (4, 1, 3000, "e", 20, 0), (5, 1, 4000, "e", 5000, 0), (6, 1, 5000, "e", 5001, 0)]
    events = spark.createDataFrame(rows, "event_id long, player long, t_ms long, dim string, x long, z long")
    assert sorted(r["event_id"] for r in L.trails(events).collect()) == [5, 6]


def test_streams_agree_with_batches(spark, small, tmp_path):
    from tilelake.plans.views import positions

    events = positions(spark, small)
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = S.latest_positions(source()).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, L.latest(events).collect()))
    q = S.rate_limited(source(), 0.00005, 3).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("limited").count() == events.count()


def test_flushes_wait(spark):
    few = [("d", 0, "a"), ("d", 1000, "b"), ("d", 1500, "b"), ("d", 2000, "c"), ("e", 100, "x")]
    many = [("f", 0, "0")] + [("f", 1 + k, f"p{k}") for k in range(600)] + [("f", 3000, "q"), ("f", 10_000, "r")]
    got = sorted(map(tuple, L.flushes(spark.createDataFrame(few + many, "dim string, t_ms long, place string")).collect()))
    assert got == [("d", 0, 1), ("d", 2000, 2), ("e", 100, 1), ("f", 0, 1), ("f", 10_000, None)]


def test_flushes_of_parts_are_those_of_a_loop(spark):
    """Quiet times cut a dimension into parts; what waits at the end of one counts in the next one's first flush."""
    import random

    dice, rows = random.Random(5), []
    for dim in "ab":
        t = 0
        for _ in range(700):
            t += dice.choice([0, 1, 30, 900, 2500, 9_999, 10_000, 30_000]) if dice.random() < 0.3 else dice.choice([0, 1, 2])
            rows.append((dim, t, f"p{dice.randrange(600)}"))
    want, state = [], {}
    for dim, t, place in sorted(rows):
        last, waiting = state.setdefault(dim, (None, set()))
        waiting.add(place)
        if last is None or t - last >= (2_000 if len(waiting) <= 64 else 10_000):
            want.append((dim, t, len(waiting) if len(waiting) <= 512 else None))
            state[dim] = (t, set())
    got = sorted(map(tuple, L.flushes(spark.createDataFrame(rows, "dim string, t_ms long, place string")).collect()))
    assert len(want) > 50 and got == want
    assert L.flushes(spark.createDataFrame([], "dim string, t_ms long, place string")).count() == 0


def test_stream_folds_its_deltas(spark, tmp_path):
    """Whatever batch the table is read after, and however often one comes, the oldest sighting of each chunk is there."""
    from tilelake.streaming.live import merge_highlights, merged_highlights

    table, seen = str(tmp_path / "t"), {}
    fold = merge_highlights(table, every=2)
    for number in range(5):
        rows = [("d", k, 0, 100 - 7 * number * (k % 3) + k) for k in range(number, number + 4)]
        for _, x, _, t in rows:
            seen[x] = min(t, seen.get(x, t))
        batch = spark.createDataFrame(rows, "dim string, x int, z int, found_time long")
        fold(batch, number)
        fold(batch, number)
        assert {r["x"]: r["found_time"] for r in merged_highlights(spark, table, every=2).collect()} == seen


def test_canvas_keeps_the_latest(spark):
    schema = "dim string, cx int, cz int, first long, last long, value string"
    stored = spark.createDataFrame([("d", 0, 0, 1, 1, "old"), ("d", 1, 0, 2, 2, "b")], schema)
    after = L.preview_canvas(stored, spark.createDataFrame([("d", 0, 0, 5, 5, "new"), ("d", 2, 0, 6, 6, "c")], schema), 2)
    assert {tuple(r) for r in after.collect()} == {("d", 1, 0, 2, 2, "b"), ("d", 2, 0, 6, 6, "c")}
    gone = L.evict_regions(after, spark.createDataFrame([("d", 0, 0)], "dim string, rx int, rz int"))
    assert gone.count() == 0


def test_settings_of_all_orders(spark, tmp_path):
    """The queries on all orders lose none, whatever their keys; the numbers of files grow with the table."""
    from tilelake.queries import QUERIES

    orders = [(k, k * 7 % 501) for k in [*range(0, 700), *range(5500, 7000), *range(90_000, 92_500), *range(200_000, 200_060)]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    files, newest = {}, {}
    for k, c in orders:
        name = f"mw{c % 13}" if c % 3 == 0 else None
        files.setdefault(k // 1000, {"A": [], "B": []})["AB"[k // 40 % 2]].append((f"MWName:{name}:n" if name else f"note {c}", name))
        newest.setdefault(c, []).append((k % 2000 * 4 + c % 2, "BA"[k % 2 == 0]))
    want = {}
    for file, sides in files.items():
        own, other = (sides["B"], sides["A"]) if file % 3 > 0 else (sides["A"], sides["B"])
        at = max((n + 1 for n, (_, name) in enumerate(own) if name), default=0)
        added = [x for x in other if x[1] and x[1] not in {name for _, name in own}]
        assert file != 200 or added
        want |= {(file, n): x[0] for n, x in enumerate(own[:at] + added + own[at:])}
    assert {(r["file"], r["ord"]): r["line"] for r in QUERIES["merge_settings_all"](spark, str(tmp_path)).collect()} == want
    top = {c: max(x, key=lambda y: (y[0], y[1] == "A")) for c, x in newest.items()}
    assert {r["file"]: (r["mtime_ms"], r["side"]) for r in QUERIES["settings_newer_file_all"](spark, str(tmp_path)).collect()} == top


def test_settings_of_whole_lines(spark, tmp_path):
    """Keys and values lie anywhere in a line, however long."""
    from tilelake.queries import QUERIES

    texts = {1: "k" * 90 + ":" + "v" * 25_000 + "\nshort:" + "w" * 61 + "\nshort:later", 2: "a" * 59 + ".b:c\n" + "a" * 59 + "x.y\n\n// no:thing", 3: "no separator " * 9, 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, t in texts.items():
        for line in (t or "").split("\n"):
            if line.strip(" ") and not line.startswith("//"):
                key, _, value = line.replace(".", ":").partition(":")
                want.setdefault((k, key), value)
    assert {(r["doc_id"], r["key"]): r["value"] for r in QUERIES["settings_whole_lines"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("size", [1, 3, 10**9])
def test_blocks_of_events(spark, size):
    """Running maxima and paths by blocks of any size are those of a plain walk."""
    import math
    import random

    rng = random.Random(size)
    rows = [(k, rng.randint(0, 2), rng.randint(0, 60), rng.choice("ab"), rng.randint(-9, 9), rng.randint(-9, 9)) for k in range(200)] + [(500, 9, 1, "a", 0, 0)]
    events = spark.createDataFrame(rows, "event_id long, player long, t_ms long, dim string, x long, z long").repartition(3)
    top, kept = {}, []
    for e in sorted(rows):
        if e[2] >= top.get(e[1], -1):
            kept.append(e)
        top[e[1]] = max(top.get(e[1], -1), e[2])
    assert sorted(map(tuple, L.in_order(events, size).collect())) == kept
    paths, last = {}, {}
    for _, player, _, dim, x, z in sorted(rows, key=lambda e: (e[2], e[0])):
        key = (player, dim)
        paths.setdefault(key, None)
        if key in last:
            paths[key] = (paths[key] or 0) + math.hypot(x - last[key][0], z - last[key][1])
        last[key] = x, z
    got = {(r["player"], r["dim"]): r["blocks"] for r in L.path_length(events, size).collect()}
    assert set(got) == set(paths) and all(got[k] == pytest.approx(paths[k]) for k in paths)


def test_preview_samples_alone_are_exploded(spark, small):
    """Chunks are dealt over tasks before their pixels are made, and no sample carries its chunk's pixels along."""
    from tilelake.plans.history_queries import QUERIES

    plan = QUERIES["live_preview_tiles"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    generate, below = plan.split("Generate ", 1)[1].split("\n", 1)
    assert generate.startswith("posexplode(array(") and "RepartitionByExpression [p_partkey" in below
