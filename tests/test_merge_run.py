"""The merge of two archives: guards, the counts of a plain merge, resuming after every step."""

import random

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from tilelake.operators import index as I
from tilelake.operators import merging as M
from tilelake.operators.merge_run import Archive, MergeError, MergeRun, Options, overlap

REGIONS = "world string, dim string, mw string, cave int, rx int, rz int, mtime_ms long, size long, is_zip boolean, ord long"


def archive(spark, root, rng, names, folder, newer):
    """Regions of a few layers, each with two tiles; other files, settings, waypoints and highlights."""
    regions, tiles = [], []
    for world in names:
        for dim, cave in ((folder, None), (folder, 7), ("DIM-1", None), ("mod$x%y", None)):
            for rx, rz in {(rng.randint(0, 4), rng.randint(0, 4)) for _ in range(8)}:
                regions.append((world, dim, "mw$default", cave, rx, rz, rng.randint(1, 9), 100, True, len(regions)))
                tiles += [(world, dim, "mw$default", cave, rx, rz, t, 0, f"{root}{rng.randint(0, 9)}") for t in {rng.randint(0, 3), 1}]
    bad = [r[:6] for r in regions if rng.random() < 0.1]
    frame = spark.createDataFrame
    own = Archive(
        root,
        frame(regions, REGIONS),
        frame(tiles, "world string, dim string, mw string, cave int, rx int, rz int, tx int, tz int, value string"),
        frame(bad, "world string, dim string, mw string, cave int, rx int, rz int"),
        frame([(w, "server_config.txt", newer, 9) for w in names], "world string, path string, mtime_ms long, size long"),
        frame([(w, "null/dimension_config.txt", newer, k, line) for w in names for k, line in enumerate([f"scalar {root}", f"MWName:{root[-1]}:n", "MWName:loose"])], "world string, path string, mtime_ms long, ord long, line string"),
        frame([(w, "dim%0/mw$default_1.txt", 1, k, line) for w in names for k, line in enumerate(["sets:gui.default", f"waypoint:{root}:A:1:2:3:4:false:0:gui.default"])], "world string, path string, mtime_ms long, ord long, line string"),
        frame([(w, "Old.db", newer, "minecraft:overworld", rng.randint(0, 5), 0, 5) for w in names for _ in range(6)], "world string, path string, mtime_ms long, dim string, x int, z int, found_time long").dropDuplicates(["world", "x"]),
    )
    return own, regions, tiles, bad


@pytest.fixture
def sides(spark):
    rng = random.Random(8)
    return archive(spark, "mem://a", rng, ["one", "two", "Multiplayer_play.net"], "null", 5), archive(spark, "mem://b", rng, ["two", "play.com", "four"], "DIM0", 6)


def plain_counts(sides, out):
    """Regions of each layer that only a, only b, and both have; tiles of the result."""
    meaning = {"null": "minecraft:overworld", "DIM0": "minecraft:overworld", "DIM-1": "minecraft:the_nether", "mod$x%y": "mod:x/y"}
    times, tiles, bad = [{}, {}], [{}, {}], [set(), set()]
    for k, (_, regions, own, unreadable) in enumerate(sides):
        name = lambda r: (out[k].get(r[0], r[0]), meaning[r[1]], r[3], r[4], r[5])  # noqa: B023, E731
        times[k] = {name(r): r[6] for r in regions}
        bad[k] = {name(r) for r in unreadable}
        for t in own:
            tiles[k].setdefault(name(t), {})[t[6]] = t[8]
    counts, result = {}, {}
    for place in set(times[0]) | set(times[1]):
        c = counts.setdefault(place[:3], [0, 0, 0])
        if place not in times[1] or place not in times[0]:
            side = int(place not in times[0])
            c[side] += 1
            result[place] = tiles[side].get(place, {})
            continue
        c[2] += 1
        first = int(times[1][place] > times[0][place])
        result[place] = {t: v for side in (1 - first, first) if place not in bad[side] for t, v in tiles[side].get(place, {}).items()}
    return counts, {(*p, t): v for p, own in result.items() for t, v in own.items()}


def test_counts_and_tiles(spark, sides, tmp_path):
    run = MergeRun(spark, sides[0][0], sides[1][0], f"file://{tmp_path}/out", Options(apply=True, auto_alias=True))
    report = [tuple(r) for r in run.run().collect()]
    counts, tiles = plain_counts(sides, ({"Multiplayer_play.net": "play.com"}, {}))
    got = {}
    for section, world, item, name, n in report:
        if section == "layer" and name in ("only_a", "only_b", "conflicts"):
            key, _, cave = item.rsplit("/", 2)
            got.setdefault((world, key, None if cave == "surface" else int(cave)), {})[name] = n
    assert {k: [v["only_a"], v["only_b"], v["conflicts"]] for k, v in got.items()} == counts
    rows = run.rows("tiles").select("layer.*", "rx", "rz", "tx", "value").collect()
    assert {(r["world"], r["key"], None if r["cave"] == "surface" else int(r["cave"]), r["rx"], r["rz"], r["tx"]): r["value"] for r in rows} == tiles
    assert {(w, i, n) for s, w, i, n, _ in report if s == "world"} == {("two", "two", "exact"), ("Multiplayer_play.net", "play.com", "domain"), ("one", "-", "only a"), ("four", "-", "only b")}
    settings = [r["line"] for r in run.rows("settings").where("world = 'two'").orderBy("ord").collect()]
    assert settings == ["scalar mem://b", "MWName:b:n", "MWName:loose", "MWName:a:n"]
    assert {r["side"] for r in run.rows("files").where("world = 'two'").collect()} == {"B"}
    again = MergeRun(spark, sides[0][0], sides[1][0], f"file://{tmp_path}/out", Options(apply=True, resume=True, auto_alias=True))
    assert sorted(map(tuple, again.run().collect())) == sorted(report) and again.made == []


def test_dry_run_writes_nothing(spark, sides, tmp_path):
    run = MergeRun(spark, sides[0][0], sides[1][0], f"file://{tmp_path}/out")
    names = {r["name"] for r in run.run().where("section = 'world'").collect()}
    assert names == {"exact", "suggested", "only a", "only b"} and not (tmp_path / "out").exists()
    scratch = MergeRun(spark, sides[0][0], sides[1][0], f"file://{tmp_path}/out", scratch=f"file://{tmp_path}/scratch")
    assert sorted(map(tuple, scratch.run().collect())) == sorted(map(tuple, MergeRun(spark, sides[0][0], sides[1][0], f"file://{tmp_path}/wet", Options(apply=True)).run().collect()))
    assert not (tmp_path / "out").exists()


def test_resume_goes_on_where_it_broke_off(spark, sides, tmp_path, monkeypatch):
    """The run dies while it makes one step after another; each resumed run makes only what is left."""
    out, made = f"file://{tmp_path}/out", []
    known = MergeRun._step
    for dies in ("plan", "settings"):
        def step(self, name, make, dies=dies):
            if name == dies:
                raise KeyboardInterrupt
            return known(self, name, make)

        monkeypatch.setattr(MergeRun, "_step", step)
        run = MergeRun(spark, sides[0][0], sides[1][0], out, Options(apply=True, resume=True))
        with pytest.raises(KeyboardInterrupt):
            run.run()
        made += run.made
    monkeypatch.setattr(MergeRun, "_step", known)
    last = MergeRun(spark, sides[0][0], sides[1][0], out, Options(apply=True, resume=True))
    whole = sorted(map(tuple, last.run().collect()))
    assert len(made + last.made) == len(set(made + last.made)) == 11
    fresh = MergeRun(spark, sides[0][0], sides[1][0], f"file://{tmp_path}/fresh", Options(apply=True))
    assert sorted(map(tuple, fresh.run().collect())) == whole
    with pytest.raises(MergeError, match="another merge"):
        MergeRun(spark, sides[0][0], sides[1][0], out, Options(apply=True, resume=True, prefer="a")).run()
    with pytest.raises(MergeError, match="isn't empty"):
        MergeRun(spark, sides[0][0], sides[1][0], out, Options(apply=True)).run()


def test_guards(spark, sides):
    a, b = sides[0][0], sides[1][0]
    for left, right, out, why in ((a, a, "mem://out", "same folder"), (a, b, "mem://a/inside", "side a"), (a, b, "mem://b", "side b")):
        with pytest.raises(MergeError, match=why):
            MergeRun(spark, left, right, out).run()
    none = Archive("mem://c", *(getattr(a, n).limit(0) for n in ("regions", "tiles", "unreadable", "files", "settings", "waypoints", "highlights")))
    with pytest.raises(MergeError, match="side b has no worlds"):
        MergeRun(spark, a, none, "mem://out").run()
    both = Archive(a.root, a.regions.union(a.regions.where("dim = 'null'").withColumn("dim", F.lit("DIM0"))), a.tiles, a.unreadable, a.files, a.settings, a.waypoints, a.highlights)
    with pytest.raises(MergeError, match="two folders of minecraft:overworld"):
        MergeRun(spark, both, b, "mem://out").run()
    assert overlap("s3://x/y", "s3://x/y/z") and not overlap("s3://x/y", "s3://x/yz")


def test_layer_units(spark):
    rows = [("A", "w", "null", "m", None), ("B", "w", "DIM0", "m", None), ("A", "w", "odd", "m", 3), ("B", "w", "null", "n", None), ("B", "w", "DIM0", "n", None), ("A", "w", "DIM0", "n", None)]
    got = {(r["key"], r["mw"], r["cave"]): (r["a"], r["b"], r["folder"], r["mixed"]) for r in M.layer_units(spark.createDataFrame(rows, "side string, world string, dim string, mw string, cave int")).collect()}
    assert got == {("minecraft:overworld", "m", None): ("null", "DIM0", "DIM0", None), ("odd", "m", 3): ("odd", None, "odd", None), ("minecraft:overworld", "n", None): ("DIM0", None, "null", "b")}


def test_named_lines_without_an_id(spark):
    """A named line without a second colon fixes where named lines go, but is no id."""
    rows = [("f", "A", 2, k, v) for k, v in enumerate(["x", "MWName:loose", "y", "MWName:one:1", "MWName:last", "z"])] + [("f", "B", 1, k, v) for k, v in enumerate(["MWName:loose:now", "MWName:one:2", "MWName:free", "q"])]
    got = M.merge_settings(spark.createDataFrame(rows, "file string, side string, mtime_ms long, ord long, line string"), "file")
    assert [r["line"] for r in got.orderBy("ord").collect()] == ["x", "MWName:loose", "y", "MWName:one:1", "MWName:last", "MWName:loose:now", "z"]


def counted(df, seen):
    """The same rows; seen counts them whenever a task reads them."""
    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema)


def test_each_table_is_read_once(spark, sides, tmp_path):
    """Regions are read for the digest and once more; tiles, settings and highlights once. What is written aside goes."""
    seen = {n: spark.sparkContext.accumulator(0) for n in ("regions", "tiles", "settings", "highlights")}
    left, right = (Archive(s.root, *(counted(getattr(s, n), seen[n]) if n in seen else getattr(s, n) for n in ("regions", "tiles", "unreadable", "files", "settings", "waypoints", "highlights"))) for s in (sides[0][0], sides[1][0]))
    rows = {n: sum(getattr(s[0], n).count() for s in sides) for n in seen}
    run = MergeRun(spark, left, right, f"file://{tmp_path}/out", Options(apply=True))
    run.run()
    assert {n: seen[n].value for n in ("tiles", "settings", "highlights")} == {n: rows[n] for n in ("tiles", "settings", "highlights")}
    # Whether a side has worlds is asked first, which reads no more than its regions again.
    assert 2 * rows["regions"] <= seen["regions"].value <= 3 * rows["regions"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["ledger", "steps"]
    newer = {tuple(r) for r in run.rows("databases").select("world", "path", "source_rows", "dest_before", "overlap", "dest_after").collect()}
    places = [{(r["x"], r["z"]) for r in s[0].highlights.where("world = 'two'").collect()} for s in sides]
    assert newer == {("two", "Old.db", len(places[0]), len(places[1]), len(places[0] & places[1]), len(places[0] | places[1]))}


def test_dry_run_reads_each_table_once(spark, sides, tmp_path):
    """With a scratch folder a dry run reads as little as a merge, without the digest, and leaves its steps alone there."""
    seen = {n: spark.sparkContext.accumulator(0) for n in ("tiles", "settings", "highlights")}
    left, right = (Archive(s.root, *(counted(getattr(s, n), seen[n]) if n in seen else getattr(s, n) for n in ("regions", "tiles", "unreadable", "files", "settings", "waypoints", "highlights"))) for s in (sides[0][0], sides[1][0]))
    run = MergeRun(spark, left, right, f"file://{tmp_path}/out", scratch=f"file://{tmp_path}/scratch")
    run.run()
    assert {n: seen[n].value for n in seen} == {n: sum(getattr(s[0], n).count() for s in sides) for n in seen}
    assert not [p.name for p in (tmp_path / "scratch").iterdir() if p.name.startswith("aside")] and run.rows("tiles").count() > 0


def test_unreadable_files_by_a_condition(spark, sides, tmp_path):
    """A condition on the best files says the same as the files that it holds for, and regions are read no more often."""
    found, seen = [], spark.sparkContext.accumulator(0)
    odd = F.col("mtime_ms") % 2 == 1
    for given in (False, True):
        pair = []
        for s in sides:
            a = s[0]
            bad = odd if given else a.regions.where(odd).select("world", "dim", "mw", "cave", "rx", "rz")
            regions = counted(a.regions, seen) if given else a.regions
            pair.append(Archive(a.root, regions, a.tiles, bad, a.files, a.settings, a.waypoints, a.highlights))
        run = MergeRun(spark, *pair, f"file://{tmp_path}/out", scratch=f"file://{tmp_path}/{given}")
        report = sorted(map(tuple, run.run().collect()))
        found.append((report, *(sorted(map(str, run.rows(n).collect())) for n in ("tiles", "regions"))))
    assert found[0] == found[1] and any(r[0] == "note" for r in found[0][0])
    # Once for the best files, and no more than again for whether a side has worlds.
    assert seen.value <= 2 * sum(s[0].regions.count() for s in sides)


def test_query_finds_best_files_once(spark, small):
    """The archives of the queries leave best files to the run: unreadable ones are a condition on these."""
    from tilelake.plans.merge_queries import _archive

    assert isinstance(_archive(spark, small, "A").unreadable, Column)


def test_best_files_sorted_by_a_hash(spark):
    """Keys that begin with a hash of the place give the same files, nulls included, of ties the first listed."""
    rows = [(w, c, x, m, s, z, k) for k, (w, c, x, m, s, z) in enumerate((f"w{k % 3}", None if k % 2 else 3, k % 4, k % 5, k, k % 7 < 3) for k in range(500))]
    files = spark.createDataFrame(rows, "world string, cave int, rx int, mtime_ms long, size long, is_zip boolean, ord long")
    best = {}
    for w, c, x, m, s, z, k in rows:
        best[w, c, x] = max(best.get((w, c, x), (-1,)), (z, m, -k, s))
    place = ("world", "cave", "rx")
    got = I.best_files(files.withColumn("hash", F.xxhash64(*place)), ("hash", *place)).collect()
    assert {(r["world"], r["cave"], r["rx"]): (r["is_zip"], r["mtime_ms"], -r["ord"], r["size"]) for r in got} == best and len(got) == len(best)


def test_settings_are_shuffled_once(spark):
    lines = spark.createDataFrame([("f", "A", 1, 0, "x")], "file string, side string, mtime_ms long, ord long, line string")
    plan = M.merge_settings(lines, "file")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 == plan.count("Exchange ")


def test_ids_are_what_stands_before_the_second_colon(spark):
    text = ["MWName:a:b", "MWName:a:b:c", "MWName::b", "MWName:a", "MWName:", "MWNam:a:b", " MWName:a:b", "", None, "MWName:é§:n", "MWName:a\nb:c"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(text)], "k int, line string")
    got = [r["id"] for r in df.select("k", M.named_id(F.col("line")).alias("id")).orderBy("k").collect()]
    assert got == ["a", "a", "", None, None, None, None, None, None, "é§", "a\nb"]
